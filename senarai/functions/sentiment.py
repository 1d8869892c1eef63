"""Lexicon sentiment as column expressions: compound score and label.

Matching is by substring and every contained phrase counts once, as specified; `strict` variants match whole tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons

BOOST, FLIP, ALPHA, THRESHOLD = 1.293, -0.74, 15.0, 0.05


def _contained(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p)))


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def raw_sum(text: Column, valences: dict[float, tuple[str, ...]]) -> Column:
    """Sum of the valences of the phrases that a lower-cased text contains, counted by valence to stay exact."""
    total = F.lit(0.0)
    for value, phrases in valences.items():
        total = total + F.lit(value) * _contained(text, phrases)
    return total


def adjusted(text: Column, total: Column) -> Column:
    """Strengthened once if any intensifier occurs, then flipped once if any negation does; -0.0 is made 0.0."""
    boosted = total * F.when(_any(text, lexicons.INTENSIFIERS), BOOST).otherwise(1.0)
    return boosted * F.when(_any(text, lexicons.NEGATIONS), FLIP).otherwise(1.0) + 0.0


def squashed(score: Column) -> Column:
    return score / F.sqrt(score * score + ALPHA)


def scores(df: DataFrame, text: str) -> DataFrame:
    """df with `label_score` and `compound` of a text column, from the label and the score lexicon.

    The lower-cased text and the sums are columns of their own, so that they are computed once a row and not once for
    every phrase and score.
    """
    low, name = "__low", f"`{text}`"
    df = df.withColumn(low, F.lower(F.col(name)))
    df = df.withColumn("__sum", raw_sum(F.col(low), lexicons.VALENCES)).withColumn("__more", raw_sum(F.col(low), lexicons.SCORE_ONLY))
    df = df.withColumn("__factor", adjusted(F.col(low), F.lit(1.0)))
    df = df.withColumn("__l", F.col("__sum") * F.col("__factor") + 0.0).withColumn("__c", (F.col("__sum") + F.col("__more")) * F.col("__factor") + 0.0)
    df = df.withColumn("label_score", squashed(F.col("__l"))).withColumn("compound", squashed(F.col("__c")))
    return df.drop(low, "__sum", "__more", "__factor", "__l", "__c")


def label_of(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= threshold, "positif").when(score <= -threshold, "negatif").otherwise("netral")


def strict_labels(df: DataFrame, text: str) -> DataFrame:
    """df with `strict_sentiment`: phrases, intensifiers and negations matched as whole words only."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(f"`{text}`")), r"[^\p{L}\p{N}-]+", " "), F.lit(" "))
    pad = lambda phrases: tuple(f" {p} " for p in phrases)
    low = F.col("__words")
    df = df.withColumn("__words", words)
    df = df.withColumn("__sum", raw_sum(low, {v: pad(p) for v, p in lexicons.VALENCES.items()}))
    boosted = F.col("__sum") * F.when(_any(low, pad(lexicons.INTENSIFIERS)), BOOST).otherwise(1.0)
    df = df.withColumn("__score", boosted * F.when(_any(low, pad(lexicons.NEGATIONS)), FLIP).otherwise(1.0))
    return df.withColumn("strict_sentiment", label_of(squashed(F.col("__score")))).drop("__words", "__sum", "__score")


def service_label(score: Column, threshold: float = THRESHOLD) -> Column:
    """The strict inequality of the text service: exactly the threshold is neutral."""
    return F.when(score > threshold, "positive").when(score < -threshold, "negative").otherwise("neutral")


def confidence_bar(score: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (score + 1) * 50))


def distribution_bar(pct: Column) -> Column:
    return F.greatest(F.lit(20.0), pct * 1.2)
