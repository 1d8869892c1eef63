"""The preprocessing pipeline: six text stages, then removal of empty and repeated results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

STAGES = ("case_folding", "cleansing", "normalisasi", "tokenizing", "filtering", "stemming")


def stages(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, raw, and the six stages as strings (token lists joined by blanks).

    A null text counts as empty. Texts of fewer than three characters have empty stages. One narrow projection chain.
    Each stage is a column of its own that the next one refers to, so no stage is computed twice.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    gate = lambda c: F.when(F.col("__short"), F.lit("")).otherwise(c)
    df = df.select(*keep, raw.alias("raw"), T.too_short(raw).alias("__short"))
    df = df.withColumn("case_folding", gate(T.case_fold(F.col("raw"))))
    df = df.withColumn("cleansing", T.cleanse(F.col("case_folding")))
    df = df.withColumn("normalisasi", T.squeeze_elongation(T.normalize_slang(F.col("cleansing"))))
    df = df.withColumn("__tokens", T.tokenize(F.col("normalisasi")))
    df = df.withColumn("__kept", T.drop_stopwords(F.col("__tokens")))
    return df.select(
        *keep,
        "raw",
        "case_folding",
        "cleansing",
        "normalisasi",
        F.array_join("__tokens", " ").alias("tokenizing"),
        F.array_join("__kept", " ").alias("filtering"),
        F.array_join(T.stem_tokens(F.col("__kept")), " ").alias("stemming"),
    )


def stage(df: DataFrame, text: str, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns and one stage; the later ones are pruned from the plan."""
    return stages(df, text, keep).select(*keep, name)


def drop_empty(df: DataFrame, column: str = "stemming") -> DataFrame:
    return df.where(F.btrim(F.coalesce(F.col(column), F.lit("")), F.lit(T.TRIMMED)) != "")


def repeat_key(column: Column) -> Column:
    return F.lower(F.btrim(column, F.lit(T.TRIMMED)))


def keep_first(df: DataFrame, order: str, column: str = "stemming") -> DataFrame:
    """The first row, by order (unique), of every group of equal results, ignoring case and outer blanks.

    One aggregation that keeps the smallest row of every key and combines before the shuffle, so a result that a third
    of all rows share is no hot spot and the stages are computed once. An empty table stays empty. Result columns are
    those of df.
    """
    others = [c for c in df.columns if c != order]
    row = F.struct(F.col(order), *map(F.col, others))
    first = df.groupBy(F.unhex(F.md5(repeat_key(F.col(column)))).alias("__key")).agg(F.min(row).alias("__row"))
    return first.select(*[F.col("__row")[c].alias(c) for c in df.columns])


def wrangle(df: DataFrame, order: str, column: str = "stemming") -> DataFrame:
    """Without repeats and empty results. Empty results are one more repeated key, dropped after the aggregation: a filter
    before it would be pushed into the stages and compute them twice."""
    return drop_empty(keep_first(df, order, column), column)


def removed_counts(df: DataFrame, column: str = "stemming") -> DataFrame:
    """n_before, n_after, n_removed of wrangling, by one aggregation."""
    key = F.when(F.btrim(F.coalesce(F.col(column), F.lit("")), F.lit(T.TRIMMED)) != "", F.md5(repeat_key(F.col(column))))
    keys = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"), F.count("k").alias("n_after"))
    return out.withColumn("n_removed", F.col("n_before") - F.col("n_after"))
