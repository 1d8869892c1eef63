"""Automatic labels, their distribution, manual corrections, pages and keywords learned from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons, sentiment
from ..functions.text import SPACE, TRIMMED, sentiment_synonym

PAGE_ROWS = 100


def auto_label(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, raw, sentiment, confidence (the signed compound score) of every row with text.

    Null, empty and blank texts, and the text `0`, are skipped. One narrow stage.
    """
    usable = ~F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(TRIMMED)).isin("", "0")
    rows = df.where(usable).select(*keep, F.col(text).alias("raw"))
    scored = sentiment.scores(rows, "raw")
    return scored.select(*keep, "raw", sentiment.label_of(F.col("label_score")).alias("sentiment"), F.col("compound").alias("confidence"))


def _percentages(counts: DataFrame) -> DataFrame:
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) / F.greatest("total", F.lit(1)) * 100, 1)).otherwise(0.0)
    return counts.select(*lexicons.LABELS, "total", *[share(c).alias(f"{c}_percentage") for c in lexicons.LABELS])


def distribution(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """One row: counts of the three exact labels (null counts as netral), all rows, percentages with one decimal."""
    name = F.coalesce(F.col(label), F.lit("netral"))
    return _percentages(df.agg(*[F.count_if(name == c).alias(c) for c in lexicons.LABELS], F.count(F.lit(1)).alias("total")))


def review_distribution(df: DataFrame, label: str) -> DataFrame:
    """As distribution, but labels in either language, any case; everything unknown is netral."""
    name = sentiment_synonym(F.col(label))
    return _percentages(df.agg(*[F.count_if(name == c).alias(c) for c in lexicons.LABELS], F.count(F.lit(1)).alias("total")))


def by_sentiment(df: DataFrame, label: str, wanted: str) -> DataFrame:
    """Rows of one sentiment, case ignored; `all` keeps every row."""
    return df if wanted == "all" else df.where(F.lower(F.col(label)) == wanted.lower())


def dominance(counts: DataFrame) -> DataFrame:
    """verdict: the strictly largest class of a distribution row, else `seimbang`."""
    p, n, z = (F.col(c) for c in lexicons.LABELS)
    verdict = F.when((p > n) & (p > z), "positif").when((n > p) & (n > z), "negatif").when((z > p) & (z > n), "netral").otherwise("seimbang")
    return counts.select(verdict.alias("verdict"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with `pos`, the dense 0-based place of each row by the unique column order.

    Rows are sorted by range partitions and numbered from the counts of the partitions before, so no task sees more than
    its range. Only the counts, one a partition, reach the driver.
    """
    from ..session import cut_lineage

    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    ranged = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("__part").count().orderBy("__part").collect()
    starts, total = [], 0
    for r in sizes:
        starts += [F.lit(r["__part"]), F.lit(total)]
        total += r["count"]
    start = F.create_map(*starts)[F.col("__part")] if starts else F.lit(0)
    return ranged.withColumn("pos", (F.col("__within") + start).cast("bigint")).drop("__part", "__within")


def _checked_page(number: int, total: int, size: int) -> None:
    if number < 1 or number > max(1, -(-total // size)):
        raise ValueError(f"no page {number}")


def page(df: DataFrame, number: int, total: int, size: int = PAGE_ROWS) -> DataFrame:
    """Rows of page `number` (from 1) of a table with dense places `pos` and `total` rows."""
    _checked_page(number, total, size)
    return df.where((F.col("pos") >= (number - 1) * size) & (F.col("pos") < number * size))


def page_of(df: DataFrame, order: str, number: int, total: int, size: int = PAGE_ROWS) -> DataFrame:
    """Rows of page `number` of a table of `total` rows by the unique column order, with `pos`: a top-k of the rows up to the
    page's end, of which each task keeps no more; the table is neither sorted nor numbered as a whole."""
    _checked_page(number, total, size)
    first = (number - 1) * size
    place = F.row_number().over(Window.orderBy(order)) + (first - 1)  # of one page only
    return df.orderBy(order).offset(first).limit(size).withColumn("pos", place.cast("bigint"))


def checked_edits(edits: DataFrame, labels: tuple[str, ...] = lexicons.LABELS) -> DataFrame:
    """edits (page, row, label, ...) with `valid`: a known label and a place that can be one, page from 1 and row from 0."""
    place = (F.col("page") >= 1) & (F.col("row") >= 0)
    return edits.withColumn("valid", F.coalesce(place & F.col("label").isin(*labels), F.lit(False)))


def _edited(df: DataFrame, edits: DataFrame, order: str | None, size: int) -> DataFrame:
    """df with __label: that of the last valid edit of each row by the column order, null where there is none."""
    valid = checked_edits(edits).where("valid")
    turn = F.col(order) if order else F.lit(0)
    at = valid.select(((F.col("page") - 1) * size + F.col("row")).cast("bigint").alias("pos"), turn.alias("__turn"), F.col("label").alias("__label"))
    last = at.groupBy("pos").agg(F.max(F.struct("__turn", "__label"))["__label"].alias("__label"))
    return df.join(last, "pos", "left")


def bulk_edit(df: DataFrame, edits: DataFrame, size: int = PAGE_ROWS, order: str | None = None) -> DataFrame:
    """df (pos, sentiment, confidence, ...) with the labels of edits (page, row, label) and confidence 1.0 where edited.

    Places outside the table and edits with an unknown label, a page below 1 or a row below 0 are ignored. Of several
    edits of a row the last by the column order counts; without one, or between equal ones, the alphabetically last label.
    """
    joined = _edited(df, edits, order, size)
    changed = F.col("__label").isNotNull()
    values = {"sentiment": F.coalesce("__label", "sentiment"), "confidence": F.when(changed, 1.0).otherwise(F.col("confidence"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in df.columns])


def edit_summary(df: DataFrame, edits: DataFrame, size: int = PAGE_ROWS) -> DataFrame:
    """n_edits, n_invalid, updated_count: edits, those that are ignored as invalid, and rows of df (pos) that change."""
    counts = checked_edits(edits).agg(F.count(F.lit(1)).alias("n_edits"), F.count_if(~F.col("valid")).alias("n_invalid"))
    updated = _edited(df.select("pos"), edits, None, size).agg(F.count("__label").alias("updated_count"))
    return counts.join(F.broadcast(updated))


def learned_keywords(df: DataFrame, text: str, label: str, min_count: int = 2) -> DataFrame:
    """sentiment, word, n: words of more than two characters that occur at least min_count times under a label."""
    words = F.split(F.lower(F.col(text)), rf"[{SPACE}]+")
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("sentiment"), F.explode(words).alias("word"))
    kept = rows.where((F.length("word") > 2) & ~F.col("word").isin(*lexicons.LEARNING_STOPWORDS))
    return kept.groupBy("sentiment", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def analyze(df: DataFrame, text: str, keep: tuple[str, ...] = (), default: str = "Saya merasa netral tentang topik ini.") -> DataFrame:
    """The answer of the text service for every row: original_text, translated_text, scores, label.

    Translation needs a web service; its documented fallback, the original text, is what is returned. The four scores
    come from the package's lexicon: shares of the words inside positive, negative and no phrases, and the compound.
    """
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(TRIMMED))
    rows = df.select(*keep, F.when(trimmed == "", F.lit(default)).otherwise(trimmed).alias("original_text"))
    rows = sentiment.scores(rows, "original_text").withColumn("__low", F.lower("original_text"))
    low = F.col("__low")
    positive = sum((sentiment._contained(low, p) for v, p in lexicons.VALENCES.items() if v > 0), F.lit(0))
    negative = sum((sentiment._contained(low, p) for v, p in lexicons.VALENCES.items() if v < 0), F.lit(0))
    rows = rows.withColumn("p", positive).withColumn("n", negative).withColumnRenamed("compound", "c")
    rows = rows.withColumn("w", F.greatest(F.size(F.split(low, rf"[{SPACE}]+")), F.col("p") + F.col("n"), F.lit(1)))
    scores = F.struct(
        F.round(F.col("n") / F.col("w"), 3).alias("neg"),
        F.round((F.col("w") - F.col("p") - F.col("n")) / F.col("w"), 3).alias("neu"),
        F.round(F.col("p") / F.col("w"), 3).alias("pos"),
        F.round("c", 4).alias("compound"),
    )
    return rows.select(*keep, "original_text", F.col("original_text").alias("translated_text"), scores.alias("scores"), sentiment.service_label(F.col("c")).alias("label"))
