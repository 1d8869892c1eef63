"""Term statistics and TF-IDF vectors in long form, vocabulary cuts and stratified samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .heavy import join_key_stats

MAX_VOCABULARY = 300
#: Terms whose idf is broadcast, checked by a count; a larger vocabulary is joined by shuffles.
BROADCAST_TERMS = 500_000


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), " "), lambda w: F.btrim(w) != "")


def _kept(term: Column) -> Column:
    """Terms of more than one byte."""
    return F.octet_length(term) > 1


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """term, df: the number of rows with the term; combined before the shuffle."""
    terms = df.select(F.explode(F.array_distinct(_tokens(F.col(text)))).alias("term")).where(_kept(F.col("term")))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def smoothed_idf(df: DataFrame, text: str) -> DataFrame:
    """term, df, idf = ln((N + 1) / (df + 1)) + 1."""
    n = df.count()
    return document_frequency(df, text).withColumn("idf", F.log(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1)


def broadcast_idf(idf: DataFrame, limit: int = BROADCAST_TERMS) -> dict[str, float] | None:
    """term -> idf of a vocabulary of at most limit terms, else None."""
    rows = idf.select("term", "idf").limit(limit + 1).collect()
    return {r.term: r.idf for r in rows} if len(rows) <= limit else None


def row_weights(text: str | None, idf: dict[str, float]) -> dict[str, float]:
    """term -> weight of one text: tf times idf, of unit length. tf is the count over all non-empty tokens."""
    words = [w for w in (text or "").lower().split(" ") if w]
    weights = {w: n / len(words) * idf[w] for w, n in Counter(words).items() if w in idf}
    norm = sqrt(sum(x * x for x in weights.values()))
    return {w: x / norm for w, x in weights.items()} if norm else {}


def tfidf(df: DataFrame, key: str, text: str, idf: DataFrame | None = None) -> DataFrame:
    """key, term, w: unit-length weights of the terms of the vocabulary, null texts and unknown terms left out.

    tf is the count over all non-empty tokens of the row. With a vocabulary of at most BROADCAST_TERMS terms every row is
    weighted where it lies, without a shuffle. A larger one is joined: counting and the norm share the partitioning by
    key, and frequent terms are no hot spot.
    """
    idf = cut_lineage(idf if idf is not None else smoothed_idf(df, text))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    if (known := broadcast_idf(idf)) is not None:
        shared = df.sparkSession.sparkContext.broadcast(known)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner, terms, weights = [], [], []
                for at, t in enumerate(batch.column(1).to_pylist()):
                    found = row_weights(t, shared.value)
                    owner += [at] * len(found)
                    terms += found.keys()
                    weights += found.values()
                keys = batch.column(0).take(pa.array(owner, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(terms, pa.string()), pa.array(weights, pa.float64())], names=["__key", "term", "w"])

        kind = rows.schema["__key"].dataType.simpleString()
        return rows.mapInArrow(weigh, f"__key {kind}, term string, w double").withColumnRenamed("__key", key)
    rows = rows.select("__key", _tokens(F.col("__text")).alias("w")).where(F.size("w") > 0)
    counted = rows.select("__key", F.size("w").alias("words"), F.explode("w").alias("term")).where(_kept(F.col("term")))
    counted = counted.groupBy("__key", "term").agg((F.count(F.lit(1)) / F.first("words")).alias("tf"))
    weighted = join_key_stats(counted, idf, "term", "df")
    weighted = weighted.select("__key", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("__key")))
    return weighted.select(F.col("__key").alias(key), "term", (F.col("w") / norm).alias("w"))


def idf_stats(idf: DataFrame) -> DataFrame:
    return idf.agg(F.avg("idf").alias("avg_idf"), F.min("idf").alias("min_idf"), F.max("idf").alias("max_idf"), F.count(F.lit(1)).alias("vocabulary_size"))


def top_terms(df: DataFrame, text: str, n: int = 20) -> DataFrame:
    """term, tf, place: the n largest shares of all vocabulary tokens, ties by term. A top-n report of constant size."""
    terms = df.where(F.col(text).isNotNull()).select(F.explode(_tokens(F.col(text))).alias("term")).where(_kept(F.col("term")))
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    top = counts.orderBy(F.desc("c"), F.asc("term")).limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("c"), F.asc("term")))
    return top.join(F.broadcast(total)).select("term", (F.col("c") / F.col("t")).alias("tf"), place.alias("place"))


def vocabulary(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, df, first (struct of key and position): every term with where it is first seen, by key and word."""
    words = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(_tokens(F.col(text))).alias("at", "term")).where(_kept(F.col("term")))
    once = words.groupBy("key", "term").agg(F.min("at").alias("at"))
    return once.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("key", "at")).alias("first"))


def top_vocabulary(found: DataFrame, n: int = MAX_VOCABULARY) -> DataFrame:
    """term, df, place: the n terms of the most rows, ties by where they are first seen, numbered in first-seen order."""
    top = found.orderBy(F.desc("df"), F.asc("first")).limit(n)
    return top.select("term", "df", F.row_number().over(Window.orderBy("first")).alias("place"))


def first_vocabulary(df: DataFrame, key: str, text: str, idf: DataFrame, n: int = 20) -> DataFrame:
    """term, idf, place: the n terms that appear first, in the order of key and of the words. A report of constant size."""
    words = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.posexplode(_tokens(F.col(text))).alias("__at", "term"))
    seen = words.where(_kept(F.col("term"))).groupBy("term").agg(F.min(F.struct("__key", "__at")).alias("__first"))
    first = seen.orderBy("__first").limit(n)
    place = F.row_number().over(Window.orderBy("__first"))
    return F.broadcast(first).join(idf, "term").select("term", "idf", place.alias("place"))


def training_summary(df: DataFrame, text: str, label: str) -> DataFrame:
    """One row: vocabulary_size, total_documents, avg_idf, min_idf, max_idf, n_labels of a training table."""
    totals = df.agg(F.count(F.lit(1)).alias("total_documents"), F.countDistinct(label).alias("n_labels"))
    return idf_stats(smoothed_idf(df, text)).join(F.broadcast(totals))


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(df: DataFrame, key: str, label: str, size: int, seed: str = "senarai") -> DataFrame:
    """key, label of `size` rows: an equal part of every label, at least one row, topped up from the rest, all in the order
    of a seeded digest. A sampling operator: its size is its meaning. Rows without a label are left out; any number of
    labels has its part. One pass: each task keeps at most size rows of a label before anything is shuffled."""
    mixed = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    rows = df.where(F.col(label).isNotNull()).select(F.col(key), F.col(label), mixed.alias("__mix"))
    placed = rows.withColumn("__place", F.row_number().over(Window.partitionBy(label).orderBy("__mix", key))).where(F.col("__place") <= size)
    # the rows that top up are among the first `size` of their labels
    placed = cut_lineage(placed)
    labels = placed.select(F.count_if(F.col("__place") == 1)).first()[0]
    each = max(1, size // max(labels, 1))
    sample = placed.where(F.col("__place") <= each)
    missing = max(0, size - sample.count())
    return sample.select(key, label).unionAll(placed.where(F.col("__place") > each).orderBy("__mix", key).limit(missing).select(key, label))


def first_seen_labels(df: DataFrame, label: str, order: str) -> DataFrame:
    return df.groupBy(label).agg(F.min(order).alias("first_seen"))

