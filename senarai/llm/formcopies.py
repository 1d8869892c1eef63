"""Records that differ only in form, by progressive refinement of a partition.

Level 1 puts every row into a class of cheap invariants of its letters and digits: the length of name and text and how
often a few letters occur in the text. Neither case, punctuation, spaces nor the order of labelled fields changes them.
Classes are counted in a table of 2^filter_bits counters, reduced to one bit each ("several rows or none"), which is
broadcast. The table has about FILTER_SHARE counters a row, so few rows share one by chance, but never more than
2^MAX_FILTER_BITS: 2^(MAX_FILTER_BITS - 6) rows of a BIGINT, some 60 MB. That holds for a few hundred million rows; of
larger tables more and more rows pass by chance, until level 2 sees them all and only its 24 bytes a row are shuffled.
Level 2 computes the costly key, parsing and ordering fields and digesting everything, only for rows whose bit is set.
A shared counter merely lets a single row through to level 2; no copy is ever lost.
No text is shuffled, only a row id and a 16-byte digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.heavy import join_key_stats
from ..session import cut_lineage

FIELD_LABELS = ("kelebihan", "kekurangan", "saran", "versi", "perangkat")
HISTOGRAM_LETTERS = "aienktsrul"
FILTER_SHARE, MIN_FILTER_BITS, MAX_FILTER_BITS = 8, 16, 28


def stripped(text: Column) -> Column:
    """The letters and digits of a text, lower-cased."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def cheap_class(name: Column, text: Column) -> Column:
    """64-bit class of length and letter histogram, equal for all copies of a record."""
    counts = [F.length(F.replace(text, F.lit(c), F.lit(""))) for c in HISTOGRAM_LETTERS]
    return F.xxhash64(F.length(name), F.length(text), *counts)


def ordered_fields(content: Column, labels: Sequence[str]) -> Column:
    """The letters and digits of content; with two or more labelled fields, of its fields in a fixed order."""
    label = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(labels) + r")\s*[:：]"
    parts = F.split(content, label.replace("(?:", "(?=(?:", 1) + ")")
    several = F.size(F.filter(parts, lambda p: p.rlike("^" + label))) >= 2
    return F.when(several, F.concat_ws("\n", F.array_sort(F.filter(F.transform(parts, stripped), lambda p: p != "")))).otherwise(stripped(content))


def form_digests(
    df: DataFrame, key: str, name: str, text: str, labels: Sequence[str] = (), filter_bits: int | None = None
) -> DataFrame:
    """row_id BIGINT, digest BINARY(16) of the rows that may have a copy; equal digests are copies."""
    if filter_bits is None:
        filter_bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, (FILTER_SHARE * df.where(F.col(name).isNotNull()).count()).bit_length()))
    norm = (
        df.where(F.col(name).isNotNull() & F.col(text).rlike(r"[\p{L}\p{N}]"))
        .select(F.col(key).cast("bigint").alias("row_id"), stripped(F.col(name)).alias("n"), stripped(F.col(text)).alias("t"), F.col(text).alias("raw"))
    )
    classed = norm.withColumn("bucket", cheap_class(F.col("n"), F.col("t")).bitwiseAND(F.lit((1 << filter_bits) - 1)))
    several = classed.groupBy("bucket").count().where("count > 1")
    bits = several.groupBy(F.shiftrightunsigned("bucket", 6).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 AS INT))")).alias("bits")
    )
    passed = classed.join(F.broadcast(bits), F.shiftrightunsigned("bucket", 6) == F.col("slot")).where(
        F.expr("bit_get(bits, cast(bucket & 63 AS INT)) = 1")
    )
    canonical = ordered_fields(F.col("raw"), labels) if labels else F.col("t")
    return passed.select("row_id", F.unhex(F.md5(F.concat_ws("\u0000", "n", canonical))).alias("digest"))


def form_groups(
    df: DataFrame, key: str, name: str, text: str, labels: Sequence[str] = (), filter_bits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members: row_id, digest; groups: digest, keep_id, copies), groups of at least two rows.

    Rows with a null name or text, or a text without letter or digit, are in no group. A name without letters is
    compared as the empty sequence. keep_id is the smallest id; unchanged repeats count as copies. Ids that repeat
    count as rows of their own. An empty table gives empty results. Columns other than the three are ignored.
    """
    members = cut_lineage(form_digests(df, key, name, text, labels, filter_bits))
    groups = members.groupBy("digest").agg(F.min("row_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return members, cut_lineage(groups.where("copies > 1"))


def form_copies(
    df: DataFrame, key: str, name: str, text: str, labels: Sequence[str] = (), filter_bits: int | None = None
) -> DataFrame:
    """keep_id, row_id of every row that is a copy of an earlier one. A group may hold any share of all rows: its
    minimum is combined before the shuffle and the largest groups are joined by a broadcast of constant size."""
    members, groups = form_groups(df, key, name, text, labels, filter_bits)
    return join_key_stats(members, groups, "digest", "copies").where("row_id > keep_id").select("keep_id", "row_id")


def collapsed(
    df: DataFrame, key: str, name: str, text: str, labels: Sequence[str] = (), filter_bits: int | None = None
) -> DataFrame:
    """keep_id, copies: one row for each group, how many rows it holds. Records without a copy are not listed."""
    _, groups = form_groups(df, key, name, text, labels, filter_bits)
    return groups.select("keep_id", "copies")
