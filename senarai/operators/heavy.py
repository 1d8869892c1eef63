"""Joins when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Least number of shares of all rows above which a key counts as heavy.
HEAVY_KEYS = 2_000


def join_key_stats(rows: DataFrame, stats: DataFrame, key: str, weight: str, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Inner join of rows with stats (unique in key; weight: rows of the key) without sending a hot key to one task.

    A key is heavy above total weight / max(heavy_keys, 4 x shuffle partitions); so there are fewer heavy keys than that,
    which bounds their broadcast, and any other key holds at most a quarter of an even shuffle partition, however large
    the data are. stats are computed once, behind a checkpoint. Rows whose key is null or absent from stats are dropped,
    as in an inner join. Empty inputs give an empty result.
    """
    stats = cut_lineage(stats)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = stats.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) > total / max(heavy_keys, 4 * partitions)
    heavy = stats.where(is_heavy)
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(stats.where(~is_heavy), key)
    return hot.unionByName(cold)


def salted_join(left: DataFrame, right: DataFrame, key: str, part_rows: int) -> DataFrame:
    """Inner join on key where a key may hold any share of right's rows: a key of more than part_rows rows is cut into
    parts by a hash of its rows, and left's rows are repeated for each part.

    The keys above the bound, at most right's rows / part_rows and no more than the joined rows can pay for, are counted
    first. Null keys match nothing.
    """
    counts = right.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > part_rows)
    parts = cut_lineage(counts.select(key, F.ceil(F.col("__n") / part_rows).cast("int").alias("__parts")))
    if parts.isEmpty():
        return left.join(right, key)
    others = [c for c in right.columns if c != key]
    small = F.broadcast(parts)
    cut = right.join(small, key, "left").withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*others), F.col("__parts")).cast("int")).otherwise(0))
    spread = left.join(small, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return spread.drop("__parts").join(cut.drop("__parts"), [key, "__part"]).drop("__part")
