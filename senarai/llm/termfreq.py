"""Frequency of every distinct term: occurrences, records, and a mark for the useless ones.

Every record is turned into its terms inside the JVM; each occurrence counts 1 in `cf`, the first of a record counts 1
in `df`. Both are summed by one hash aggregation that combines before the shuffle, so what crosses the network is at
most one row a distinct term and map task, whatever share of the rows one term holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import term_array

RARE_RECORDS = 2
COMMON_SHARE = 0.10


def term_frequencies(df: DataFrame, text: str) -> DataFrame:
    """term STRING, cf BIGINT (occurrences), df BIGINT (records).

    Null, empty and letterless texts add no term. Repeated rows count each. An empty table gives no rows. Only the
    column `text` is read; columns of any other name, `term` and `cf` too, are ignored.
    """
    terms = df.select(term_array(F.col(text)).alias("__terms")).where(F.size("__terms") > 0)
    marked = F.concat(
        F.transform("__terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct("__terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("c"), F.lit(1).alias("d"))),
    )
    return (
        terms.select(F.explode(marked).alias("e"))
        .groupBy(F.col("e.term").alias("term"))
        .agg(F.sum("e.c").alias("cf"), F.sum("e.d").alias("df"))
    )


def marked_terms(
    df: DataFrame, text: str, rare_records: int = RARE_RECORDS, common_share: float = COMMON_SHARE
) -> DataFrame:
    """term, cf, df, mark: 'rare' in at most rare_records records, else 'common' in more than common_share of the
    records with non-null text, else null. The number of records is a second, one-column scan."""
    records = df.where(F.col(text).isNotNull()).count()
    mark = (
        F.when(F.col("df") <= rare_records, "rare")
        .when(F.col("df") * 1.0 > F.lit(float(common_share)) * F.lit(float(records)), "common")
    )
    return term_frequencies(df, text).withColumn("mark", mark)
