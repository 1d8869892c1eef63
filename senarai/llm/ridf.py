"""How characteristic a term is of a record: term frequency times residual inverse document frequency.

idf = -log2(df / N); a term spread at random (Poisson) with cf occurrences over N records would be in N(1 - e^(-cf/N))
of them, so its expected idf is -log2(1 - e^(-cf/N)). The residual is the difference: near 0 for words that fall
anywhere, large for words concentrated in few records. The score multiplies it by the frequency in the record.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.heavy import join_key_stats
from ..session import cut_lineage
from .words import terms_of


def record_term_counts(df: DataFrame, key: str, text: str, min_tf: int = 1) -> DataFrame:
    """row_id BIGINT, term STRING, tf INT, each record counted where it lies: no shuffle.

    Null and letterless texts give no rows; a key that occurs in two rows gives the rows of both.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, counts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term, n in Counter(terms_of(t)).items():
                    if n >= min_tf:
                        ids.append(i)
                        terms.append(term)
                        counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int32())],
                names=["row_id", "term", "tf"],
            )

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "row_id bigint, term string, tf int")


def collection_stats(df: DataFrame, text: str) -> DataFrame:
    """term, df, cf, ridf over all records, behind a checkpoint. Terms are counted by the same Python function as those of a
    record, each batch at once, so at most one row a term and batch is summed; the number of records is one more sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            occurrences: Counter = Counter()
            records: Counter = Counter()
            for t in batch.column(0).to_pylist():
                terms = terms_of(t)
                occurrences.update(terms)
                records.update(set(terms))
            terms = [None, *records]
            columns = [pa.array(terms, pa.string()), pa.array([batch.num_rows, *records.values()], pa.int64()), pa.array([0, *[occurrences[t] for t in records]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "df", "cf"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counted = cut_lineage(rows.mapInArrow(count, "term string, df bigint, cf bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))
    total = counted.where("term IS NULL").first()
    n = F.lit(float(total.df if total else 1))
    observed = -F.log2(F.col("df") / n)
    expected = -F.log2(F.lit(1.0) - F.exp(-F.col("cf") / n))
    return counted.where("term IS NOT NULL").withColumn("ridf", F.round(observed - expected, 6) + 0.0)


def term_scores(
    df: DataFrame, key: str, text: str, min_tf: int = 1, min_df: int = 1, max_df: int | None = None
) -> DataFrame:
    """row_id, term, tf, df, cf, ridf, score = tf * ridf for every term of every record within the given bounds.

    min_tf is applied before the join, so a selective query shuffles little. Terms that hold a large share of all rows,
    within the bounds or not, are met where the records lie and not sent to one task. The table is read three times: for
    the statistics, for frequent terms and for all others. Empty tables give no rows; ties are kept; repeated rows are
    scored each.
    """
    joined = join_key_stats(record_term_counts(df, key, text, min_tf), collection_stats(df, text), "term", "df").where(F.col("df") >= min_df)
    if max_df is not None:
        joined = joined.where(F.col("df") <= max_df)
    return joined.select(
        "row_id", "term", "tf", "df", "cf", "ridf", (F.round(F.col("tf") * F.col("ridf"), 6) + 0.0).alias("score")
    )
