"""Queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import crosssplit, formcopies, langid, leakage, pii, ridf, subjects, termfreq, tokenise

Query = Callable[[SparkSession, str], DataFrame]


def _by_source(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of the parts with the name of each in src."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("src"), "*") for name, df in parts.items()])


def _names(spark: SparkSession, folder: str) -> frozenset[str]:
    return pii.known_names(table(spark, folder, "name_list"), "person_name")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    names = _names(spark, folder)
    spans = _by_source(
        {
            "raw_reviews": pii.personal_spans(table(spark, folder, "raw_reviews"), "row_id", "ulasan", names),
            "labelled": pii.personal_spans(table(spark, folder, "labelled"), "row_id", "raw", names),
        }
    )
    kinds = ("email", "phone", "id_number", "address", "person_name")
    return spans.where(F.col("kind").isin(*kinds)).select("src", "row_id", "kind").distinct()


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    names = _names(spark, folder)
    return _by_source(
        {
            "raw_reviews": pii.redacted(table(spark, folder, "raw_reviews"), "row_id", "ulasan", names),
            "labelled": pii.redacted(table(spark, folder, "labelled"), "row_id", "raw", names),
        }
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    bounds = {"min_tf": 3, "min_df": 2, "max_df": 20}
    scored = {
        "labelled": ridf.term_scores(table(spark, folder, "labelled"), "row_id", "raw", **bounds),
        "documents": ridf.term_scores(table(spark, folder, "documents"), "doc_id", "text", **bounds),
    }
    return _by_source(scored).select("src", "row_id", "term")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _by_source(
        {
            "labelled": ridf.term_scores(table(spark, folder, "labelled"), "row_id", "raw"),
            "documents": ridf.term_scores(table(spark, folder, "documents"), "doc_id", "text"),
        }
    )


def _forms(spark: SparkSession, folder: str, operator) -> DataFrame:
    return _by_source(
        {
            "raw_reviews": operator(table(spark, folder, "raw_reviews"), "row_id", "user_name", "ulasan"),
            "doc_example": operator(table(spark, folder, "doc_example"), "row_id", "user_name", "content", formcopies.FIELD_LABELS),
        }
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder, formcopies.form_copies)


def p3_copies(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder, formcopies.collapsed)


def _profiles(spark: SparkSession, folder: str) -> langid.Profiles:
    return langid.corpus_profiles(
        table(spark, folder, "lang_samples"), "lang", "sample", table(spark, folder, "documents"), "doc_id", "text", "lang"
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    profiles = _profiles(spark, folder)
    return _by_source(
        {
            "raw_reviews": langid.label_corrections(table(spark, folder, "raw_reviews"), "row_id", "ulasan", "lang", profiles),
            "documents": langid.label_corrections(table(spark, folder, "documents"), "doc_id", "text", "lang", profiles),
        }
    )


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    profiles = _profiles(spark, folder)
    return _by_source(
        {
            "raw_reviews": langid.language_segments(table(spark, folder, "raw_reviews"), "row_id", "ulasan", profiles),
            "documents": langid.language_segments(table(spark, folder, "documents"), "doc_id", "text", profiles),
        }
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = crosssplit.split_overlaps(table(spark, folder, "labelled"), "row_id", "raw", "split")
    return pairs.select(F.least("train_id", "eval_id").alias("row_a"), F.greatest("train_id", "eval_id").alias("row_b"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.overlap_report(table(spark, folder, "labelled"), "row_id", "raw", "split", "source")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """p5_report without the coverage, which SQL has no words for."""
    return p5_report(spark, folder).select("split", "source", "n_records", "n_overlapping")


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    return _by_source(
        {
            "labelled": termfreq.marked_terms(table(spark, folder, "labelled"), "raw"),
            "raw_reviews": termfreq.marked_terms(table(spark, folder, "raw_reviews"), "ulasan"),
        }
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).where("mark IS NOT NULL").select("src", "term", "mark")


def p7_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenise.encode_column(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(
        table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark_items"), "item_id", "passage"
    )


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_spans(
        table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark_items"), "item_id", "passage"
    )


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    names = [r.subject for r in table(spark, folder, "subjects").select("subject").distinct().orderBy("subject").limit(63).collect()]
    return subjects.propagate(
        table(spark, folder, "documents"), "doc_id", "text",
        table(spark, folder, "subject_labels"), "doc_id", "subject", names,
        table(spark, folder, "benchmark_items"), "passage",
    )


def p10_mix(spark: SparkSession, folder: str) -> DataFrame:
    return p10_found(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_scores, p3_found, p3_copies, p4_found, p4_segments, p5_found, p5_report, p5_counts, p7_found, p7_terms, p8_ids, p9_found, p9_spans, p10_found, p10_mix)}
