"""Named queries over the tables of a dataset folder, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sentiment
from ..functions import text as T
from ..functions.lexicons import LABELS
from ..operators import evaluate, features, labelling, model, preprocess, rejects
from ..session import cut_lineage, shared_place
from ..sources import files, schema
from ..sources.tables import spread, table
from ..streaming import reviews

Query = Callable[[SparkSession, str], DataFrame]
SAMPLE_ROWS = 500
RULED_TABLES = ("raw_reviews", "doc_example", "labelled", "predictions", "upload_lines", "documents", "benchmark_items", "customer", "events")


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "raw_reviews").select("row_id", "ulasan", "lang"))


def _r6(name: str):
    return (F.round(F.col(name), 6) + 0.0).alias(name)


# labelling


def sentiment_label(spark: SparkSession, folder: str) -> DataFrame:
    out = labelling.auto_label(_reviews(spark, folder), "ulasan", ("row_id",))
    return out.select("row_id", "sentiment", _r6("confidence"))


def strict_label(spark: SparkSession, folder: str) -> DataFrame:
    rows = sentiment.strict_labels(_reviews(spark, folder).where("ulasan IS NOT NULL"), "ulasan")
    return rows.select("row_id", F.col("strict_sentiment").alias("sentiment"))


def sentiment_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return labelling.distribution(labelling.auto_label(_reviews(spark, folder), "ulasan"))


def sentiment_distribution_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    out = labelling.auto_label(_reviews(spark, folder), "ulasan", ("lang",))
    counts = out.groupBy("lang", F.col("sentiment").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")) * 100, 1))


def review_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return labelling.review_distribution(table(spark, folder, "labelled"), "sentiment")


def dominance_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return labelling.dominance(sentiment_distribution(spark, folder))


def confidence_bars(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labelled").where("confidence IS NOT NULL")
    sign = F.when(F.col("confidence") >= 0, "positif").otherwise("negatif")
    return rows.select("row_id", F.round(sentiment.confidence_bar(F.col("confidence")), 6).alias("bar"), sign.alias("colour"))


def distribution_bars(spark: SparkSession, folder: str) -> DataFrame:
    d = sentiment_distribution(spark, folder)
    return d.select(*[F.round(sentiment.distribution_bar(F.col(f"{x}_percentage")), 6).alias(x) for x in LABELS])


def analyze_service(spark: SparkSession, folder: str) -> DataFrame:
    out = labelling.analyze(_reviews(spark, folder), "ulasan", ("row_id",))
    return out.select("row_id", "original_text", "translated_text", "scores.*", "label")


# preprocessing


def _stage(name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return preprocess.stage(_reviews(spark, folder), "ulasan", name, ("row_id",))

    return query


def preprocess_full(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.stages(_reviews(spark, folder), "ulasan", ("row_id",))


def preprocess_labelled(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "labelled").select("row_id", "raw", F.coalesce("sentiment", F.lit("netral")).alias("sentiment")))
    done = preprocess.stages(rows, "raw", ("row_id", "sentiment"))
    return preprocess.wrangle(done, "row_id").select("row_id", "stemming", "sentiment")


def wrangle_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.wrangle(_stage("stemming")(spark, folder), "row_id")


def wrangle_removed_count(spark: SparkSession, folder: str) -> DataFrame:
    return preprocess.removed_counts(_stage("stemming")(spark, folder))


def strict_cleansing(spark: SparkSession, folder: str) -> DataFrame:
    rows = _reviews(spark, folder).where("ulasan IS NOT NULL")
    return rows.select("row_id", T.letters_only(T.cleanse(T.case_fold(F.col("ulasan")))).alias("cleansing"))


# pages, corrections, keywords


def _labelled_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labelled").where("raw IS NOT NULL").select("row_id", "raw", "sentiment", "confidence")
    return labelling.numbered(rows, "row_id")


def paginate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labelled").where("raw IS NOT NULL")
    return labelling.page_of(rows.select("row_id"), "row_id", 2, rows.count()).select("row_id", "pos", (F.floor(F.col("pos") / labelling.PAGE_ROWS) + 1).alias("page"))


def page_summary(spark: SparkSession, folder: str) -> DataFrame:
    total = table(spark, folder, "labelled").where("raw IS NOT NULL").agg(F.count(F.lit(1)).alias("total"))
    pages = F.ceil(F.col("total") / labelling.PAGE_ROWS)
    return total.select("total", pages.alias("pages"), F.least(F.col("total"), F.lit(labelling.PAGE_ROWS)).alias("last_shown"))


def bulk_edit(spark: SparkSession, folder: str) -> DataFrame:
    """Every row whose id divides by 50 is corrected to the auto-label, through (page, row) edits."""
    rows = _labelled_pages(spark, folder)
    at = sentiment.scores(rows.where(F.col("row_id") % 50 == 0), "raw")
    edits = at.select((F.floor(F.col("pos") / 100) + 1).alias("page"), (F.col("pos") % 100).alias("row"), sentiment.label_of(F.col("label_score")).alias("label"))
    return labelling.bulk_edit(rows, edits).select("row_id", "sentiment", "confidence")


def edit_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Of edits of every row whose id divides by 50, some of which name an unknown label, a wrong place or one row twice."""
    rows = _labelled_pages(spark, folder)
    total = rows.count()
    at = rows.where(F.col("row_id") % 50 == 0).select((F.floor(F.col("pos") / 100) + 1).alias("page"), (F.col("pos") % 100).alias("row"), "row_id")
    odd = F.col("row_id") % 150 == 0
    edits = at.select("page", "row", F.when(odd, "bagus").otherwise("positif").alias("label"))
    edits = edits.unionByName(at.where(~odd).select("page", "row", F.lit("netral").alias("label")))
    edits = edits.unionByName(at.where(odd).select((F.col("page") - 100_000).alias("page"), "row", F.lit("netral").alias("label")))
    edits = edits.unionByName(at.where(odd).select((F.col("page") + F.lit(total)).alias("page"), "row", F.lit("netral").alias("label")))
    return labelling.edit_summary(rows, edits)


def learned_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return labelling.learned_keywords(table(spark, folder, "labelled"), "raw", "sentiment")


# features


def _classifier(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labelled").where("raw IS NOT NULL")
    return spread(rows.select("row_id", "raw", "sentiment")).select("row_id", T.classifier_text(F.col("raw")).alias("text"), "sentiment")


def classifier_text(spark: SparkSession, folder: str) -> DataFrame:
    return _classifier(spark, folder).select("row_id", "text")


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return features.document_frequency(_classifier(spark, folder), "text")


def smoothed_idf(spark: SparkSession, folder: str) -> DataFrame:
    return features.smoothed_idf(_classifier(spark, folder), "text").select("term", "df", _r6("idf"))


def tfidf_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return features.tfidf(_classifier(spark, folder), "row_id", "text").select("row_id", "term", _r6("w"))


def idf_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = features.idf_stats(features.smoothed_idf(_classifier(spark, folder), "text"))
    return stats.select(_r6("avg_idf"), _r6("min_idf"), _r6("max_idf"), "vocabulary_size")


def top_terms(spark: SparkSession, folder: str) -> DataFrame:
    return features.top_terms(_classifier(spark, folder), "text").select("term", _r6("tf"), "place")


def top_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return features.top_vocabulary(features.vocabulary(_classifier(spark, folder), "row_id", "text"))


def first_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _classifier(spark, folder)
    return features.first_vocabulary(rows, "row_id", "text", features.smoothed_idf(rows, "text")).select("term", _r6("idf"), "place")


def training_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = features.training_summary(_classifier(spark, folder), "text", "sentiment")
    return out.select("vocabulary_size", "total_documents", _r6("avg_idf"), _r6("min_idf"), _r6("max_idf"), "n_labels")


def label_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Of the sampled training labels."""
    return features.label_histogram(stratified_sample(spark, folder), "label")


def sentiment_filter(spark: SparkSession, folder: str) -> DataFrame:
    return labelling.by_sentiment(table(spark, folder, "labelled"), "sentiment", "positif").select("row_id", "sentiment")


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labelled").where("raw IS NOT NULL").select("row_id", T.sentiment_synonym(F.col("sentiment")).alias("label"))
    return features.stratified_sample(rows, "row_id", "label", SAMPLE_ROWS)


# evaluation


def _counted(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    rows = table(spark, folder, "predictions")
    return evaluate.cells(rows.withColumn("method", T.clean_label(F.col("method_name"))), "actual_label", "predicted_label", by)


def class_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.class_metrics(_counted(spark, folder, ("method",)), ("method",))
    return out.select("method", "label", "tp", "fp", "fn", _r6("precision"), _r6("recall"), _r6("f1_score"))


def macro_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.method_metrics(_counted(spark, folder))
    return out.select("sample_count", "correct", _r6("accuracy"), _r6("precision"), _r6("recall"), _r6("f1_score"))


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion(_counted(spark, folder, ("method",)), ("method",))


def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.confusion_metrics(evaluate.confusion(_counted(spark, folder)))
    return out.select("label", _r6("precision"), _r6("recall"), _r6("f1_score"), _r6("accuracy"), "correct", "incorrect")


def _methods(spark: SparkSession, folder: str) -> DataFrame:
    metrics = evaluate.method_metrics(_counted(spark, folder, ("method",)), ("method",))
    rows = table(spark, folder, "predictions").withColumn("method", T.clean_label(F.col("method_name")))
    seen = rows.groupBy("method").agg(F.min("row_id").alias("first_seen"))
    return metrics.join(seen, "method")


def compare_methods(spark: SparkSession, folder: str) -> DataFrame:
    out = evaluate.compare(_methods(spark, folder), "method", "first_seen")
    return out.select("method", "sample_count", _r6("accuracy"), _r6("precision"), _r6("recall"), _r6("f1_score"), "place")


def best_method(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.best_method(_methods(spark, folder), "method", "first_seen").select("best_method", _r6("best_accuracy"))


def evaluation_report(spark: SparkSession, folder: str) -> DataFrame:
    methods = cut_lineage(_methods(spark, folder))
    best = evaluate.best_method(methods, "method", "first_seen")
    matrix = evaluate.confusion(_counted(spark, folder))
    out = evaluate.report(evaluate.compare(methods, "method", "first_seen"), "method", best, matrix, "all methods")
    return out.select("section", "line", F.array_join("cells", ",").alias("cells"))


# models


def _training(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labelled").where((F.col("split") == "train") & F.col("raw").isNotNull() & F.col("sentiment").isNotNull())
    return spread(rows.select("row_id", "raw", T.sentiment_synonym(F.col("sentiment")).alias("label")))


def _testing(spark: SparkSession, folder: str) -> DataFrame:
    """Every row with text of the other splits; the label may be missing."""
    rows = table(spark, folder, "labelled").where(F.col("split").isin("test", "valid") & F.col("raw").isNotNull())
    label = F.when(F.col("sentiment").isNotNull(), T.sentiment_synonym(F.col("sentiment")))
    return spread(rows.select("row_id", "raw", label.alias("actual_label")))


def _classified(spark: SparkSession, folder: str) -> tuple[DataFrame, str | None]:
    test = _testing(spark, folder)
    found, error = model.classified(_training(spark, folder), test, "row_id", "raw", "label")
    return test.join(found, "row_id"), error


def svm_predict(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder)[0].select("row_id", "actual_label", "predicted_label", "confidence")


def svm_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Per-class metrics of the classifier on the labelled rows of the held-out splits."""
    rows = svm_predict(spark, folder).where("actual_label IS NOT NULL")
    return evaluate.class_metrics(evaluate.cells(rows, "actual_label", "predicted_label"))


def svm_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Training summary, accuracy over all test rows and macro metrics of the classifier."""
    scored, error = _classified(spark, folder)
    train = _training(spark, folder).select(T.classifier_text(F.col("raw")).alias("text"), "label")
    return model.summary(spark, train, "text", "label", scored, "actual_label", error)


def stored_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy, correct and wrong counts of stored predictions by method, rows without an actual label being wrong."""
    rows = table(spark, folder, "predictions")
    named = rows.select(*[T.clean_label(F.col(c)).alias(c) for c in ("method_name", "actual_label", "predicted_label")])
    out = model.accuracy(named, "actual_label", "predicted_label", ("method_name",))
    return out.select("method_name", "total_samples", "correct_predictions", "wrong_predictions", _r6("accuracy"))


def cosine_knn(spark: SparkSession, folder: str) -> DataFrame:
    out = model.cosine_neighbours(_training(spark, folder), _testing(spark, folder), "row_id", "raw", "label", max_train=SAMPLE_ROWS)
    return out.select("row_id", "predicted_label", _r6("confidence"))


# sources, sinks, columns


def _written(spark: SparkSession, write, *rows: DataFrame) -> str:
    place = shared_place(spark, "sink")
    write(*rows, place)
    return place


def _source_file(spark: SparkSession, folder: str) -> str:
    """The reviews as files with a header, in the order of their ids, some names and cells with blanks around them."""
    rows = table(spark, folder, "raw_reviews").select("row_id", F.col("ulasan").alias(" ulasan "), F.concat(F.lit("  "), "app_id", F.lit(" ")).alias("app_id"), "source")
    return _written(spark, files.write_csv, rows.orderBy("row_id"))


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = files.read_csv(spark, _source_file(spark, folder))
    return rows.select("row_id", F.col("` ulasan `").alias("ulasan"), "app_id", "source")


def csv_scan_trimmed(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_csv(spark, _source_file(spark, folder), trim=True).select("row_id", "ulasan", "app_id", "source")


def csv_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of the file, as many as the classifier's preview shows."""
    return files.read_csv(spark, _source_file(spark, folder), limit=files.PREVIEW_ROWS["classification"]).select("row_id", "app_id")


def result_store(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows stored as JSON and loaded again."""
    rows = table(spark, folder, "labelled").select("row_id", "raw", "sentiment", "confidence")
    return files.read_results(spark, _written(spark, lambda df, path: files.write_results(df, path, "json"), rows), "json").select(*rows.columns)


def result_removal(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a stored result is removed, and whether it is still there to be removed again."""
    place = _written(spark, files.write_results, table(spark, folder, "predictions"))
    removed = [files.remove_results(spark, place) for _ in range(2)]
    return spark.range(1).select(F.lit(removed[0]).alias("removed"), F.lit(removed[1]).alias("removed_again"))


def sink_preprocessed(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_csv(spark, _written(spark, files.write_preprocessed, preprocess_labelled(spark, folder)))


def sink_labelled(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelling.auto_label(_reviews(spark, folder), "ulasan")
    back = files.read_csv(spark, _written(spark, files.write_labelled, rows))
    return back.select("raw", "sentiment", F.col("confidence").cast("double").alias("confidence")).select("raw", "sentiment", _r6("confidence"))


def sink_predictions(spark: SparkSession, folder: str) -> DataFrame:
    back = files.read_csv(spark, _written(spark, files.write_predictions, table(spark, folder, "predictions")))
    number = F.when(F.col("confidence") != "", F.col("confidence").cast("double"))
    return back.select("text", "actual_label", "predicted_label", number.alias("confidence"))


def sink_report(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of the written evaluation report, in the order of the file."""
    out = evaluation_report(spark, folder)
    place = _written(spark, files.write_report, out.select("section", "line", F.split("cells", ",").alias("cells")))
    lines = spark.read.text(place).select(F.monotonically_increasing_id().alias("line"), "value")
    return lines.select("line", F.replace(F.col("value"), F.lit('"'), F.lit("")).alias("value"))


def column_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What the column rules make of each table: one row a table."""
    rows = []
    for name in RULED_TABLES:
        df = table(spark, folder, name)
        c = df.columns
        rows.append((
            name, ",".join(schema.drop_by_keyword(df).columns), schema.exact_text_column(c), schema.exact_text_column(c, schema.LABELLING_TEXT),
            schema.containing_text_column(c), schema.containing_label_column(c), schema.find_by_column(c, ("text", "raw", "sentiment", "label")),
            schema.find_by_name(c, ("text", "raw", "sentiment", "label")), schema.is_labelled(c), schema.missing(c) == [], *schema.review_columns(c),
        ))
    names = ("kept", "preprocess_text", "labelling_text", "classifier_text", "classifier_label", "by_column", "by_name")
    kinds = ", ".join(f"{n} string" for n in ("table_name", *names))
    return spark.createDataFrame(rows, f"{kinds}, is_labelled boolean, is_complete boolean, review_label string, review_text string")


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "preprocessing_files").select("id", T.base_name(F.col("path")).alias("name"))


def first_seen_labels(spark: SparkSession, folder: str) -> DataFrame:
    return features.first_seen_labels(_training(spark, folder), "label", "row_id")


# streams


def stream_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of sentiment_label, by a stream over the table's files."""
    place = shared_place(spark, "stream")
    stream = reviews.read_reviews(spark, f"{folder}/raw_reviews.parquet*", table(spark, folder, "raw_reviews"))
    labelled = reviews.label_stream(stream, "ulasan", ("row_id",)).select("row_id", "sentiment", _r6("confidence"))
    reviews.drain(labelled, f"{place}/out", f"{place}/state")
    return spark.read.schema(labelled.schema).parquet(f"{place}/out")


# loading


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejected_lines(table(spark, folder, "upload_lines"), "line_id", "line")


def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.loaded_rows(table(spark, folder, "upload_lines"), "line_id", "line")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.reject_report(table(spark, folder, "upload_lines"), "line_id", "line", "file_id")


def queries() -> dict[str, Query]:
    stages = {
        "case_fold": "case_folding", "cleanse": "cleansing", "normalize_slang": "normalisasi",
        "tokenize": "tokenizing", "remove_stopwords": "filtering", "stem": "stemming",
    }
    named = (
        sentiment_distribution, sentiment_label, strict_label, sentiment_distribution_by_lang, review_distribution, dominance_verdict,
        confidence_bars, distribution_bars, analyze_service, preprocess_full, preprocess_labelled, wrangle_keep_first,
        wrangle_removed_count, strict_cleansing, paginate, page_summary, bulk_edit, learned_keywords, classifier_text,
        document_frequency, smoothed_idf, tfidf_vectors, idf_stats, top_terms, top_vocabulary, first_vocabulary, training_summary,
        label_histogram, sentiment_filter, svm_metrics, svm_summary, stored_accuracy, stratified_sample, class_metrics,
        macro_metrics, confusion_matrix, confusion_metrics, compare_methods, best_method, evaluation_report, svm_predict,
        cosine_knn, edit_summary, csv_scan, csv_scan_trimmed, csv_preview, result_store, result_removal, sink_preprocessed,
        sink_labelled, sink_predictions, sink_report, column_rules, file_names, first_seen_labels, stream_sentiment, p6_found, p6_loaded, p6_report,
    )
    return {f.__name__: f for f in named} | {name: _stage(column) for name, column in stages.items()}
