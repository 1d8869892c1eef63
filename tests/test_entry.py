"""The driver contract holds with and without the training-data subpackage, and streams equal batches."""

import os

import pytest

import __spark_entry__ as entry
from senarai.operators import labelling
from senarai.streaming import reviews

FOLDER = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"sentiment_distribution", "p6_found"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"bagus {i}" if i % 2 else "buruk", "2025-01-01 00:00:00") for i in range(20)], "id int, t string, at string")
    rows = rows.withColumn("at", rows["at"].cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = reviews.label_stream(reviews.read_reviews(spark, str(tmp_path / "in"), rows), "t", ("id",))
    reviews.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    key = lambda df: sorted((r.id, r.sentiment) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(labelling.auto_label(rows, "t", ("id",)))


def test_stream_drops_repeats_and_counts_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "bagus"), (2, "Bagus "), (3, "buruk")], "id int, t string").selectExpr("*", "timestamp'2025-01-01 10:00:00' AS at")
    rows.write.parquet(str(tmp_path / "in"))
    done = reviews.preprocess_stream(reviews.read_reviews(spark, str(tmp_path / "in"), rows), "t", "at", ("id",))
    reviews.drain(done, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    counts = reviews.windowed_labels(reviews.read_reviews(spark, str(tmp_path / "in"), rows), "t", "at")
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.sentiment, r.n) for r in spark.table("windows").collect()} == {("positif", 2), ("negatif", 1)}
