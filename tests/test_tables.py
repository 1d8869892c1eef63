"""Column resolution, files, pages, corrections, features, metrics."""

import math
from types import SimpleNamespace

import numpy as np
import pytest

from senarai import session
from senarai.operators import evaluate, features, heavy, labelling, model
from senarai.sources import files, schema


def test_columns():
    assert schema.exact_text_column(["a", " Text "]) == " Text "
    assert schema.exact_text_column(["a", "b"]) == "b"
    assert schema.containing_text_column(["id", "my_text"]) == "my_text"
    assert schema.containing_label_column(["a", "b"]) == "b"
    assert schema.containing_label_column(["a"]) is None
    assert schema.find_by_column(["label", "sentiment"], ["sentiment", "label"]) == "label"
    assert schema.find_by_name(["label", "sentiment"], ["sentiment", "label"]) == "sentiment"
    assert schema.is_labelled(["RAW", "Label"]) and not schema.is_labelled(["raw"])
    assert schema.review_columns(["x", "label"]) == ("label", "x")
    with pytest.raises(schema.SchemaError):
        schema.require(["text", "actual_label"])


def test_drop_by_keyword(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["ulasan", "Rating", "created.at", "nama"])
    assert schema.drop_by_keyword(df).columns == ["ulasan", "nama"]


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿ulasan,label\n"a ""b"", c\nd",positif\nx\n', encoding="utf-8")
    df = files.read_csv(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [('a "b", c\nd', "positif"), ("x", "")]
    files.write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).collect()] == [tuple(r) for r in df.collect()]
    files.write_results(df, str(tmp_path / "store"), "json")
    assert files.read_results(spark, str(tmp_path / "store"), "json").count() == 2
    with pytest.raises(ValueError):
        files.check_upload("a.pdf")


def test_pages_and_edits(spark):
    df = spark.createDataFrame([(i * 3, "netral", 0.1) for i in range(250)], "id int, sentiment string, confidence double").repartition(5)
    rows = labelling.numbered(df, "id")
    assert sorted((r.id, r.pos) for r in rows.collect()) == [(i * 3, i) for i in range(250)]
    assert [r.pos for r in labelling.page(rows, 3, 250).orderBy("pos").collect()] == list(range(200, 250))
    assert sorted((r.id, r.pos) for r in labelling.page_of(df, "id", 3, 250).collect()) == [(i * 3, i) for i in range(200, 250)]
    for page in (lambda n: labelling.page(rows, n, 250), lambda n: labelling.page_of(df, "id", n, 250)):
        for n in (0, 4):
            with pytest.raises(ValueError):
                page(n)
    edits = spark.createDataFrame([(1, 0, "positif"), (2, 5, "negatif"), (9, 9, "positif")], "page int, row int, label string")
    edited = {r.pos: (r.sentiment, r.confidence) for r in labelling.bulk_edit(rows, edits).collect()}
    assert edited[0] == ("positif", 1.0) and edited[105] == ("negatif", 1.0) and edited[1] == ("netral", 0.1) and len(edited) == 250
    assert labelling.numbered(df.limit(0), "id").count() == 0


def test_learned_keywords(spark):
    df = spark.createDataFrame([("bagus bagus yang ok", "positif"), ("bagus", "negatif"), (None, "netral")], "t string, s string")
    assert [tuple(r) for r in labelling.learned_keywords(df, "t", "s").collect()] == [("positif", "bagus", 2)]


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "bagus cepat bagus"), (2, "buruk lambat"), (3, "bagus a"), (4, ""), (5, None)], "id int, t string")
    idf = {r.term: r.idf for r in features.smoothed_idf(df.where("id < 4"), "t").collect()}
    assert idf == pytest.approx({"bagus": math.log(4 / 3) + 1, "cepat": math.log(2) + 1, "buruk": math.log(2) + 1, "lambat": math.log(2) + 1})
    w = {(r.id, r.term): r.w for r in features.tfidf(df.where("id < 4"), "id", "t").collect()}
    expected = {(1, "bagus"): 0.835592, (1, "cepat"): 0.549351, (2, "buruk"): 0.707107, (2, "lambat"): 0.707107, (3, "bagus"): 1.0}
    assert w == pytest.approx(expected, abs=1e-6)
    assert features.tfidf(df.limit(0), "id", "t").count() == 0


def test_stratified_sample(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(100)], "id int, label string")
    rows = features.stratified_sample(df, "id", "label", 30).collect()
    assert len(rows) == 30 == len({r.id for r in rows})
    assert sum(r.label == "b" for r in rows) == 10
    assert features.stratified_sample(df, "id", "label", 300).count() == 100


PAIRS = [("positif", "positif"), ("positif", "negatif"), ("negatif", "negatif"), ("Netral ", "netral"), ("negatif", "netral"), ("positif", "unknown"), ("lain", "positif"), ("netral", "netral")]


def test_metrics(spark):
    counted = evaluate.cells(spark.createDataFrame(PAIRS, "a string, p string"), "a", "p")
    got = {r.label: (r.tp, r.fp, r.fn, round(r.precision, 6), round(r.recall, 6), round(r.f1_score, 6)) for r in evaluate.class_metrics(counted).collect()}
    assert got == {"positif": (1, 1, 2, 0.5, 0.333333, 0.4), "negatif": (1, 1, 1, 0.5, 0.5, 0.5), "netral": (2, 1, 0, 0.666667, 1.0, 0.8)}
    m = evaluate.method_metrics(counted).first()
    assert (m.accuracy, round(m.precision, 6), round(m.recall, 6), round(m.f1_score, 6)) == (0.5, 0.555556, 0.611111, 0.566667)
    matrix = evaluate.confusion(counted)
    cells = {(r.actual, r.predicted): r.n for r in matrix.collect()}
    assert sum(cells.values()) == 6 and len(cells) == 9 and cells["positif", "negatif"] == 1
    derived = {r.label: (r.precision, r.recall, r.incorrect) for r in evaluate.confusion_metrics(matrix).collect()}
    assert derived["positif"] == (1.0, 0.5, 4)


def test_ranking_ties_and_zeros(spark):
    m = spark.createDataFrame([("x", 0.5, 2), ("y", 0.5, 1), ("z", 0.0, 0)], "method string, accuracy double, first_seen int")
    assert [r.method for r in evaluate.compare(m, "method", "first_seen").orderBy("place").collect()] == ["y", "x", "z"]
    assert evaluate.best_method(m, "method", "first_seen").first().best_method == "y"
    none = evaluate.best_method(m.where("accuracy = 0"), "method", "first_seen").first()
    assert none.best_method is None and none.best_accuracy == 0.0


def test_join_key_stats_equals_a_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 7}") for i in range(200)] + [(999, None)], "id int, k string")
    stats = rows.where("k IS NOT NULL").groupBy("k").count()
    got = sorted((r.id, r["count"]) for r in heavy.join_key_stats(rows, stats, "k", "count", heavy_keys=2).collect())
    assert got == sorted((r.id, r["count"]) for r in rows.join(stats, "k").collect())


def test_neighbours_and_machines(spark):
    texts = [(i, ("bagus cepat mudah " if i % 2 else "buruk lambat gagal ") + f"kata{i % 3}", "positif" if i % 2 else "negatif") for i in range(40)]
    df = spark.createDataFrame(texts, "id int, t string, label string")
    found = {r.id: (r.predicted_label, r.confidence) for r in model.train_one_vs_rest(df, "id", "t", "label").predict(df, "id", "t").collect()}
    assert all(found[i][0] == y for i, _, y in texts) and all(0 <= c <= 1 for _, c in found.values())
    near = {r.id: r.predicted_label for r in model.cosine_neighbours(df, df, "id", "t", "label").collect()}
    assert near == {i: y for i, _, y in texts}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\U0001f600"), (4, "asing")], "id int, t string")
    assert {(r.predicted_label, r.confidence) for r in model.cosine_neighbours(df, odd, "id", "t", "label").collect()} == {("netral", 0.0)}
    assert model.train_one_vs_rest(df, "id", "t", "label").predict(odd, "id", "t").count() == 4
    for bad in (df.limit(0), df.where("label = 'positif'")):
        with pytest.raises(model.ModelError):
            model.train_one_vs_rest(bad, "id", "t", "label")


def test_any_number_of_labels(spark):
    many = spark.createDataFrame([(i, f"kata{i % 101} lain", f"l{i % 101}") for i in range(303)], "id int, t string, label string")
    trained = model.train_one_vs_rest(many, "id", "t", "label", max_train=303)
    assert trained.labels == [f"l{i}" for i in range(101)] and len(trained.weights) == len(trained.scales) == 101
    more = spark.createDataFrame([(i, f"l{i % 1_001}") for i in range(3_003)], "id int, label string")
    assert {r.label for r in features.stratified_sample(more, "id", "label", 500).collect()} == {f"l{i}" for i in range(1_001)}


def test_machines_reach_the_optimum():
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 5))
    y = np.where(x @ r.normal(size=(5, 2)) + r.normal(size=(60, 2)) > 0, 1.0, -1.0)
    whole = np.hstack([x, np.ones((60, 1))])
    loss = lambda w: (w * w).sum(axis=1) / 2 + np.maximum(0, 1 - y * (whole @ w.T)).sum(axis=0)
    w = model.hinge_machines(x, y)
    best = loss(w)
    for _ in range(200):
        assert (loss(w + r.normal(scale=0.05, size=w.shape)) > best - 1e-2).all()
    a, b = model.sigmoid_scale(np.array([-2.0, -1, -1, 1, 1, 2]), np.array([False, False, True, False, True, True]))
    assert a > 0 and abs(b) < 0.5


def test_failed_rows_and_trainings(spark):
    df = spark.createDataFrame([(1, "bagus", "positif"), (2, "bagus", "positif")], "id int, t string, label string")
    found, error = model.classified(df, df, "id", "t", "label")
    assert found.count() == 0 and "label" in error
    row = model.summary(spark, df, "t", "label", found, "label", error).first()
    assert row.error == error and row.accuracy == 0.0 and row.vocabulary_size == 0.0
    shared = spark.sparkContext.broadcast(({"bagus": 1.0}, None))

    def score(weights, _):
        return ("ja", 1 / len(weights))

    texts = spark.createDataFrame([(1, "bagus"), (2, "asing")], "id int, t string")
    assert {(r.id, r.predicted_label, r.confidence) for r in model._scored(texts, "id", "t", shared, score).collect()} == {(1, "ja", 1.0), (2, "error", 0.0)}
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), ("0", "0")], "x string, y string")
    assert tuple(model.accuracy(rows, "x", "y").first()) == (4, 1, 3, 0.25)


def test_vocabulary_ties_by_first_sight(spark):
    df = spark.createDataFrame([(2, "aa cc bb"), (1, "zz bb"), (3, None)], "id int, t string")
    top = [(r.term, r.df, r.place) for r in features.top_vocabulary(features.vocabulary(df, "id", "t"), 3).orderBy("place").collect()]
    assert top == [("zz", 1, 1), ("bb", 2, 2), ("aa", 1, 3)]


def test_large_vocabularies_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "bagus cepat bagus"), (2, "buruk lambat"), (3, "bagus a"), (4, ""), (5, None)], "id int, t string")
    small = {(r.id, r.term): r.w for r in features.tfidf(df, "id", "t").collect()}
    monkeypatch.setattr(features, "broadcast_idf", lambda *_: None)
    assert {(r.id, r.term): r.w for r in features.tfidf(df, "id", "t").collect()} == pytest.approx(small)


def test_edits_are_checked_and_the_last_counts(spark):
    rows = spark.createDataFrame([(i, "netral", 0.1) for i in range(3)], "pos long, sentiment string, confidence double")
    data = [(1, 0, "positif", 1), (1, 0, "negatif", 2), (1, 1, "bagus", 3), (0, 1, "positif", 4), (1, -1, "positif", 5), (1, 1, None, 6), (1, 9, "netral", 7)]
    edits = spark.createDataFrame(data, "page int, row int, label string, turn int")
    assert sorted(tuple(r) for r in labelling.bulk_edit(rows, edits, order="turn").collect()) == [(0, "negatif", 1.0), (1, "netral", 0.1), (2, "netral", 0.1)]
    assert tuple(labelling.edit_summary(rows, edits).first()) == (7, 4, 1)


def test_salted_join_equals_a_join(spark):
    left = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3), (None, 4)], "k string, x int")
    right = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(200)] + [(None, 999)], "k string, y int")
    for bound in (10, 1_000):
        got = sorted(tuple(r) for r in heavy.salted_join(left, right, "k", bound).select("k", "x", "y").collect())
        assert got == sorted(tuple(r) for r in left.join(right, "k").select("k", "x", "y").collect())


def test_unusable_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "t string, l string")
    assert schema.usable(df, "t").count() == 1
    for args in ((df, None), (df, "x"), (df.limit(0), "t"), (df, "t", "l"), (df, "t", "x")):
        with pytest.raises(schema.SchemaError):
            schema.usable(*args)
    with pytest.raises(schema.SchemaError):
        files.read_csv(spark, str(tmp_path / "nothing.csv"))


def test_preview_is_the_first_rows(spark, tmp_path):
    rows = spark.range(1_000).selectExpr("cast(id AS string) AS n", "repeat('x', cast(1000 - id AS int)) AS t").repartitionByRange(5, "t").sortWithinPartitions("n")
    files.write_csv(rows, str(tmp_path / "out"))
    whole = [r.n for r in spark.read.csv(sorted(map(str, (tmp_path / "out").glob("*.csv")))[0], header=True).select("n").collect()]
    assert [r.n for r in files.read_csv(spark, str(tmp_path / "out"), limit=7).collect()] == whole[:7]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(" a, \"b\"\n", None, "positif", 0.5)], "text string, actual_label string, predicted_label string, confidence double")
    files.write_predictions(df, str(tmp_path / "p"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "p")).collect()] == [(' a, "b"\n', "", "positif", "0.5")]
    done = spark.createDataFrame([("bagus", "positif")], "stemming string, sentiment string")
    files.write_preprocessed(done, str(tmp_path / "s"))
    assert files.read_csv(spark, str(tmp_path / "s")).columns == ["preprocessed", "sentiment"]
    files.write_preprocessed(done.drop("sentiment"), str(tmp_path / "s"))
    assert files.read_csv(spark, str(tmp_path / "s")).columns == ["preprocessed"]
    lines = spark.createDataFrame([(1, 0, ["x y", "1"]), (0, 0, ["a"])], "section int, line int, cells array<string>")
    files.write_report(lines, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["a", '"x y",1']


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://x", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf={}))
