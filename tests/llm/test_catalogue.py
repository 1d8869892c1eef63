"""The catalogued queries cover every table that TESTDATA names for them."""

from senarai.llm import catalogue

from test_models import _profiles


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_scores_of_both_tables(spark, tmp_path):
    _write(spark, tmp_path, "labelled", [(1, "bagus bagus sekali"), (2, "sekali")], "row_id bigint, raw string")
    _write(spark, tmp_path, "documents", [(1, "panjang " * 1_000 + "sekali"), (2, "sekali"), (3, None)], "doc_id bigint, text string")
    got = {(r.src, r.row_id, r.term): (r.tf, r.df) for r in catalogue.queries()["p2_scores"](spark, str(tmp_path)).collect()}
    assert got == {
        ("labelled", 1, "bagus"): (2, 1), ("labelled", 1, "sekali"): (1, 2), ("labelled", 2, "sekali"): (1, 2),
        ("documents", 1, "panjang"): (1_000, 1), ("documents", 1, "sekali"): (1, 2), ("documents", 2, "sekali"): (1, 2),
    }


def test_both_tables_are_redacted(spark, tmp_path):
    _write(spark, tmp_path, "name_list", [("Budi",)], "person_name string")
    _write(spark, tmp_path, "raw_reviews", [(1, "kirim ke a@b.id"), (2, None)], "row_id bigint, ulasan string")
    _write(spark, tmp_path, "labelled", [(1, "kirim ke c@d.id"), (2, "bagus")], "row_id bigint, raw string")
    got = {(r.src, r.row_id): (r.text, r.n_spans) for r in catalogue.p1_redacted(spark, str(tmp_path)).collect()}
    sent = ("kirim ke [EMAIL]", 1)
    assert got == {("raw_reviews", 1): sent, ("raw_reviews", 2): (None, 0), ("labelled", 1): sent, ("labelled", 2): ("bagus", 0)}


def test_segments_of_both_tables_and_inside_sentences(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "_profiles", lambda *_: _profiles())
    halves = "petugas sangat membantu keluarga kami setiap hari ", "The service was much faster than expected by all"
    run_on = "".join(halves)
    _write(spark, tmp_path, "raw_reviews", [(1, run_on, None)], "row_id bigint, ulasan string, lang string")
    _write(spark, tmp_path, "documents", [(1, halves[1] + ". " + run_on, None)], "doc_id bigint, text string, lang string")
    rows = catalogue.p4_segments(spark, str(tmp_path)).orderBy("src", "start").collect()
    texts = {"raw_reviews": run_on, "documents": halves[1] + ". " + run_on}
    got = [(r.src, r.lang, texts[r.src][r.start : r.end].strip()) for r in rows]
    pair = [("id", halves[0].strip()), ("en", halves[1])]
    assert got == [("documents", "en", halves[1] + "."), *(("documents", *p) for p in pair), *(("raw_reviews", *p) for p in pair)]
    assert all(r.confidence > 0.5 for r in rows)
