"""Golden rows of the text stages and of the sentiment scores."""

import pytest

from senarai.functions import lexicons, sentiment
from senarai.operators import labelling, preprocess

GOLDEN = [
    ("RT @user cek http://a.co/x Aplikasi BAGUS!!! 😀", "cek aplikasi bagus!", "cek aplikasi bagus!", "cek aplikasi bagus!", "cek aplikas bagus!"),
    ("gak bisa pinjol, bungaaa 1.000.000", "gak bisa pinjol, bungaaa 1.000.000", "tidak bisa pinjol, bunga 1.0.0", "pinjol, bunga 1.0.0", "pinjol, bunga 1.0.0"),
    ("Pelayanan cepet & mudah bgt", "pelayanan cepet & mudah bgt", "pelayanan cepat & mudah banget", "pelayanan cepat mudah", "layan cepat mudah"),
    ('"sangat" membantu... #pinjol makasih', "sangat membantu. makasih", "sangat membantu. makasih", "membantu.", "bantu."),
    ("hub: a.b@c.co via WA ya", "hub: wa ya", "hub: wa ya", "hub:", "hub:"),
    ("Pencairan gagal terus, kecewa", "pencairan gagal terus, kecewa", "cair gagal terus, kecewa", "cair gagal terus, kecewa", "cair gagal terus, kecewa"),
    ("di ke dari", "di ke dari", "di ke dari", "", ""),
    ("ok", "", "", "", ""),
    ("", "", "", "", ""),
    (None, "", "", "", ""),
]


def test_stages(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, t string")
    rows = {r.id: r for r in preprocess.stages(df, "t", ("id",)).collect()}
    for i, (_, clean, normal, kept, stem) in enumerate(GOLDEN):
        r = rows[i]
        assert (r.cleansing, r.normalisasi, r.filtering, r.stemming) == (clean, normal, kept, stem)
        assert r.tokenizing == r.normalisasi


def test_wrangle_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "a b "), (1, "a b"), (2, "A B"), (4, ""), (5, None)], "ord int, stemming string")
    assert [tuple(r) for r in preprocess.wrangle(df, "ord").collect()] == [(1, "a b")]
    counts = preprocess.removed_counts(df).first()
    assert (counts.n_before, counts.n_after, counts.n_removed) == (5, 1, 4)
    assert preprocess.wrangle(df.limit(0), "ord").count() == 0


SCORES = [
    ("aplikasi bagus", "positif", 0.051571), ("pokok", "netral", 0.038701), ("ok sekali", "positif", 0.050015),
    ("bagus sekali", "positif", 0.066622), ("terbaik", "positif", 0.115413), ("sangat bagus", "negatif", -0.110492),
    ("sangat buruk", "positif", 0.110492), ("juga bagus", "netral", -0.009553), ("tidak bagus", "netral", -0.009553),
    ("tidak buruk", "netral", 0.038186), ("harga mahal", "netral", 0.038186), ("buruk", "negatif", -0.051571),
    ("Pencairan lambat, kecewa", "negatif", -0.102733), ("biasa", "netral", 0.0), ("mungkin", "netral", -0.028648),
    ("mungkin bagus", "netral", -0.066724),
]


def test_scores(spark):
    df = spark.createDataFrame([(t,) for t, *_ in SCORES] + [("0",), ("",), ("  ",), (None,)], "t string")
    rows = {r.raw: r for r in labelling.auto_label(df, "t").collect()}
    assert len(rows) == len(SCORES)
    for t, label, score in SCORES:
        assert rows[t].sentiment == label
        assert rows[t].confidence == pytest.approx(score, abs=1e-6)


def test_strict_labels_match_whole_words(spark):
    df = spark.createDataFrame([("sangat bagus",), ("harga bagus",), ("tidak",)], "t string")
    rows = {r.t: r.strict_sentiment for r in sentiment.strict_labels(df, "t").collect()}
    assert rows == {"sangat bagus": "positif", "harga bagus": "positif", "tidak": "netral"}


def test_distribution_and_verdict(spark):
    df = spark.createDataFrame([("positif",), ("positif",), (None,), ("lain",)], "sentiment string")
    d = labelling.distribution(df)
    assert tuple(d.first()) == (2, 0, 1, 4, 50.0, 0.0, 25.0)
    assert labelling.dominance(d).first().verdict == "positif"
    r = labelling.review_distribution(spark.createDataFrame([(" Positive",), ("x",), (None,), ("NEGATIF",)], "s string"), "s").first()
    assert (r.positif, r.negatif, r.netral, r.total) == (1, 1, 2, 4)
    empty = labelling.distribution(df.limit(0)).first()
    assert empty.total == 0 and empty.positif_percentage == 0.0


def test_service_answer(spark):
    df = spark.createDataFrame([(1, None), (2, "bagus"), (3, " ")], "id int, t string")
    rows = {r.id: r for r in labelling.analyze(df, "t", ("id",)).collect()}
    assert rows[1].original_text == rows[3].original_text == "Saya merasa netral tentang topik ini."
    assert rows[2].label == "positive" and rows[2].translated_text == "bagus"


def test_tables_have_no_repeats():
    assert len(set(lexicons.STOPWORDS)) == len(lexicons.STOPWORDS)
    phrases = [p for ps in lexicons.VALENCES.values() for p in ps]
    assert len(set(phrases)) == len(phrases)


def test_word_tables_hold_what_they_must():
    """Sizes and a few entries of each table, so that a lost or changed word is seen; the SQL shares the tables."""
    sizes = (len(lexicons.SLANG), sum(map(len, lexicons.VALENCES.values())), len(lexicons.INTENSIFIERS), len(lexicons.NEGATIONS))
    assert sizes == (138, 165, 10, 16)
    assert {lexicons.SLANG[k] for k in ("gak", "bgt")} == {"tidak", "banget"}
    assert "bagus" in lexicons.VALENCES[0.20] and "gagal" in lexicons.VALENCES[-0.20] and "tidak bagus" in lexicons.VALENCES[-0.15]
    assert len({p for ps in lexicons.VALENCES.values() for p in ps}) == 165 and {"yang", "dan"} <= set(lexicons.STOPWORDS) and len(set(lexicons.STOPWORDS)) == 154
