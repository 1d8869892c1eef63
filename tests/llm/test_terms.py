"""Term frequencies, term scores and form copies against brute force."""

import math
import re
from collections import Counter

from senarai.llm import formcopies, ridf, termfreq, words

TEXTS = ["Bagus bagus BAGUS sekali", "bagus é É 12 x2y", None, "", "😀 !!", "İstanbul ΑΣ'Α Σ", "kata " * 5_000 + "akhir", "bagus bagus bagus", "sekali"]


def table(spark):
    # columns that clash with the operator's own names must not matter
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)], "id bigint, t string, term string, df int")


def brute():
    return {i: Counter(words.terms_of(t)) for i, t in enumerate(TEXTS) if t is not None}


def test_terms():
    assert words.terms_of("Ab1é_C") == ["ab", "é", "c"]
    assert words.words_of("Ab1é_C²") == ["ab1é", "c²"]


def test_frequencies(spark):
    got = {r.term: (r.cf, r.df) for r in termfreq.term_frequencies(table(spark), "t").collect()}
    cf, df = Counter(), Counter()
    for c in brute().values():
        cf.update(c)
        df.update(c.keys())
    assert got == {t: (cf[t], df[t]) for t in cf}
    assert termfreq.term_frequencies(table(spark).limit(0), "t").count() == 0


def test_marks(spark):
    rows = [(i, "umum " + ("kadang " if i < 3 else "") + ("jarang" if i == 0 else "")) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    got = {r.term: r.mark for r in termfreq.marked_terms(df, "t").collect()}
    assert got == {"umum": "common", "kadang": "common", "jarang": "rare"}


def test_scores(spark):
    got = {(r.row_id, r.term): r for r in ridf.term_scores(table(spark), "id", "t").collect()}
    counts = brute()
    n = len(counts)
    for i, c in counts.items():
        for t, tf in c.items():
            cf, df = sum(x[t] for x in counts.values()), sum(t in x for x in counts.values())
            expected = -math.log2(df / n) + math.log2(1 - math.exp(-cf / n))
            assert got[i, t].tf == tf and abs(got[i, t].ridf - expected) < 1e-5
            assert abs(got[i, t].score - tf * expected) < 1e-2 * tf
    assert len(got) == sum(map(len, counts.values()))
    some = {(r.row_id, r.term) for r in ridf.term_scores(table(spark), "id", "t", min_tf=3, min_df=2, max_df=20).collect()}
    assert some == {(0, "bagus"), (7, "bagus")}
    assert ridf.term_scores(table(spark).limit(0), "id", "t").count() == 0


def test_a_term_of_every_record_is_joined_where_the_records_lie(spark):
    df = spark.createDataFrame([(i, f"umum umum umum kata{'abcdefghijklmnopqrstuvwxy'[i % 25]}") for i in range(500)], "id bigint, t string").repartition(4)
    rows = ridf.term_scores(df, "id", "t").collect()
    assert len(rows) == 1_000 and {(r.tf, r.df, r.cf) for r in rows if r.term == "umum"} == {(3, 500, 1_500)}
    assert {(r.tf, r.df, r.cf) for r in rows if r.term != "umum"} == {(1, 20, 20)}
    assert {(r.row_id, r.term) for r in ridf.term_scores(df, "id", "t", min_tf=3, max_df=20).collect()} == set()
    nulls = spark.createDataFrame([(1, None), (2, "")], "id bigint, t string")
    assert ridf.term_scores(nulls, "id", "t").count() == 0


FORMS = [
    (1, "Ana", "Bagus sekali!"), (2, " a-n-a", "bagus   SEKALI"), (3, "Ana", "bagus sekal"), (4, None, "bagus sekali"), (5, "Ana", None),
    (6, "Ana", "!!"), (7, "Ana", "!!"), (8, "Budi", "Versi: 1.2 | Saran: cepat"), (9, "budi", "saran : cepat\nVERSI: 12"),
    (10, "Budi", "Versi: 1.2 Saran cepat"), (11, "Budi", "x Saran: a; Versi: b"), (12, "Budi", "x Versi: b; Saran: a"), (13, "", "teks"), (14, "!", "teks"),
    (15, "Ana", "Bagus sekali!"), (16, "Edo", "kata " * 20_000), (17, "edo", "KATA" * 20_000),
]


def test_form_copies(spark):
    df = spark.createDataFrame(FORMS, "row_id bigint, n string, t string")
    got = sorted((r.keep_id, r.row_id) for r in formcopies.form_copies(df, "row_id", "n", "t", formcopies.FIELD_LABELS).collect())
    assert got == [(1, 2), (1, 15), (8, 9), (11, 12), (13, 14), (16, 17)]
    sizes = {r.keep_id: r.copies for r in formcopies.collapsed(df, "row_id", "n", "t", formcopies.FIELD_LABELS).collect()}
    assert sizes == {1: 3, 8: 2, 11: 2, 13: 2, 16: 2}
    assert formcopies.form_copies(df.limit(0), "row_id", "n", "t").count() == 0


def test_copies_survive_a_tiny_filter_and_a_hot_group(spark):
    rows = [(i, "sama", "teks" if i % 3 == 0 else f"teks {i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "row_id bigint, n string, t string")
    got = {(r.keep_id, r.row_id) for r in formcopies.form_copies(df, "row_id", "n", "t", filter_bits=6).collect()}
    first, expected = {}, set()
    for i, _, t in rows:
        k = re.sub(r"\W", "", t)
        if k in first:
            expected.add((first[k], i))
        first.setdefault(k, i)
    assert got == expected
