"""Cross-split overlaps, passage leakage and encoding against brute force."""

import os
import random

import numpy as np
import pytest

from senarai.llm import crosssplit, leakage, tokenise
from senarai.llm.words import words_of

VOCABULARY = [f"kata{i}" for i in range(3_000)]


def _records(seed):
    r = random.Random(seed)
    rows, key = [], 0
    for _ in range(40):
        base = r.sample(VOCABULARY, r.randint(26, 60))
        for split in r.choices(["train", "valid", "test", "lain", None], k=r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(VOCABULARY)
            rows.append((key, " ".join(copy).upper() if r.random() < 0.3 else ", ".join(copy), split))
            key += 1
    return [*rows, (900, None, "train"), (901, "", "test"), (902, "pendek sekali", "train"), (903, "pendek sekali", "test")]


def test_pairs(spark):
    rows = _records(1)
    df = spark.createDataFrame(rows, "id bigint, t string, split string").selectExpr("*", "1 AS cls", "2 AS fp")
    got = {(r.train_id, r.eval_id) for r in crosssplit.split_overlaps(df, "id", "t", "split").collect()}
    sets = {i: set(words_of(t)) for i, t, _ in rows if t and len(set(words_of(t))) >= 25}
    train = [i for i, _, s in rows if s == "train" and i in sets]
    evaluation = [i for i, _, s in rows if s in ("valid", "test") and i in sets]
    expected = {(a, b) for a in train for b in evaluation if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert expected and got == expected
    assert crosssplit.split_overlaps(df.limit(0), "id", "t", "split").count() == 0
    report = crosssplit.overlap_report(df.selectExpr("*", "'s' AS source"), "id", "t", "split", "source").collect()
    assert {r.split: r.n_overlapping for r in report} == {s: len({b for _, b in expected if rows[b][2] == s}) for s in ("valid", "test")}


def test_pairs_without_a_shared_run(spark):
    r = random.Random(5)
    rows = []
    for k in range(12):
        base = r.sample(VOCABULARY, 36)
        spread = [VOCABULARY[(VOCABULARY.index(w) + 1) % 3_000] if i % 9 == 4 else w for i, w in enumerate(base)]
        sentences = [base[i : i + 9] for i in range(0, 36, 9)]
        moved = [w for s in (sentences[2], sentences[0], sentences[3], sentences[1]) for w in s]
        rows += [(10 * k + j, " ".join(t), s) for j, (t, s) in enumerate(((base, "train"), (spread, "test"), (moved, "valid"), (base[::-1], "test")))]
    df = spark.createDataFrame(rows, "id bigint, t string, split string")
    got = crosssplit.split_overlaps(df, "id", "t", "split").collect()
    sets = {i: set(t.split()) for i, t, _ in rows}
    expected = {(a[0], b[0]) for a in rows if a[2] == "train" for b in rows if b[2] != "train" and len(sets[a[0]] & sets[b[0]]) >= 0.75 * len(sets[a[0]] | sets[b[0]])}
    assert len(expected) == 36 and {(x.train_id, x.eval_id) for x in got} == expected
    assert all(x.train_cover > 0 for x in got)


def test_copies_in_a_hot_class(spark):
    text = " ".join(VOCABULARY[:30])
    df = spark.createDataFrame([(i, text, "train" if i % 2 else "test") for i in range(40)], "id bigint, t string, split string")
    rows = crosssplit.split_overlaps(df, "id", "t", "split").collect()
    assert len(rows) == 400 and all(r.jaccard == 1.0 for r in rows)


def test_split_keys_and_classes_give_the_same(spark):
    rows = _records(2)
    hot = " ".join(VOCABULARY[:30])
    rows += [(1_000 + i, hot + f" beda{i % 3}", "train" if i % 2 else "valid") for i in range(24)] + [(None, hot, "train"), (None, hot, "test")]
    df = spark.createDataFrame(rows, "id bigint, t string, split string").selectExpr("*", "'s' AS source")
    pairs = lambda n: sorted((r.train_id, r.eval_id) for r in crosssplit.split_overlaps(df, "id", "t", "split", part_rows=n).collect())
    report = lambda n: sorted(tuple(r) for r in crosssplit.overlap_report(df, "id", "t", "split", "source", part_rows=n).collect())
    assert pairs(3) == pairs(20_000) and len(pairs(3)) >= 144 and report(3) == report(20_000)


def test_records_of_few_words_meet_in_proportion():
    r = random.Random(9)
    phrases = [[f"f{k}k{i}" for i in range(r.randint(2, 4))] for k in range(400)]
    texts = [[w for p in r.sample(phrases, 14) for w in p] for _ in range(6_000)]
    sets = crosssplit.word_sets(texts, crosssplit._Words({crosssplit.signed_hash(w): k for k, w in enumerate(w for p in phrases for w in p)}))
    words = int(sets.ranks.max()) + 1
    placed = [crosssplit.placed_groups(sets, np.full(words, 14 / 400), words, crosssplit.groups_at(k)) for k in range(3)]
    vocabulary = crosssplit.Vocabulary({}, np.full(words, 14 / 400), placed, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    evaluation = np.arange(len(texts)) % 3 == 0
    key, _, record, less, _ = crosssplit.group_keys(sets, evaluation, vocabulary, 0.75)
    side = lambda tested, short: np.sort(key[(evaluation[record] == tested) & (less == short)])
    met = sum(len(a) for x, y in ((0, 0), (0, 1), (1, 0)) for a, _ in crosssplit.met_pairs(side(False, x), side(True, y), side(True, y)))
    # every word is in 200 records: one rare word as a key lets each evaluation record meet hundreds
    assert met < 10 * evaluation.sum()


@pytest.mark.parametrize("similarity", [0.6, 0.75, 1.0])
def test_sets_of_any_size_meet(spark, similarity):
    r = random.Random(11)
    rows, vocabulary = [], VOCABULARY[:900]
    for k in range(60):
        base = r.sample(vocabulary, r.choice([25, 26, 40, 69, 71, 72, 75, 100, 143, 144, 300]))
        for split in ("train", "test", r.choice(["train", "valid"])):
            share = r.choice([1, 1, 0.97, 0.85])
            copy = [w for w in base if r.random() < share]
            copy += r.sample(vocabulary, int(len(base) * r.choice([0, 0, 0.05, 0.15])))
            rows.append((len(rows), " ".join(r.sample(copy, len(copy))), split))
    df = spark.createDataFrame(rows, "id bigint, t string, split string")
    got = {(x.train_id, x.eval_id) for x in crosssplit.split_overlaps(df, "id", "t", "split", similarity=similarity).collect()}
    sets = {i: set(t.split()) for i, t, _ in rows if len(set(t.split())) >= 25}
    pairs = ((a[0], b[0]) for a in rows if a[2] == "train" for b in rows if b[2] != "train" and a[0] in sets and b[0] in sets)
    expected = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}
    assert expected and got == expected


def test_winnowing_keeps_its_promise():
    r = random.Random(3)
    shared = r.sample(VOCABULARY, 11)
    a, b = r.sample(VOCABULARY, 30) + shared + r.sample(VOCABULARY, 9), shared + r.sample(VOCABULARY, 30)
    assert {h for h, _ in crosssplit.winnow(a)} & {h for h, _ in crosssplit.winnow(b)}
    assert crosssplit.winnow(a[: crosssplit.GRAM - 1]) == []


def test_chain_and_alignment():
    assert crosssplit.chain([(0, 5), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    a = [f"w{i}" for i in range(30)]
    b = list(a)
    b[20] = "lain"
    assert crosssplit.aligned(a, b, [(0, 0)]) == 29


def test_leaks(spark):
    passage = " ".join(f"Kata{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage), (2, "pendek"), (3, None), (4, passage)], "item_id bigint, passage string")
    w = words_of(passage)
    docs = [
        (1, "awal, " + "; ".join(w[3:15]) + " akhir"), (2, " ".join(w[3:14])), (3, " ".join([*w[:6], "sela", *w[6:]])),
        (4, None), (5, ""), (6, "é " * 50_000 + passage.upper() + " é" * 50_000), (7, " ".join(w[:12] + w[:12])),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "0 AS item_id", "0 AS start")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(df, "doc_id", "text", items, "item_id", "passage").collect()}
    assert got == {(d, i) for d in (1, 3, 6, 7) for i in (1, 4)}
    spans = {(r.doc_id, r.n_words, r.start, r.end) for r in leakage.leaked_spans(df, "doc_id", "text", items, "item_id", "passage").collect() if r.item_id == 1}
    assert (1, 12, 6, 6 + len("; ".join(w[3:15]))) in spans and (3, 14, len(" ".join([*w[:6], "sela "])), len(docs[2][1])) in spans
    assert sum(s[0] == 7 for s in spans) == 2
    assert leakage.leaked_items(df, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0
    assert leakage.leaked_items(df.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"x{i}y{k}" for k in range(15))) for i in range(20)], "item_id bigint, passage string")
    docs = spark.createDataFrame([(i, " ".join(f"x{i}y{k}" for k in range(15))) for i in range(20)], "doc_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 500)
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "passage").collect()}
    assert got == {(i, i) for i in range(20)}


PIECES = ["a", "b", "'s", "'", "  ", " ", "\n", "ll", "12", "。", "，", "漢", "é", "　", "\x1c", "!", "<|endoftext|>", "\t", "\r\n", "’", "it's", "😀"]


@pytest.mark.parametrize("leaf", [2, 5, 16, 64])
def test_tree_equals_whole(leaf):
    encode, r = tokenise.encoding().encode_ordinary, random.Random(leaf)
    for _ in range(300):
        text = "".join(r.choices(PIECES, k=r.randint(0, 300)))
        assert tokenise.encode_tree(text, encode, leaf) == encode(text)


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_most_documents_are_joined_from_halves(spark):
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("text IS NOT NULL").select("text").collect()]
    encode, calls = tokenise.encoding().encode_ordinary, []

    def counted(part):
        calls.append(part)
        return encode(part)

    joined = 0
    for t in texts:
        calls.clear()
        assert tokenise.encode_tree(t, counted) == encode(t)
        joined += len(calls) > 1
    assert joined == sum(len(t) > tokenise.LEAF_CHARS for t in texts) > len(texts) / 2


def test_too_many_passages_raise(spark, monkeypatch):
    items = spark.createDataFrame([(1, "x" * 40), (2, "y" * 40)], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    for name in ("MAX_ITEM_CHARS", "BLOCK_CHARS"):
        monkeypatch.setattr(leakage, name, 30)
        with pytest.raises(ValueError):
            leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "passage")
        monkeypatch.undo()


def test_column_round_trip(spark):
    texts = ["", None, "Halo dunia!", "漢字。", "<|endoftext|>", "kata panjang " * 20_000, "x" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    ids = tokenise.encode_column(df, "doc_id", "text")
    found = {r.doc_id: r.ids for r in ids.collect()}
    assert found[0] == found[1] == [] and len(found) == len(texts)
    encode = tokenise.encoding().encode_ordinary
    assert all(found[i] == encode(t) for i, t in enumerate(texts) if t)
    back = {r.doc_id: r.text for r in tokenise.decode_column(ids, "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokenise.encode_column(df.limit(0), "doc_id", "text").count() == 0
