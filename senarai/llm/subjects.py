"""Subject areas of documents, by label propagation over a verified document-similarity graph.

Two documents are similar where they share a phrase (a word, a word pair, a short run of Han characters) of a sentence.
An edge is verified for a subject by its phrase: of the labelled documents that the phrase joins, the lower confidence
bound of the share with that subject must be high enough, so that a label passed along the edge is likely right. All
documents that share a phrase form a clique; it is kept as its hub, the phrase with its counts, through which one step
of propagation (documents to hub, hub to documents) does what its N^2 pairs would, and no hub, however common, brings its
documents into one task: its counts are combined where the documents lie and then summed. In each round documents take
the subjects of their verified edges, sentence by sentence, and hubs are judged anew: a seed document always counts with
its hand labels (clamped), any other with the subjects of its *other* sentences, so that no edge confirms itself. Rounds
end when no hub changes. A document keeps the subjects of all its sentences, none, one or several.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: First estimate from hand labels alone: z of the bound, least bound, least documents.
SEED_Z, SEED_BOUND, SEED_DOCS = 1.0, 0.70, 2
#: Later rounds: z, how far the bound must lie between the subject's base rate and 1, least sentences; most rounds.
ROUND_Z, ROUND_LIFT, ROUND_COUNT, ROUNDS = 2.0, 0.55, 5, 6
#: A seed phrase seen this often outside seeds is dropped if its share there falls below the needed one.
VETO_COUNT = 3
#: Verified hubs of one block: what is sent to the workers at once. Any number of blocks is applied in turn.
BLOCK_HUBS = 500_000
#: Sentences of held-out texts at most, which every worker holds.
MAX_EXCLUDED = 1_000_000
#: Phrases a worker remembers the hash of before it starts anew.
CACHED_PHRASES = 1_000_000

_SENTENCE_END = regex.compile(r"[.!?\n。！？…]+")
_PART = regex.compile(r"[,;，]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_HAN = regex.compile(r"\p{Han}+")


def phrases(sentence: str) -> set[str]:
    """Words, adjacent word pairs, and runs of 2 to 4 Han characters of a sentence, lower-cased, numbers left out."""
    out: set[str] = set()
    low = sentence.lower()
    plain = low.isascii()
    for part in (low.replace(";", ",").split(",") if plain else _PART.split(low)):
        if plain:
            words = [w for w in _ASCII_WORD.findall(part) if not w.isdigit()]
        elif part.isascii() or not _HAN.search(part):
            words = [w for w in _WORD.findall(part) if not w.isdigit()]
        else:
            for run in _HAN.findall(part):
                for n in (2, 3, 4):
                    out.update(run[i : i + n] for i in range(len(run) - n + 1))
            words = [w for w in _WORD.findall(_HAN.sub(" ", part)) if not w.isdigit()]
        out.update(words)
        out.update(map(" ".join, zip(words, words[1:])))
    return out


class _Hashes(dict):
    """phrase -> hash; remembers what it was asked."""

    def __missing__(self, phrase: str) -> int:
        if len(self) > CACHED_PHRASES:
            self.clear()
        self[phrase] = h = xxhash.xxh64_intdigest(phrase) - (1 << 63)
        return h


def held_out_sentences(texts: DataFrame, text: str) -> frozenset[int]:
    """The sentences of held-out texts, each as the sum of its phrases' hashes: equal for sentences of the same phrases. A
    parameter table that must stay within MAX_EXCLUDED sentences."""
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).limit(MAX_EXCLUDED + 1).collect()
    hashes = _Hashes()
    found = frozenset(sum(hashes[p] for p in ps) for r in rows for s in _SENTENCE_END.split(r.t) if (ps := phrases(s)))
    if len(rows) > MAX_EXCLUDED or len(found) > MAX_EXCLUDED:
        raise ValueError(f"more than {MAX_EXCLUDED} held-out sentences")
    return found


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column that holds counts[i] of the values in its row i: numbers that only numpy reads need no list."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, number of values of each row) of such a column."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    held = np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, int(ends[0])) if data is not None and ends[-1] > ends[0] else np.zeros(0, kind)
    return held, np.diff(ends) // size


def document_phrases(df: DataFrame, key: str, text: str, excluded: frozenset[int]) -> DataFrame:
    """doc_id, sizes BINARY, phrases BINARY: the hashed phrases (64 bits) of a document's sentences, laid end to end, and how
    many (32 bits) each has. Null texts, empty sentences and held-out ones are left out. One narrow stage."""
    shared = df.sparkSession.sparkContext.broadcast(excluded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, left_out = _Hashes(), shared.value
        for batch in batches:
            sizes, flat, sentences = [], [], []
            for t in batch.column(1).to_pylist():
                before = len(sizes)
                for s in _SENTENCE_END.split(t):
                    found = [hashes[p] for p in phrases(s)]
                    if found and sum(found) not in left_out:
                        sizes.append(len(found))
                        flat += found
                sentences.append(len(sizes) - before)
            sentences, sizes = np.array(sentences, np.int64), np.array(sizes, np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.concatenate([[0], np.cumsum(sentences)])]
            columns = [batch.column(0), _packed(sizes, sentences), _packed(np.array(flat, np.int64), np.diff(ends))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sizes", "phrases"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, sizes binary, phrases binary")


@dataclass
class Hubs:
    """The verified hubs (f, mask) behind a checkpoint, their number, and a sum over all of them that tells two states apart."""

    table: DataFrame
    count: int
    state: object

    @classmethod
    def of(cls, table: DataFrame) -> Hubs:
        table = cut_lineage(table.select("f", "mask"))
        return cls(table, *table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("f", "mask").cast("decimal(38,0)"))).first())


def _votes(batch: pa.RecordBatch, known: np.ndarray, mask: np.ndarray, subjects: int) -> np.ndarray:
    """How many of the hubs (known, mask) of each sentence of the batch speak for each subject, and those counted before."""
    phrases, _ = _unpacked(batch.column("phrases"))
    sizes, _ = _unpacked(batch.column("sizes"), np.int32)
    votes = np.zeros((len(sizes), subjects), dtype=np.int64)
    if "votes" in batch.schema.names:
        votes += _unpacked(batch.column("votes"))[0].reshape(-1, subjects)
    if len(known):
        at = np.minimum(np.searchsorted(known, phrases), len(known) - 1)
        hits = np.flatnonzero(known[at] == phrases)
        sentence, hit = np.repeat(np.arange(len(sizes)), sizes)[hits], mask[at[hits]]
        for i in range(subjects):
            votes[:, i] += np.bincount(sentence[hit >> i & 1 == 1], minlength=len(sizes))
    return votes


def by_hubs(graph: DataFrame, hubs: Hubs, subjects: int, finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], out: str) -> DataFrame:
    """What finish makes of each batch of graph and the masks of its sentences: the subject of each by its verified hubs
    (f, mask), several if equally many speak for each.

    The hubs are sent in blocks of about half of BLOCK_HUBS, 4 x BLOCK_HUBS at most. Each block is applied where the documents lie and its votes are
    added to those of the blocks before; there is no shuffle, however many there are."""
    spark, blocks = graph.sparkSession, max(-(-hubs.count // BLOCK_HUBS), 1)
    parts = 2 * blocks if blocks > 1 else 1
    for b in range(parts):
        part = hubs.table if parts == 1 else hubs.table.where(F.pmod(F.xxhash64("f"), F.lit(parts)) == b)
        rows = sorted(part.limit(4 * BLOCK_HUBS + 1).collect())
        if len(rows) > 4 * BLOCK_HUBS:
            raise ValueError("a block of hubs is too large")
        shared = spark.sparkContext.broadcast((np.array([r.f for r in rows], np.int64), np.array([r.mask for r in rows], np.int64)))

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                votes = _votes(batch, *shared.value, subjects)
                _, sentences = _unpacked(batch.column("sizes"), np.int32)
                names = [n for n in batch.schema.names if n != "votes"]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], _packed(votes.ravel(), sentences * subjects)], names=[*names, "votes"])

        def end(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                votes = _votes(batch, *shared.value, subjects)
                most = (votes == votes.max(axis=1, keepdims=True)) & (votes > 0)
                yield finish(batch, (most.astype(np.int64) << np.arange(subjects)).sum(axis=1))

        if b == parts - 1:
            return graph.mapInArrow(end, out)
        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in graph.schema if f.name != "votes"]
        graph = graph.mapInArrow(add, ", ".join([*kinds, "votes binary"]))
    raise AssertionError


def _counted(phrases: np.ndarray, mask: np.ndarray, subjects: int) -> pa.RecordBatch:
    """f, n, k0..: how many of the phrases are f, and how many of these have each subject in their mask."""
    f, n = np.unique(phrases, return_counts=True)
    sums = [n]
    for i in range(subjects):
        held, k = np.unique(phrases[mask >> i & 1 == 1], return_counts=True)
        sums.append(np.zeros(len(f), dtype=np.int64))
        sums[-1][np.searchsorted(f, held)] = k
    return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), *[pa.array(x, pa.int64()) for x in sums]], names=_counts(subjects))


def _counts(subjects: int) -> list[str]:
    return ["f", "n", *[f"k{i}" for i in range(subjects)]]


def seed_counts(seeds: DataFrame, subjects: int) -> DataFrame:
    """f, n, k0.. of each phrase: how many seed documents hold it, and how many of these have each subject by their hand
    labels; combined within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases, per_doc = _unpacked(batch.column("phrases"))
            doc = np.repeat(np.arange(len(per_doc)), per_doc)
            by = np.lexsort((phrases, doc))
            doc, phrases = doc[by], phrases[by]
            once = np.ones(len(by), dtype=bool)
            once[1:] = (doc[1:] != doc[:-1]) | (phrases[1:] != phrases[:-1])
            yield _counted(phrases[once], batch.column("seed").to_numpy(zero_copy_only=False)[doc[once]], subjects)

    return seeds.select("phrases", "seed").mapInArrow(run, ", ".join(f"{c} bigint" for c in _counts(subjects)))


def spread_counts(rows: DataFrame, hubs: Hubs, subjects: int) -> DataFrame:
    """f, n, k0.. of each phrase: how many sentences hold it whose document has subjects by its *other* sentences, and how
    many of these have each subject; combined within each batch."""

    def finish(batch: pa.RecordBatch, own: np.ndarray) -> pa.RecordBatch:
        phrases, _ = _unpacked(batch.column("phrases"))
        sizes, sentences = _unpacked(batch.column("sizes"), np.int32)
        doc = np.repeat(np.arange(len(sentences)), sentences)
        other = np.zeros(len(own), dtype=np.int64)
        for i in range(subjects):  # a subject of another sentence: had by two of them, or by one that isn't this
            has = own >> i & 1
            other |= (np.bincount(doc[has == 1], minlength=len(sentences))[doc] - has > 0).astype(np.int64) << i
        mask = np.repeat(other, sizes)
        return _counted(phrases[mask != 0], mask[mask != 0], subjects)

    return by_hubs(rows.select("sizes", "phrases"), hubs, subjects, finish, ", ".join(f"{c} bigint" for c in _counts(subjects)))


def document_masks(graph: DataFrame, hubs: Hubs, subjects: int) -> DataFrame:
    """doc_id, mask: the subjects of all sentences of a document, those of its hand labels where there are none."""

    def finish(batch: pa.RecordBatch, own: np.ndarray) -> pa.RecordBatch:
        _, sentences = _unpacked(batch.column("sizes"), np.int32)
        found, held = np.zeros(len(sentences), dtype=np.int64), sentences > 0
        if held.any():
            found[held] = np.bitwise_or.reduceat(own, np.concatenate([[0], np.cumsum(sentences[held])[:-1]]))
        mask = np.where(found != 0, found, batch.column("seed").to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(mask, pa.int64())], names=["doc_id", "mask"])

    rows = graph.select("doc_id", F.coalesce("seed", F.lit(0).cast("bigint")).alias("seed"), "sizes", "phrases")
    return by_hubs(rows, hubs, subjects, finish, "doc_id bigint, mask bigint").where("mask <> 0")


def _bound(k: np.ndarray, n: np.ndarray, z: float) -> np.ndarray:
    """Lower end of the Wilson interval of k of n."""
    n = np.maximum(n, 1)
    p = k / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def verified_hubs(counts: DataFrame, need: list[float]) -> DataFrame:
    """f, mask of the hubs that are verified for a subject: by seeds alone if nothing outside them speaks against it, or by
    all documents. counts has f, n0, s0.. of seeds and n, k0.. of the others, any number of rows a phrase."""
    subjects = len(need)
    seeds, others = [f"s{i}" for i in range(subjects)], [f"k{i}" for i in range(subjects)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            n0, mask = column("n0"), np.zeros(batch.num_rows, dtype=np.int64)
            n = n0 + column("n")
            for i in range(subjects):
                k0 = column(seeds[i])
                k = k0 + column(others[i])
                by_seeds = (n0 >= SEED_DOCS) & (_bound(k0, n0, SEED_Z) >= SEED_BOUND) & ((n - n0 < VETO_COUNT) | (k >= need[i] * n))
                by_all = (n >= ROUND_COUNT) & (_bound(k, n, ROUND_Z) >= need[i])
                mask |= (by_seeds | by_all).astype(np.int64) << i
            kept = np.flatnonzero(mask)
            yield pa.RecordBatch.from_arrays([batch.column("f").take(pa.array(kept)), pa.array(mask[kept], pa.int64())], names=["f", "mask"])

    summed = counts.groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n0", *seeds, "n", *others)])
    return summed.mapInArrow(judge, "f bigint, mask bigint")


def propagate(
    docs: DataFrame,
    key: str,
    text: str,
    labels: DataFrame,
    label_key: str,
    label: str,
    subjects: list[str],
    exclude: DataFrame | None = None,
    exclude_text: str = "",
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, subject: the subjects of each document, distinct; documents without a subject have no row.

    labels may hold several rows a document, repeated ones, nulls, unknown subjects and ids without a document; these are
    ignored. Hand labels are clamped during propagation; in the result a hand label is trusted unless the graph speaks
    against it, that is unless it gives the document subjects and not this one; where it gives none, the labels stay.
    Sentences that are sentences of exclude's texts (held-out passages, at most MAX_EXCLUDED) neither carry a subject nor
    count. Null and empty texts get no subject; a document id that occurs twice is one document with the subjects of both
    rows. Without labels nothing is assigned. At most 62 subjects, as they are bits of one number. Other columns are
    ignored.
    """
    if not 0 < len(subjects) <= 62:
        raise ValueError("between 1 and 62 subjects are needed")
    count = len(subjects)
    number = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, i)])
    seeds = (
        labels.select(F.col(label_key).cast("bigint").alias("doc_id"), number[F.col(label)].alias("i"))
        .where("doc_id IS NOT NULL AND i IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.expr("bit_or(shiftleft(1L, i))").alias("seed"))
    )
    excluded = held_out_sentences(exclude, exclude_text) if exclude is not None else frozenset()
    graph = cut_lineage(document_phrases(docs, key, text, excluded).join(seeds, "doc_id", "left"))
    clamped, free = graph.where("seed IS NOT NULL"), graph.where("seed IS NULL")
    rates = clamped.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftright("seed", i).bitwiseAND(F.lit(1))).alias(f"k{i}") for i in range(count)]).first()
    base = [(rates[f"k{i}"] or 0) / max(rates["n"], 1) for i in range(count)]
    need = [b + ROUND_LIFT * (1 - b) for b in base]
    zero = F.lit(0).cast("bigint")
    blank = {"n": "n0", **{f"k{i}": f"s{i}" for i in range(count)}}
    seeded = seed_counts(clamped, count).groupBy("f").agg(*[F.sum(c).alias(s) for c, s in blank.items()])
    seeded = cut_lineage(seeded.select("f", *blank.values(), *[zero.alias(c) for c in blank]))
    # by the seeds alone first: nothing else has been seen, so nothing speaks against them
    hubs = Hubs.of(verified_hubs(seeded, need))
    for _ in range(rounds):
        spread = spread_counts(free, hubs, count).select("f", *[zero.alias(s) for s in blank.values()], *blank)
        before, hubs = hubs, Hubs.of(verified_hubs(seeded.unionByName(spread), need))
        if (hubs.count, hubs.state) == (before.count, before.state):
            break

    names = F.array(*[F.when(F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1, F.lit(s)) for i, s in enumerate(subjects)])
    found = document_masks(graph, hubs, count)
    return found.select("doc_id", F.explode(F.array_compact(names)).alias("subject")).distinct()
