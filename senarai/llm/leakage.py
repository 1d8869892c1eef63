"""Held-out passages inside corpus documents, found by one Aho-Corasick automaton over normalised passages.

Every run of min_words consecutive words of a passage is a pattern, as a sequence of word numbers; a document is turned
into word numbers once (0 for words of no passage) and scanned once. Passages are the stated, small query set: they are
held on the workers in blocks of about BLOCK_CHARS characters, one scan of the corpus a block, so no broadcast grows
with them and no document is ever shuffled. The query set has a stated limit, MAX_ITEM_CHARS in all and BLOCK_CHARS a
passage, beyond which the operator raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words_of

MIN_WORDS = 12
BLOCK_CHARS = 4_000_000
MAX_ITEM_CHARS = 256_000_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_BUILT: dict[str, tuple] = {}


def passage_automaton(items: list[tuple[int, str]], min_words: int = MIN_WORDS) -> tuple[dict[str, int], ahocorasick.Automaton | None]:
    """Word numbers and the automaton whose values are the ids of the items that hold the matched run of words."""
    numbers: dict[str, int] = {}
    owners: dict[tuple[int, ...], set[int]] = {}
    for item, passage in items:
        seq = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(passage)]
        for k in range(len(seq) - min_words + 1):
            owners.setdefault(tuple(seq[k : k + min_words]), set()).add(item)
    if not owners:
        return numbers, None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for run, ids in owners.items():
        automaton.add_word(run, tuple(sorted(ids)))
    automaton.make_automaton()
    return numbers, automaton


def leaked_runs(text: str, numbers: dict[str, int], automaton, min_words: int = MIN_WORDS) -> dict[int, list[list[int]]]:
    """item -> maximal runs [first word, last word] of the text whose every min_words window is in the item."""
    found: dict[int, list[list[int]]] = {}
    seq = tuple(numbers.get(w, 0) for w in words_of(text))
    if len(seq) < min_words:
        return found
    for end, ids in automaton.iter(seq):
        for item in ids:
            runs = found.setdefault(item, [])
            if runs and runs[-1][1] == end - 1:
                runs[-1][1] = end
            else:
                runs.append([end - min_words + 1, end])
    return found


def _blocks(items: DataFrame, item_key: str, passage: str) -> list[list[tuple[int, str]]]:
    rows = items.where(F.col(passage).isNotNull()).select(F.col(item_key).cast("bigint").alias("i"), F.col(passage).alias("p"))
    chars, longest = (x or 0 for x in rows.agg(F.sum(F.length("p")), F.max(F.length("p"))).first())
    if chars > MAX_ITEM_CHARS or longest > BLOCK_CHARS:
        raise ValueError(f"passages of {chars} characters, {longest} the longest: at most {MAX_ITEM_CHARS} and {BLOCK_CHARS}")
    n = -(-chars // BLOCK_CHARS)
    return [
        [(r.i, r.p) for r in rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b).orderBy("i").collect()] for b in range(n)
    ]


def leaked_spans(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, item_id, n_words INT, start INT, end INT: every maximal run of at least min_words shared words, with the
    offsets of its first and after its last character in the original text.

    Null and short texts and passages give nothing. Repeated documents are reported each; an item that shares a run with
    another is reported as well. Empty tables give no rows. Other columns are ignored.
    """
    spark, out = docs.sparkSession, "doc_id bigint, item_id bigint, n_words int, start int, end int"
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    result = None
    for block in _blocks(items, item_key, passage):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _BUILT:
                _BUILT.clear()
                _BUILT[name] = passage_automaton(shared.value, min_words)
            numbers, automaton = _BUILT[name]
            for batch in batches:
                cols: list[list[int]] = [[], [], [], [], []]
                if automaton is not None:
                    for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        found = leaked_runs(t, numbers, automaton, min_words)
                        at = [m.span() for m in _WORD.finditer(t)] if found else []
                        for item, runs in found.items():
                            for first, last in runs:
                                for c, v in zip(cols, (doc, item, last - first + 1, at[first][0], at[last][1])):
                                    c.append(v)
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "n_words", "start", "end"])

        part = rows.mapInArrow(scan, out)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else spark.createDataFrame([], out)


def leaked_items(
    docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, passage: str, min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, item_id, distinct: the item leaked, in whole or part, into the document."""
    return leaked_spans(docs, key, text, items, item_key, passage, min_words).select("doc_id", "item_id").distinct()
