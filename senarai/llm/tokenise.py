"""Encoding of texts with a public byte-level BPE vocabulary by a tree reduction over halves.

Encoding is a monoid homomorphism only up to the seam: encode(a + b) equals encode(a) + encode(b) except for tokens near
the join. The pattern that splits text before merging never lets a token span from a letter or digit into a blank or one
of a few punctuation marks, and never looks back, so such a position (a safe point) is a token boundary in every
context. A join re-encodes a window around the seam that grows until it ends at safe points (or the ends of the text) on
both sides; all tokens outside the window are then provably those of the whole text. Decoding concatenates.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Texts of at most so many characters are encoded at once; longer ones by halves. It changes no id, only the work: a leaf
#: costs one call of the encoder, a join a re-encoded window of some 10 characters on both sides.
LEAF_CHARS = 256
WINDOW_CHARS = 64

#: Fixed value: the public splitting pattern of this vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_AFTER = frozenset(" \n.,!?。，！？")


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY):
    """The encoder of a vocabulary file, read once a worker process."""
    import tiktoken

    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _safe(text: str, at: int) -> bool:
    return text[at - 1].isalnum() and text[at] in _AFTER


def _last_safe(text: str) -> int:
    """The last safe point of text within a growing window at its end, 0 if there is none."""
    low, window = len(text), WINDOW_CHARS
    while low > 0:
        high, low = low, max(0, len(text) - window)
        for at in range(min(high, len(text) - 1), max(low, 0), -1):
            if _safe(text, at):
                return at
        window *= 2
    return 0


def _first_safe(text: str) -> int:
    """The first safe point of text within a growing window at its start, len(text) if there is none."""
    high, window = 1, WINDOW_CHARS
    while high < len(text):
        low, high = high, min(len(text), window)
        for at in range(low, high):
            if _safe(text, at):
                return at
        window *= 2
    return len(text)


def encode_tree(text: str, encode, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """The ids of text, as encode(text) gives them, by halves joined over re-encoded boundary windows."""
    if len(text) <= max(leaf_chars, 2):
        return encode(text)
    mid = len(text) // 2
    left, right = text[:mid], text[mid:]
    a, b = encode_tree(left, encode, leaf_chars), encode_tree(right, encode, leaf_chars)
    i, j = _last_safe(left), _first_safe(right)
    tail, head = len(encode(left[i:])) if i else len(a), len(encode(right[:j])) if j < len(right) else len(b)
    return a[: len(a) - tail] + encode(left[i:] + right[:j]) + b[head:]


def encode_column(
    df: DataFrame, key: str, text: str, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """key BIGINT, ids ARRAY<INT>: one row for every row of df, in one narrow stage without a shuffle.

    A null text and an empty text have the empty list of ids. Special-token strings in a text are ordinary text. The
    folder must hold the vocabulary on every worker; it is a parameter and never part of the package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, vocabulary).encode_ordinary
        for batch in batches:
            ids = [encode_tree(t, encode, leaf_chars) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` bigint, ids array<int>")


def decode_tree(ids: list[int], decode_bytes, leaf_ids: int = 4096) -> bytes:
    """Bytes of ids, concatenated up the tree."""
    if len(ids) <= leaf_ids:
        return decode_bytes(ids)
    mid = len(ids) // 2
    return decode_tree(ids[:mid], decode_bytes, leaf_ids) + decode_tree(ids[mid:], decode_bytes, leaf_ids)


def decode_column(df: DataFrame, key: str, ids: str, folder: str = TOKENIZER_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """key BIGINT, text STRING; null ids give null, the empty list the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(folder, vocabulary).decode_bytes
        for batch in batches:
            texts = [None if x is None else decode_tree(x, decode).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key).cast("bigint").alias(key), F.col(ids).alias("__ids")).mapInArrow(run, f"`{key}` bigint, text string")
