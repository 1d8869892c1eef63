"""Same or near-same records across splits, by groups of words that allow one difference, without a loss.

The vocabulary is divided into groups. Two word sets of the wanted similarity differ in at most d words, which spread
over the groups, so among any (d + 1) / 2 groups there is one in which they differ in one word at most. Each record gives
a key for its words of a group, the rarest few of them, and a key for these without each single word; a key with all of
one record meets either kind of the other. A training record gives the keys of all groups, an evaluation record those of
as many groups as it needs, the ones whose words are rarest together. So every pair of the similarity meets, whatever the
order in the texts and wherever they differ, while two records that just share some words don't: that takes a group of
them. Words that occur together are put into different groups, which evens the groups out; no result depends on it.

Keys travel packed and are joined by sorting in Arrow batches. A pair must have sizes that allow the similarity and parity
sketches that differ in no more bits than the sets may differ in words (the sketches of two sets never differ in more
bits than the sets do in words). The seeds of a proposed pair, the places of its winnowed fingerprints in both texts, are
chained to collinear ones and extended word by word, which gives the coverage of either record; the exact similarity of
the word sets decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.heavy import salted_join
from ..session import cut_lineage
from .words import words_of

#: Words of a fingerprint, and fingerprints of a window: a shared run of GRAM + WINDOW - 1 words is certain to be found.
GRAM = 6
WINDOW = 6
MIN_WORDS = 25
SIMILARITY = 0.75
TRAIN = ("train",)
EVALUATION = ("valid", "test")
#: The commonest words of the sample, whose order is by frequency; all rarer ones come before them, by hash. Bounds the broadcast only.
RANKED_WORDS = 20_000
#: Groups of words at the first level, which serves evaluation records of 53 words at 0.75; more by the ratio at each further level.
GROUPS = 9
LEVEL_RATIO = 1.45
#: The rarest words of a group that make its key.
GROUP_WORDS = 4
#: Commonest words that are put into groups by what they occur with, and the first levels at which they are; others by hash.
PLACED_WORDS = 1_500
PLACED_LEVELS = 3
PLACING_ROUNDS = 5
#: About so many records, at most twice, and their first characters, from which words' order, groups and hot keys are
#: estimated; of a hot key there are at least so many. No result depends on them.
SAMPLE_RECORDS = 8_000
SAMPLE_CHARS = 4_000
HOT_SAMPLES = 4
#: Keys that are joined at once, and pairs that are compared at once.
PART_KEYS = 1_000_000
PAIR_BLOCK = 1_000_000
#: Records that hold a key, or rows of a class, beyond which they are split into parts.
SPLIT_ROWS = 20_000
#: Rows whose texts are fetched through a broadcast list of ids, checked by a count; beyond, by a shuffle of those in a bit table of at most this size.
BROADCAST_IDS = 200_000
MAX_FILTER_BITS = 26
#: Distinct texts a task remembers, of which it gives the keys once.
SEEN_TEXTS = 1_000_000
#: Words a worker remembers the order of before it starts anew.
CACHED_WORDS = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _winnow_flat(codes: np.ndarray, lengths: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, record, position in it) of the minimal rolling hash of every window of records laid end to end, the
    rightmost of equal ones, each place once; a record with fewer hashes than a window has the smallest of them."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    grams = np.maximum(lengths - gram + 1, 0)
    total = int(lengths.sum())
    if total < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled = np.zeros(total - gram + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            rolled = rolled * _BASE + codes[k : k + len(rolled)]
        rolled ^= rolled >> np.uint64(31)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
    kept = np.zeros(len(rolled), dtype=bool)
    long = np.flatnonzero(grams > window)
    if len(long):
        counts = grams[long] - window + 1
        first = np.repeat(starts[long] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        views = np.lib.stride_tricks.sliding_window_view(rolled, window)[first][:, ::-1]
        kept[first + window - 1 - views.argmin(axis=1)] = True
    for r in np.flatnonzero((grams > 0) & (grams <= window)):
        at, n = int(starts[r]), int(grams[r])
        kept[at + n - 1 - int(np.argmin(rolled[at : at + n][::-1]))] = True
    places = np.flatnonzero(kept)
    record = np.searchsorted(starts + lengths, places, side="right")
    return rolled[places].view(np.int64), record, places - starts[record]


def winnow(words: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[int, int]]:
    """(fingerprint, position) of the minimal rolling hash of every window, the rightmost of equal ones, each once."""
    codes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    prints, _, places = _winnow_flat(codes, np.array([len(words)]), gram, window)
    return list(zip(prints.tolist(), places.tolist()))


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of seeds that increases in both records."""
    order = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(order):
        at = bisect_left(tails, b)
        before.append(last[at - 1] if at else -1)
        if at == len(tails):
            tails.append(b)
            last.append(k)
        else:
            tails[at], last[at] = b, k
    out = []
    k = last[-1] if last else -1
    while k >= 0:
        out.append(order[k])
        k = before[k]
    return out[::-1]


def aligned(a: list[str], b: list[str], seeds: list[tuple[int, int]], gram: int = GRAM) -> int:
    """Words of a matched to words of b: every chained seed extended both ways, over single differing words."""
    done_a = done_b = total = 0
    for sa, sb in chain(seeds):
        if sa < done_a or sb < done_b:
            if sa - done_a != sb - done_b:
                continue
            sa, sb = max(sa, done_a), max(sb, done_b)
        i, j = sa, sb
        while i > done_a and j > done_b and (a[i - 1] == b[j - 1] or (i - 1 > done_a and j - 1 > done_b and a[i - 2] == b[j - 2])):
            i, j = i - 1, j - 1
            total += a[i] == b[j]
        i, j = sa, sb
        while i < len(a) and j < len(b) and (a[i] == b[j] or (i + 1 < len(a) and j + 1 < len(b) and a[i + 1] == b[j + 1])):
            total += a[i] == b[j]
            i, j = i + 1, j + 1
        done_a, done_b = max(done_a, i), max(done_b, j)
    return total


def _searched(df: DataFrame, key: str, text: str, split: str, splits: tuple[str, ...], *keep: str) -> DataFrame:
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(split).isin(*splits))
    return rows.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"), F.col(split).alias("split"), *keep)


def common_words(texts: list[list[str]]) -> dict[int, int]:
    """hash -> number of these records of the RANKED_WORDS words of the most, commonest first."""
    counts = Counter(signed_hash(w) for words in texts for w in set(words))
    return dict(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:RANKED_WORDS])


def signed_hash(word: str) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class _Words(dict):
    """word -> its number in `hashes` and `ranks` (-1 beyond the ranked words); remembers what it was asked."""

    def __init__(self, ranks: dict[int, int]):
        self.known, self.hashes, self.ranks = ranks, [], []

    def __missing__(self, word: str) -> int:
        h = signed_hash(word)
        self.hashes.append(h)
        self.ranks.append(self.known.get(h, -1))
        self[word] = len(self.hashes) - 1
        return len(self.hashes) - 1

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, rank) of every word."""
        if len(self) > CACHED_WORDS:
            self.clear()
            self.hashes, self.ranks = [], []
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.array(self.hashes, dtype=np.int64).view(np.uint64)[at], np.array(self.ranks, dtype=np.int64)[at]


@dataclass
class Sets:
    """Word sets laid end to end: record, hash and rank of every distinct word, the rarest of a record first; words of each."""

    record: np.ndarray
    hashes: np.ndarray
    ranks: np.ndarray
    n: np.ndarray


def word_sets(split: list[list[str]], words: _Words) -> Sets:
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    hashes, ranks = words.numbers([w for ws in split for w in ws])
    record = np.repeat(np.arange(len(split)), lengths)
    order = np.lexsort((hashes, np.where(ranks < 0, -(1 << 40), -ranks), record))
    r, h, k = record[order], hashes[order], ranks[order]
    once = np.ones(len(r), dtype=bool)
    once[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    r, h, k = r[once], h[once], k[once]
    return Sets(r, h, k, np.bincount(r, minlength=len(split)))


def most_differing(n: np.ndarray, similarity: float) -> np.ndarray:
    """In how many words a set of n words can differ from one of the similarity."""
    return np.floor(n * (1 - similarity) / similarity + 1e-6).astype(np.int64)


def groups_at(level: int) -> int:
    return int(GROUPS * LEVEL_RATIO**level)


def levels_of(n: np.ndarray, similarity: float) -> np.ndarray:
    """The first level whose groups suffice for an evaluation record of n words."""
    needed = most_differing(n, similarity) // 2 + 1
    groups = [groups_at(0)]
    while groups[-1] < needed.max(initial=0):
        groups.append(groups_at(len(groups)))
    return np.searchsorted(groups, needed)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Vocabulary:
    """What all workers must know alike: ranks and shares of the common words, their groups at the first levels (-1: by
    hash), hot keys in order and in how many parts they are split."""

    ranks: dict[int, int]
    shares: np.ndarray
    placed: list[np.ndarray]
    hot: np.ndarray
    hot_parts: np.ndarray

    def groups(self, level: int, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        by_hash = ((hashes >> np.uint64(8)) % np.uint64(groups_at(level))).astype(np.int64)
        if level >= len(self.placed):
            return by_hash
        placed = np.append(self.placed[level], -1)[ranks]
        return np.where(placed < 0, by_hash, placed)


def placed_groups(sets: Sets, shares: np.ndarray, words: int, groups: int) -> np.ndarray:
    """The group of each of the commonest words: the one with whose words it occurs least, in bits of information, which
    evens out what a record has in each; the weightiest placed first, and all again in some rounds."""
    held = np.zeros((len(sets.n), words), dtype=np.float32)
    common = (sets.ranks >= 0) & (sets.ranks < words)
    held[sets.record[common], sets.ranks[common]] = 1
    held *= -np.log2(np.minimum(shares[:words], 0.99))
    together, cost, out = (held.T @ held).astype(np.float64), np.zeros((words, groups)), np.full(words, -1)
    order = np.argsort(-together.diagonal(), kind="stable")
    np.fill_diagonal(together, 0)
    for _ in range(PLACING_ROUNDS):
        for w in order:
            best = cost[w].argmin()
            if best != out[w]:
                if out[w] >= 0:
                    cost[:, out[w]] -= together[:, w]
                cost[:, best] += together[:, w]
                out[w] = best
    return out


def group_keys(sets: Sets, evaluation: np.ndarray, vocabulary: Vocabulary, similarity: float) -> tuple[np.ndarray, ...]:
    """(key, its first word with the group, record, whether a word of the group was left out, size from which a training
    record needs the key of this evaluation record) of all records, by their levels."""
    sizes = sets.n.astype(np.float64)
    own = levels_of(sets.n, similarity)
    low = np.where(evaluation, own, levels_of(np.ceil(sizes * similarity - 1e-6).astype(np.int64), similarity))
    high = np.where(evaluation, own, levels_of(np.floor(sizes / similarity + 1e-6).astype(np.int64), similarity))
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))]
    for level in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        on = (low <= level) & (level <= high)
        if on.any():
            found.append(_level_keys(sets, on, evaluation, vocabulary, similarity, level))
    return tuple(np.concatenate(c) for c in zip(*found))


def _level_keys(sets: Sets, on: np.ndarray, evaluation: np.ndarray, vocabulary: Vocabulary, similarity: float, level: int) -> tuple[np.ndarray, ...]:
    groups = groups_at(level)
    members = np.flatnonzero(on)
    mine = on[sets.record]
    hashes, ranks = sets.hashes[mine], sets.ranks[mine]
    cell = (np.cumsum(on) - 1)[sets.record[mine]] * groups + vocabulary.groups(level, hashes, ranks)
    order = np.argsort(cell, kind="stable")
    hashes, share = _mixed(hashes[order]), np.append(vocabulary.shares, vocabulary.shares.min(initial=1.0) / 10)[ranks[order]]
    held = np.bincount(cell, minlength=len(members) * groups)
    start = np.cumsum(held) - held
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    first = np.minimum(held, GROUP_WORDS)
    kept, single, place = np.ones(len(held), dtype=bool), np.ones(len(held), dtype=bool), np.zeros(len(held), dtype=np.int64)
    tested = evaluation[members]
    if tested.any():  # as many groups as the differences can't fill with two each, the rarest first; an odd one needs no word left out
        logs, inverse = (np.concatenate([[0.0], np.cumsum(x)]) for x in (np.log(share), 1 / share))
        cost = logs[start + first] - logs[start] + np.log1p(inverse[start + first] - inverse[start])
        place = cost.reshape(-1, groups).argsort(axis=1, kind="stable").argsort(axis=1).ravel()
        most = np.where(tested, most_differing(sets.n[members], similarity), 2 * groups).repeat(groups)
        kept, single = 2 * place <= most, 2 * place + 1 <= most
    number = (np.arange(len(held)) % groups + 1).astype(np.uint64) + np.uint64(level << 40)
    salt = _mixed(number * _BASE)
    whole = np.flatnonzero(kept)
    less = np.flatnonzero(single & (held > 0))
    owner = np.repeat(less, first[less])
    skipped = np.arange(len(owner)) - np.repeat(np.cumsum(first[less]) - first[less], first[less])
    taken = np.minimum(held - 1, GROUP_WORDS) + 1
    padded = np.append(hashes, np.zeros(1, np.uint64))
    rest = sums[start[owner] + taken[owner]] - sums[start[owner]] - hashes[start[owner] + skipped]
    cells = np.concatenate([whole, owner])
    key = _mixed(np.concatenate([sums[start[whole] + first[whole]] - sums[start[whole]], rest]) ^ salt[cells])
    lead = np.concatenate([np.where(held[whole] > 0, padded[start[whole]], 0), np.where(held[owner] > 1, padded[start[owner] + (skipped == 0)], padded[start[owner]] * (skipped > 0))])
    record, left = members[cells // groups], np.repeat([False, True], [len(whole), len(owner)])
    # a group is needed by sets that may differ in two words in each one before it
    n = sets.n[record].astype(np.float64)
    least = np.maximum(n * similarity, (2 * place[cells] + left) * (1 + similarity) / max(1 - similarity, 1e-9) - n * (similarity < 1))
    return key, _mixed(lead ^ salt[cells]), record, left, np.where(evaluation[record] & (2 * place[cells] + left > 0), np.ceil(least - 1e-6), np.ceil(n * similarity - 1e-6)).astype(np.int64)


def split_hot(keys: tuple[np.ndarray, ...], ids: np.ndarray, evaluation: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, ...]:
    """The keys, a hot one with the number of a part: all parts of a training record's, one of an evaluation record's."""
    key, lead, record, less, least = keys
    if not len(vocabulary.hot) or not len(key):
        return keys
    at = np.minimum(np.searchsorted(vocabulary.hot, key), len(vocabulary.hot) - 1)
    parts = np.where(vocabulary.hot[at] == key, vocabulary.hot_parts[at], 1)
    copies = np.where(evaluation[record], 1, parts)
    number = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    each = np.repeat(np.arange(len(key)), copies)
    own = (_mixed(ids[record[each]].view(np.uint64)) % parts[each].astype(np.uint64)).astype(np.int64)
    number = np.where(evaluation[record[each]], own, number).astype(np.uint64)
    named = lambda x: np.where(number > 0, _mixed(x[each] + number), x[each])
    return named(key), named(lead), record[each], less[each], least[each]


def sketches(sets: Sets) -> np.ndarray:
    """64 parities of each set's words."""
    bits = np.bincount(sets.record * 64 + ((sets.hashes >> np.uint64(20)) & np.uint64(63)).astype(np.int64), minlength=64 * len(sets.n))
    return np.packbits((bits & 1).astype(np.uint8).reshape(-1, 64), axis=1).view(np.uint64).ravel()


def _usable(texts: list[str], min_words: int) -> tuple[list[int], list[list[str]]]:
    split = [words_of(t) for t in texts]
    usable = [at for at, w in enumerate(split) if len(w) >= min_words and len(set(w)) >= min_words]
    return usable, [split[at] for at in usable]


def _text_class(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def vocabulary_of(rows: DataFrame, similarity: float, min_words: int, train: tuple[str, ...], part_rows: int) -> tuple[Vocabulary, int]:
    """The vocabulary of all rows, and in how many parts their keys are joined."""
    records = rows.count()
    drawn = F.pmod(F.xxhash64("row_id"), F.lit(max(1, records // SAMPLE_RECORDS))) == 0
    sample = rows.select("split", F.substring("text", 1, SAMPLE_CHARS).alias("text")).where(drawn).limit(2 * SAMPLE_RECORDS).collect()
    usable, split = _usable([r.text for r in sample], min_words)
    counts = common_words(split)
    ranks = {h: k for k, h in enumerate(counts)}
    sets = word_sets(split, _Words(ranks))
    words = min(PLACED_WORDS, len(ranks))
    shares = np.array(list(counts.values()), dtype=np.float64) / max(len(split), 1)
    placed = []
    for level in range(PLACED_LEVELS):
        placed.append(np.full(len(ranks), -1, dtype=np.int64))
        placed[-1][:words] = placed_groups(sets, shares, words, groups_at(level))
    vocabulary = Vocabulary(ranks, shares, placed, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    evaluation = np.array([sample[at].split not in train for at in usable], dtype=bool)
    keys, held = np.unique(group_keys(sets, evaluation, vocabulary, similarity)[0], return_counts=True)
    scale = records / max(len(sample), 1)
    hot = (held >= HOT_SAMPLES) & (held * scale > part_rows)
    vocabulary.hot, vocabulary.hot_parts = keys[hot], np.ceil(held[hot] * scale / part_rows).astype(np.int64)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vocabulary, max(partitions, int(held.sum() * scale / PART_KEYS) + 1)


def _narrow(values: np.ndarray, kinds: tuple[type, ...]) -> np.ndarray:
    """The values in the first of the unsigned kinds that holds them all."""
    most = int(values.max(initial=0))
    return values.astype(next(k for k in kinds if most <= np.iinfo(k).max))


def _widened(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.uint64) if n else np.zeros(0, np.uint64)


def packed_keys(rows: DataFrame, vocabulary: Vocabulary, parts: int, similarity: float, min_words: int, train: tuple[str, ...]) -> DataFrame:
    """part, side (1: evaluation), base and, as arrays in bytes, the keys of records: keys (odd: a word left out) and, of
    evaluation records, least sizes; number of keys, id less base, size and sketch of each record. What can meet lies in the
    same part, as keys go by their first word; most keys of a group share it, so the record is sent once for them. A
    text is taken once a side and task. One narrow stage."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(shared.value.ranks), set()
        for batch in batches:
            usable, split = _usable(batch.column(1).to_pylist(), min_words)
            sides = batch.column(2).to_pylist()
            if len(seen) > SEEN_TEXTS:
                seen.clear()
            new = []
            for k, (at, w) in enumerate(zip(usable, split)):
                text = (_text_class(w)[:8], sides[at] in train)
                if text not in seen:
                    seen.add(text)
                    new.append(k)
            if not new:
                continue
            usable, split = [usable[k] for k in new], [split[k] for k in new]
            sets = word_sets(split, words)
            ids = batch.column(0).to_numpy()[usable]
            base = ids.min()
            evaluation = np.array([sides[at] not in train for at in usable], dtype=bool)
            key, lead, record, less, least = split_hot(group_keys(sets, evaluation, shared.value, similarity), ids, evaluation, shared.value)
            place = ((lead >> np.uint64(32)) % np.uint64(parts)).astype(np.int64) * 2 + evaluation[record]
            order = np.lexsort((record, place.astype(np.uint16) if parts < 1 << 15 else place))
            key, place, record, less, least = key[order], place[order], record[order], less[order], least[order]
            heads = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (record[1:] != record[:-1])]))
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            by_key, by_head = np.append(starts, len(place)), np.append(np.searchsorted(heads, starts), len(heads))

            def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
                return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

            tested = evaluation[record]
            needed = np.concatenate([[0], np.cumsum(tested)])[by_key]
            at = record[heads]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place[starts] // 2, pa.int32()), pa.array(place[starts] % 2, pa.int32()), pa.array(np.full(len(starts), base), pa.int64()),
                    lists((key.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | less.astype(np.uint32), by_key),
                    lists(_narrow(np.minimum(least[tested], 65_535), (np.uint8, np.uint16)), needed),
                    lists(np.diff(np.append(heads, len(key))).astype(np.uint16), by_head),
                    lists(_narrow(ids.view(np.uint64) - base.view(np.uint64), (np.uint16, np.uint32, np.uint64))[at], by_head),
                    lists(_narrow(np.minimum(sets.n, 65_535), (np.uint8, np.uint16))[at], by_head), lists(sketches(sets)[at], by_head),
                ],
                names=["part", "side", "base", "keys", "least", "held", "ids", "sizes", "sketches"],
            )

    return rows.select("row_id", "text", "split").mapInArrow(
        pack, "part int, side int, base bigint, keys binary, least binary, held binary, ids binary, sizes binary, sketches binary"
    )


def met_pairs(ranked: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ranked of what lies between first and last, and the places of these; some PAIR_BLOCK at once."""
    low, high = np.searchsorted(ranked, first, "left"), np.searchsorted(ranked, last, "right")
    some = np.flatnonzero(high > low)
    low, held = low[some], (high - low)[some]
    ends = np.cumsum(held)
    at = 0
    while at < len(some):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIR_BLOCK, "right")))
        n = held[at:to]
        yield np.arange(int(n.sum())) + np.repeat(low[at:to] - (ends[at:to] - n - before), n), np.repeat(some[at:to], n)
        at = to


def sized(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Key and size in one number."""
    return (keys.astype(np.uint64) << np.uint64(16)) | sizes.astype(np.uint64)


def largest(sizes: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(np.floor(sizes / similarity + 1e-6), 65_535)


def joined_part(part: pa.Table, similarity: float) -> pa.Table:
    """a, b, distinct: ids of training and evaluation records that share a key and may have the similarity."""
    sides, share = part.column("side").to_numpy(), (1 - similarity) / (1 + similarity)

    def unpacked(side: int) -> list[tuple[np.ndarray, ...]]:
        blocks = [(np.zeros(0, np.uint32), *[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for base, keys, least, held, ids, sizes, marks in zip(*(c.to_pylist() for c in part.filter(pa.array(sides == side)).columns[2:])):
            key, times = np.frombuffer(keys, np.uint32), np.frombuffer(held, np.uint16)
            n = len(times)
            each = _widened(sizes, n), (_widened(ids, n) + np.int64(base).view(np.uint64)).view(np.int64), np.frombuffer(marks, np.uint64)
            size, number, mark = (np.repeat(c, times) for c in each)
            blocks.append((key, size, _widened(least, len(key)) if side else size, number, mark))
        key, n, low, ids, marks = (np.concatenate(c) for c in zip(*blocks))
        out = []
        for less in (0, 1):
            on = np.flatnonzero(key & 1 == less)
            k = key[on] >> 1
            ranked = sized(k, n[on])
            order = np.argsort(ranked)  # in order of their keys, both sides are met from front to back
            columns = ranked, sized(k, low[on]), sized(k, largest(n[on].astype(np.float64), similarity)), ids[on], n[on].astype(np.float64), marks[on]
            out.append(tuple(c[order] for c in columns))
        return out

    (whole, less), (whole_b, less_b) = unpacked(0), unpacked(1)
    found = [np.zeros((0, 2), np.int64)]
    for (ranked, _, _, ids_a, n_a, mark_a), (_, first, last, ids_b, n_b, mark_b) in ((whole, whole_b), (whole, less_b), (less, whole_b)):
        most = share * (n_b + n_b / similarity) + 1e-6
        for a, b in met_pairs(ranked, first, last):
            differing = np.bitwise_count(mark_a[a] ^ mark_b[b])
            near = np.flatnonzero(differing <= most[b])
            a, b = a[near], b[near]
            near = differing[near] <= share * (n_a[a] + n_b[b]) + 1e-6
            found.append(np.stack([ids_a[a[near]], ids_b[b[near]]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def candidates(rows: DataFrame, similarity: float, min_words: int, train: tuple[str, ...], part_rows: int) -> DataFrame:
    """a, b, distinct: row ids of training and evaluation records that may have the similarity, among them one of every
    text of either side that has it."""
    vocabulary, parts = vocabulary_of(rows, similarity, min_words, train, part_rows)
    keys = packed_keys(rows, vocabulary, parts, similarity, min_words, train)
    return keys.groupBy("part").applyInArrow(lambda part: joined_part(part, similarity), "a bigint, b bigint").distinct()


def record_classes(rows: DataFrame, min_words: int, *keep: str) -> DataFrame:
    """row_id, split, keep and the class of its text of every record with enough words. One narrow stage."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, split = _usable(batch.column(1).to_pylist(), min_words)
            kept = [batch.column(k).take(pa.array(usable, pa.int32())) for k in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(map(_text_class, split), pa.binary())], names=["row_id", "split", *keep, "cls"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = "".join(f", `{c}` {types[c]}" for c in ("split", *keep))
    return rows.select("row_id", "text", "split", *keep).mapInArrow(classify, f"row_id bigint{kept}, cls binary")


def shared_seeds(x: list[str], y: list[str], gram: int, window: int) -> list[tuple[int, int]]:
    """Places of the fingerprints in both, an equal fingerprint's n-th place in the one with its n-th in the other; where
    there are none, the first places of the common words. At most one seed a fingerprint of x."""
    places = defaultdict(list)
    for h, at in winnow(y, gram, window):
        places[h].append(at)
    seeds, used = [], Counter()
    for h, at in winnow(x, gram, window):
        if used[h] < len(places.get(h, ())):
            seeds.append((at, places[h][used[h]]))
            used[h] += 1
    if seeds:
        return seeds
    first = {w: k for k, w in reversed(list(enumerate(y)))}
    return [(k, first[w]) for w, k in {w: k for k, w in reversed(list(enumerate(x)))}.items() if w in first]


def class_links(rows: DataFrame, pairs: DataFrame, similarity: float, gram: int, window: int) -> DataFrame:
    """a, b (classes), jaccard, train_cover, eval_cover of the candidate pairs of row ids whose texts have the similarity."""
    pairs = cut_lineage(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    found = pairs.count()
    few = found <= BROADCAST_IDS // 2  # a pair has two ids
    texts = rows.select("row_id", "text")
    if not few:
        bucket = F.xxhash64("row_id").bitwiseAND(F.lit((1 << min(MAX_FILTER_BITS, (16 * found).bit_length())) - 1))
        slots = ids.select(bucket.alias("k")).groupBy(F.shiftrightunsigned("k", 6).alias("slot"))
        bits = slots.agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 AS INT))")).alias("bits"))
        held = texts.withColumn("k", bucket).join(F.broadcast(bits), F.shiftrightunsigned("k", 6) == F.col("slot"))
        texts = held.where(F.expr("bit_get(bits, cast(k & 63 AS INT)) = 1")).select("row_id", "text")
    texts = texts.join(F.broadcast(ids) if few else ids, "row_id", "left_semi")
    full = pairs.join(texts.select(F.col("row_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("row_id").alias("b"), F.col("text").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = words_of(a), words_of(b)
                sx, sy = set(x), set(y)
                shared = len(sx & sy)
                jaccard = shared / max(len(sx) + len(sy) - shared, 1)
                if jaccard >= similarity and x != y:
                    n = aligned(x, y, shared_seeds(x, y, gram, window), gram)
                    out.append((_text_class(x), _text_class(y), jaccard, n / len(x), n / len(y)))
            kinds = (pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "jaccard", "train_cover", "eval_cover"])

    found = full.select("x", "y").mapInArrow(verify, "a binary, b binary, jaccard double, train_cover double, eval_cover double")
    return found.distinct()


def overlap_classes(
    df: DataFrame, key: str, text: str, split: str, keep: tuple[str, ...], min_words: int, similarity: float,
    train: tuple[str, ...], evaluation: tuple[str, ...], gram: int, window: int, part_rows: int,
) -> tuple[DataFrame, DataFrame]:
    """(members: row_id, split, keep, cls; links: a, b, jaccard, train_cover, eval_cover between their classes, a class
    with records on both sides being linked with itself)."""
    rows = _searched(df, key, text, split, (*train, *evaluation), *keep)
    members = cut_lineage(record_classes(rows, min_words, *keep))
    links = class_links(rows, candidates(rows, similarity, min_words, train, part_rows), similarity, gram, window)
    side = F.col("split").isin(*train)
    one = F.lit(1.0)
    both = members.groupBy("cls").agg(F.max(side).alias("t"), F.max(~side).alias("e")).where("t AND e")
    same = both.select(F.col("cls").alias("a"), F.col("cls").alias("b"), one.alias("jaccard"), one.alias("train_cover"), one.alias("eval_cover"))
    return members, links.unionByName(same)


def split_overlaps(
    df: DataFrame,
    key: str,
    text: str,
    split: str,
    min_words: int = MIN_WORDS,
    similarity: float = SIMILARITY,
    train: tuple[str, ...] = TRAIN,
    evaluation: tuple[str, ...] = EVALUATION,
    gram: int = GRAM,
    window: int = WINDOW,
    part_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """train_id, eval_id, jaccard, train_cover, eval_cover: every pair of a training and an evaluation record of at least
    min_words distinct words each whose word sets have the similarity, whatever the order of their words. Covers are the
    shares of either record's words that align in order, from winnowed fingerprints (gram, window) where they share any.

    Null ids and texts, other or null splits and short records are in no pair. Repeated rows are paired each, as the result is
    stated in pairs of rows; a class of many rows is joined in salted parts. An empty table, or one with one side only,
    gives no rows. Columns other than the three are ignored.
    """
    members, links = overlap_classes(df, key, text, split, (), min_words, similarity, train, evaluation, gram, window, part_rows)
    links = cut_lineage(links)
    side = lambda cond, cls, name: members.where(cond).select(F.col("cls").alias(cls), F.col("row_id").alias(name))
    in_train = F.col("split").isin(*train)
    out = salted_join(links, side(in_train, "a", "train_id"), "a", part_rows)
    out = salted_join(out, side(~in_train, "b", "eval_id"), "b", part_rows)
    return out.select("train_id", "eval_id", "jaccard", "train_cover", "eval_cover")


def overlap_report(
    df: DataFrame, key: str, text: str, split: str, source: str, min_words: int = MIN_WORDS, similarity: float = SIMILARITY,
    train: tuple[str, ...] = TRAIN, evaluation: tuple[str, ...] = EVALUATION, gram: int = GRAM, window: int = WINDOW, part_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """split, source, n_records, n_overlapping, mean_cover: for each evaluation split and source, how many records occur
    in the training split, exactly or almost, and the mean best coverage of those. A null source is a group of its own.

    Counted from classes and their numbers of rows by split and source: no pair of rows is ever formed."""
    named = df.withColumn("__source", F.col(source))
    members, links = overlap_classes(named, key, text, split, ("__source",), min_words, similarity, train, evaluation, gram, window, part_rows)
    best = links.groupBy("b").agg(F.max("eval_cover").alias("cover")).withColumnRenamed("b", "cls")
    sizes = members.where(F.col("split").isin(*evaluation)).groupBy("cls", "split", F.col("__source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    hits = sizes.join(best, "cls").groupBy("split", "source").agg(F.sum("n").alias("n_overlapping"), F.sum(F.col("n") * F.col("cover")).alias("covers"))
    every = df.where(F.col(split).isin(*evaluation)).groupBy(F.col(split).alias("split"), F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_records"))
    same = (every["split"] == hits["split"]) & every["source"].eqNullSafe(hits["source"])
    return every.join(hits, same, "left").select(
        every["split"], every["source"], "n_records", F.coalesce("n_overlapping", F.lit(0)).cast("bigint").alias("n_overlapping"),
        F.round(F.col("covers") / F.col("n_overlapping"), 6).alias("mean_cover"),
    )
