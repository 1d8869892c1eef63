"""Languages of texts and of the stretches of mixed ones, by hyperdimensional profiles.

Every letter has a random vector of +-1; a run of GRAM letters is the product of its letters' vectors, each rotated by
its place; a text is the sum of its runs; a language is the sum of its sentences, refined by retraining on those it gets
wrong. A text belongs to the language of the largest cosine. As the cosine's numerator is linear in the runs, the product
of every possible run with every prototype is computed once, a table of LETTERS^GRAM rows and one column a language, of
constant size; scoring a text is then a sum of table rows, done with numpy for a whole batch at a time. Runs are taken as
orthogonal in the norm of a text, as random vectors of this dimension nearly are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("id", "en", "jv", "su", "ms", "zh")
#: Other spellings of the languages' codes; a region after - or _ is cut off first.
ALIASES = {"ind": "id", "eng": "en", "jav": "jv", "sun": "su", "msa": "ms", "may": "ms", "zho": "zh", "chi": "zh"}
NO_LABEL = ("", "und", "unknown")
MIN_LETTERS = 25

LETTERS = 29  # blank, a to z, Han, other letters
GRAM = 4
DIMENSION = 2048
SEED = 7
#: Bounds of what the model is fitted on: known sentences, and labelled rows of the corpus chosen by a hash of their id.
MAX_SAMPLES, SAMPLE_ROWS, LANGUAGE_ROWS, SAMPLE_CHARS = 5_000, 1_500, 300, 1_000
MARGIN, RATE, EPOCHS = 0.06, 0.1, 15
#: The prototypes are the mean of those after each epoch from this one on, so that they don't hang on the last updates.
FIRST_AVERAGED = 5
#: A sentence counts as one of another language than the text's main one from these on.
FOREIGN_MARGIN, FOREIGN_WORDS, FOREIGN_LETTERS = 0.06, 6, 15
#: Shorter and very short sentences need these margins.
SHORT_WORDS, SHORT_MARGIN, FEW_WORDS, FEW_MARGIN = 4, 0.09, 3, 0.15
#: Longer sentences are searched inside for a stretch of another language, of at least so many words and such a margin:
#: first where the stretch begins and ends at words with a capital, as sentences without full stops do, then anywhere.
LONG_WORDS, STRETCH_WORDS, STRETCH_MARGIN = 20, 5, 0.18
CUT_LONG, CUT_WORDS, CUT_MARGIN = 9, 4, 0.12
#: A sentence clearer than this holds no such stretch, unless it is long.
CLEAR_MARGIN = 0.25
#: No stretch of CUT_WORDS words and CUT_MARGIN has a smaller sum than this: words of one letter give two runs each.
LEAST_GAIN, PADDED_WORDS = CUT_MARGIN * (2 * CUT_WORDS) ** 0.5 - 1e-9, 64
#: Above this share of words with a capital, capitals mean nothing in a sentence; below, a later word with one is a name.
SHOUTED = 0.5
STEEPNESS = 40.0

_NOISE = re.compile(r"\S+://\S+|\S+\s@\s\S+|\S*[@#]\S+|\S*\s?[(\[]at[)\]]\s?\S+(?:\s?[(\[]dot[)\]]\s?\S+)*", re.I)
_STOPS = re.compile(r"[.!?…。！？\n]")
_HAN, _OTHER, _DROP = 27, 28, 255
_ENDS = np.array([ord(c) for c in ".!?…。！？\n"], dtype=np.uint32)
_HARD_ENDS = np.array([ord(c) for c in "。！？\n"], dtype=np.uint32)
CHUNK_CHARS = 400_000


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Letter class of every code point below 2^18."""
    codes = np.zeros(1 << 18, dtype=np.uint8)
    for point in range(1 << 18):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            base = unicodedata.normalize("NFD", char.lower())[0]
            codes[point] = ord(base) - 96 if "a" <= base <= "z" else _OTHER
    codes[0x3400:0xA000] = np.where(codes[0x3400:0xA000] > 0, _HAN, 0)
    codes[0x20000:] = np.where(codes[0x20000:] > 0, _HAN, 0)
    for char in "'’`":
        codes[ord(char)] = _DROP
    return codes


@dataclass
class Split:
    """Sentences of a batch of texts: runs of letters and their sentence, per sentence its text and sizes."""

    runs: np.ndarray
    starts: np.ndarray  # first run of each sentence that has one
    sentence: np.ndarray  # number of that sentence
    text: np.ndarray  # text of every sentence
    letters: np.ndarray
    hans: np.ndarray  # Han letters of every sentence
    words: np.ndarray
    begin: np.ndarray  # first character of every sentence in its text
    end: np.ndarray
    run_word: np.ndarray  # word of each run, counted over the batch
    capital: np.ndarray  # whether each word begins with a capital
    word_begin: np.ndarray  # first character of each word in its text


def split_batch(texts: list[str]) -> Split:
    clean = [_NOISE.sub(lambda m: " " * len(m[0]), t) if "@" in t or "#" in t or "://" in t or "at)" in t or "at]" in t else t for t in texts]
    joined = " " + "\n ".join(clean) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _codes()[np.minimum(points, (1 << 18) - 1)]
    lengths = np.fromiter((len(t) + 2 for t in clean), dtype=np.int64, count=len(clean))
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text_of = np.repeat(np.arange(len(clean)), lengths)
    ends = np.isin(points, _ENDS)
    picture = ((points >= 0x1F300) & (points < 0x1FB00)) | ((points >= 0x2600) & (points < 0x27C0))
    following = np.concatenate([codes[1:], [0]])
    follows_digit = np.concatenate([(points[1:] >= 48) & (points[1:] <= 57), [False]])
    ends &= ((following == 0) & ~follows_digit) | np.isin(points, _HARD_ENDS)
    ends |= picture
    script = np.where(codes == _HAN, 1, np.where((codes > 0) & (codes < _HAN), 2, 0))
    if (script == 1).any():
        # a change between Han and Latin letters, with at most one other character between, ends a stretch
        changes = np.flatnonzero((script[1:] > 0) & (script[:-1] > 0) & (script[1:] != script[:-1]))
        apart = np.flatnonzero((script[2:] > 0) & (script[1:-1] == 0) & (script[:-2] > 0) & (script[2:] != script[:-2])) + 1
        ends[changes] = ends[apart] = True
    sid = np.concatenate([[0], np.cumsum(ends)[:-1]])
    n = int(sid[-1]) + 1 if len(sid) else 0
    first = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if n else np.zeros(0, np.int64)
    last = np.flatnonzero(ends) + 1
    text = text_of[first] if n else np.zeros(0, np.int64)
    begin, end = np.maximum(first - offsets[text] - 1, 0), np.maximum(last - offsets[text] - 1, 0)
    end = np.minimum(end, lengths[text] - 2)
    letter = (codes > 0) & (codes < _DROP)
    letters = np.bincount(sid[letter], minlength=n)
    hans = np.bincount(sid[codes == _HAN], minlength=n)
    # a Latin letter after two equal ones is drawn out and tells no language
    drawn = (codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2]) & (codes[2:] > 0) & (codes[2:] < _HAN)
    codes[2:][drawn] = _DROP
    keep = codes < _DROP
    c, s, up = codes[keep], sid[keep], ((points >= 65) & (points <= 90))[keep]
    blank = c == 0
    keep2 = np.ones(len(c), dtype=bool)
    keep2[1:] = ~(blank[1:] & blank[:-1] & (s[1:] == s[:-1]))
    c, s, up, place = c[keep2].astype(np.int64), s[keep2], up[keep2], np.flatnonzero(keep)[keep2]
    new_word = np.zeros(len(c), dtype=bool)
    new_word[1:] = (c[1:] > 0) & ((c[:-1] == 0) | (s[1:] != s[:-1]))
    word_no = np.cumsum(new_word)
    capital, owner = up[new_word], s[new_word]
    word_begin = place[new_word] - offsets[text_of[place[new_word]]] - 1
    words = np.bincount(owner, minlength=n)
    shouted = np.bincount(owner[capital], minlength=n) > SHOUTED * words
    opening = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    name = capital & ~opening & ~shouted[owner]
    words = words - np.bincount(owner[name], minlength=n)
    named = np.concatenate([[False], name])
    m = len(c) - GRAM + 1
    if m <= 0:
        empty = np.zeros(0, np.int64)
        return Split(empty, empty, empty, text, letters, hans, words, begin, end, empty, capital, word_begin)
    runs = c[:m].copy()
    for k in range(1, GRAM):
        runs = runs * LETTERS + c[k : k + m]
    inside = (s[:m] == s[GRAM - 1 :]) & ~named[word_no[1 : m + 1]] & ~named[word_no[GRAM - 1 :]]
    runs, owner = runs[inside], s[:m][inside]
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    return Split(runs, starts, owner[starts], text, letters, hans, words, begin, end, word_no[1 : m + 1][inside], capital, word_begin)


#: Begin and end in the text, language, margin, letters.
Piece = tuple[int, int, int, float, float]


class Profiles:
    """Language prototypes as a table: row of a run of letters, column of a language, value of the product."""

    def __init__(self, table: np.ndarray, languages: tuple[str, ...]):
        self.table, self.languages = table, languages

    def scores(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """Sums of products and numbers of runs, a row for every sentence of the batch."""
        total = np.zeros((len(split.text), len(self.languages)), dtype=np.float64)
        count = np.zeros(len(split.text), dtype=np.int64)
        if len(split.starts):
            total[split.sentence] = np.add.reduceat(self.table[split.runs], split.starts, axis=0, dtype=np.float64)
            count[split.sentence] = np.diff(np.concatenate([split.starts, [len(split.runs)]]))
        return total, count


def _letter_vectors(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), size=(LETTERS, dimension))


def _sentence_vectors(sentences: list[str], letters: np.ndarray) -> np.ndarray:
    """A unit vector (runs taken as orthogonal) for every text, each one sentence."""
    dimension = letters.shape[1]
    split = [np.zeros(0, np.int64)] * len(sentences)
    for at, part in _chunks([_STOPS.sub(" ", x) for x in sentences]):
        batch = split_batch(part)
        ends = np.concatenate([batch.starts[1:], [len(batch.runs)]]) if len(batch.starts) else batch.starts
        for k, lo, hi in zip(batch.text[batch.sentence].tolist(), batch.starts.tolist(), ends.tolist()):
            split[at + k] = np.concatenate([split[at + k], batch.runs[lo:hi]])
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *split]))
    vectors = np.ones((len(used), dimension), np.int8)
    for k in range(GRAM):
        rolled = np.roll(letters, GRAM - 1 - k, axis=1)
        for at in range(0, len(used), 4_096):  # in blocks, for the driver's memory
            vectors[at : at + 4_096] *= rolled[(used[at : at + 4_096] // LETTERS ** (GRAM - 1 - k)) % LETTERS]
    out = np.zeros((len(sentences), dimension), np.float16)
    for i, runs in enumerate(split):
        if len(runs):
            out[i] = vectors[np.searchsorted(used, runs)].sum(axis=0, dtype=np.float32) / np.sqrt(dimension * len(runs))
    return out


def _retrain(x: np.ndarray, y: np.ndarray, languages: int) -> np.ndarray:
    unit = lambda q: q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    q = unit(np.array([x[y == k].sum(axis=0, dtype=np.float32) if (y == k).any() else np.zeros(x.shape[1], np.float32) for k in range(languages)]))
    total = np.zeros_like(q)
    for epoch in range(EPOCHS):
        wrong = 0
        for i in np.random.default_rng(epoch).permutation(len(x)):
            v = x[i].astype(np.float32)
            s = q @ v
            right = s[y[i]]
            s[y[i]] = -9
            rival = int(np.argmax(s))
            if right - s[rival] < MARGIN:
                q[y[i]] += RATE * v
                q[rival] -= RATE * v
                wrong += 1
        q = unit(q)
        if epoch >= FIRST_AVERAGED:
            total += q
        if not wrong:
            break
    return unit(total) if total.any() else q


def fit(samples: list[tuple[str, str]], labelled: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES, dimension: int = DIMENSION) -> Profiles:
    """Profiles from (language, sentence) and (label, text) pairs. A labelled text is used where the profiles of the
    samples agree with its label, without its sentences that clearly are of another language."""
    letters = _letter_vectors(dimension)
    number = {lang: k for k, lang in enumerate(languages)}
    known = [(number[lang], s) for lang, s in samples if lang in number and s]
    if not known:
        raise ValueError("no sentence of a known language")
    x, y = _sentence_vectors([s for _, s in known], letters), np.array([k for k, _ in known])
    q = _retrain(x, y, len(languages))
    parts = [(number[lang], [s for s in re.split(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+", _NOISE.sub(" ", t)) if sum(map(str.isalpha, s)) >= 15]) for lang, t in labelled if lang in number]
    flat = [s for _, ss in parts for s in ss]
    if flat:
        extra = _sentence_vectors(flat, letters)
        score = np.concatenate([extra[at : at + 1_024].astype(np.float32) @ q.T for at in range(0, len(extra), 1_024)])
        keep, label, at = [], [], 0
        for k, ss in parts:
            block = score[at : at + len(ss)]
            rivals = np.delete(block, k, axis=1)
            if len(ss) and block[:, k].mean() > rivals.mean(axis=0).max():
                good = np.flatnonzero(block[:, k] - rivals.max(axis=1) > -0.05)
                keep += (at + good).tolist()
                label += [k] * len(good)
            at += len(ss)
        extra = np.concatenate([x, extra[keep]])
        q = _retrain(extra, np.concatenate([y, np.array(label, dtype=int)]), len(languages))
        del extra
    a = np.roll(letters, 3, axis=1)[:, None, :].astype(np.float32) * np.roll(letters, 2, axis=1)[None]
    b = np.roll(letters, 1, axis=1)[:, None, :].astype(np.float32) * letters[None]
    a, b = a.reshape(LETTERS**2, dimension), b.reshape(LETTERS**2, dimension)
    table = np.empty((LETTERS**GRAM, len(languages)), np.float32)
    for k, v in enumerate(q):
        table[:, k] = ((a * v) @ b.T).ravel() / np.sqrt(dimension)
    return Profiles(table, languages)


def _stretch(diff: np.ndarray, runs: np.ndarray) -> tuple[float, int, int]:
    """The stretch of words [i, j) of the largest sum, with its cosine margin."""
    sums = np.concatenate([[0.0], np.cumsum(diff)])
    low = np.minimum.accumulate(sums)
    j = int(np.argmax(sums - low))
    i = int(np.argmin(sums[: j + 1]))
    m = runs[i:j].sum()
    return (float(sums[j] - sums[i]) / np.sqrt(m) if m else 0.0), i, j


def sentence_languages(profiles: Profiles, texts: list[str]) -> tuple[Split, np.ndarray, np.ndarray, np.ndarray, list[set[int]], dict[int, list[Piece]]]:
    """(sentences, language of each or -1, its margin, main language of each text or -1, languages of each text, pieces).

    pieces has, for every sentence that holds a stretch of another language, the parts into which the stretches cut it, in
    order and without gaps. The languages of a text are those of its sentences and pieces."""
    split = split_batch(texts)
    total, count = profiles.scores(split)
    cosine = total / np.sqrt(np.maximum(count, 1))[:, None]
    order = np.argsort(cosine, axis=1)
    best, second = order[:, -1], order[:, -2]
    rows = np.arange(len(best))
    margin = cosine[rows, best] - cosine[rows, second]
    han = split.hans * 2 > split.letters
    solid = (count > 0) & ((split.letters >= FOREIGN_LETTERS) | han) & ((split.words >= FEW_WORDS) | han & (split.letters >= 5))
    sums = np.zeros((len(texts), total.shape[1]))
    weak = np.zeros_like(sums)
    # sums of cosine times sqrt(runs) are plain sums of products: long sentences weigh more
    np.add.at(sums, split.text[solid], total[solid])
    np.add.at(weak, split.text, total)
    has = np.zeros(len(texts), dtype=bool)
    has[split.text[solid]] = True
    sums[~has] = weak[~has]
    known = np.zeros(len(texts), dtype=bool)
    known[split.text[count > 0]] = True
    main = np.where(known, sums.argmax(axis=1), -1)
    own_main = main[split.text]
    over_main = cosine[rows, best] - cosine[rows, np.maximum(own_main, 0)]
    needed = np.where(split.words < SHORT_WORDS, FEW_MARGIN, np.where(split.words < FOREIGN_WORDS, SHORT_MARGIN, FOREIGN_MARGIN))
    foreign = solid & (own_main >= 0) & (best != own_main) & (over_main >= np.where(han, FOREIGN_MARGIN, needed))
    language = np.where(count > 0, np.where(foreign, best, own_main), -1)
    unclear = (split.words >= CUT_LONG) & (margin < CLEAR_MARGIN) | (split.words >= LONG_WORDS)
    pieces = {}
    for k in _uneven(profiles, split, np.flatnonzero(unclear & (count > 0)), language).tolist():
        if found := _search_inside(profiles, split, k, int(language[k])):
            pieces[k] = found
    sets: list[set[int]] = [set() for _ in texts]
    for k in np.flatnonzero(language >= 0).tolist():
        sets[split.text[k]].update([p[2] for p in pieces[k]] if k in pieces else (int(language[k]),))
    return split, language, np.where(foreign, over_main, margin), main, sets, pieces


def _uneven(profiles: Profiles, split: Split, sentences: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Those of the sentences in which some stretch of words sums to LEAST_GAIN for another language than their own,
    found for all at once in a padded array; very long ones are always kept."""
    if not len(sentences):
        return sentences
    at = np.searchsorted(split.sentence, sentences)
    bounds = np.concatenate([split.starts, [len(split.runs)]])
    lengths = bounds[at + 1] - bounds[at]
    row = np.repeat(np.arange(len(at)), lengths)
    runs = np.arange(len(row)) + np.repeat(bounds[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    word = split.run_word[runs]
    edges = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])]))
    values = np.add.reduceat(profiles.table[split.runs[runs]], edges, axis=0, dtype=np.float32)
    owner = row[edges]
    own = language[sentences]
    values -= values[np.arange(len(owner)), own[owner]][:, None]
    words = np.bincount(owner, minlength=len(at))
    place = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(words)[:-1]])[owner]
    long = words > PADDED_WORDS
    usual = ~long[owner]
    padded = np.zeros((len(at), int(words[~long].max(initial=1)) + 1, values.shape[1]), dtype=np.float32)
    padded[owner[usual], place[usual] + 1] = values[usual]
    sums = np.cumsum(padded, axis=1)
    gain = (sums - np.minimum.accumulate(sums, axis=1)).max(axis=(1, 2))
    return sentences[long | (gain >= LEAST_GAIN)]


def _search_inside(profiles: Profiles, split: Split, sentence: int, own: int) -> list[Piece]:
    """The pieces into which the clearest stretch of each other language cuts a sentence, none where there is no such."""
    at = int(np.searchsorted(split.sentence, sentence))
    lo = int(split.starts[at])
    hi = int(split.starts[at + 1]) if at + 1 < len(split.starts) else len(split.runs)
    word = split.run_word[lo:hi]
    edges = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    values = np.add.reduceat(profiles.table[split.runs[lo:hi]], edges, axis=0, dtype=np.float64)
    runs = np.diff(np.concatenate([edges, [hi - lo]]))
    number = word[edges]
    cap = split.capital[np.maximum(number - 1, 0)]
    cap[1:] |= number[1:] - number[:-1] > 1  # a name, or the first word of a sentence, was left out between
    telling = cap.mean() <= SHOUTED
    over = values - values[:, own : own + 1]
    sums = np.cumsum(over, axis=0)
    before = np.minimum.accumulate(np.vstack([np.zeros((1, sums.shape[1])), sums[:-1]]), axis=0)
    best_gain = (sums - before).max(axis=0)
    stretches = []
    for k in np.flatnonzero(best_gain >= LEAST_GAIN).tolist():
        if k == own:
            continue
        diff = values[:, k] - values[:, own]
        if telling and cap[1:].any():
            # whole stretches between words with a capital only
            cuts = np.flatnonzero(np.concatenate([[True], cap[1:]]))
            strength, i, j = _stretch(np.add.reduceat(diff, cuts), np.add.reduceat(runs, cuts))
            ends = np.concatenate([cuts, [len(diff)]])
            i, j = ends[i], ends[j]
            if CUT_WORDS <= j - i and (len(diff) - (j - i) >= CUT_WORDS) and strength >= CUT_MARGIN and values[i:j].sum(axis=0).argmax() == k:
                stretches.append((strength, int(i), int(j), k))
                continue
        strength, i, j = _stretch(diff, runs)
        if len(diff) >= LONG_WORDS and j - i >= STRETCH_WORDS and strength >= STRETCH_MARGIN and values[i:j].sum(axis=0).argmax() == k:
            stretches.append((strength, i, j, k))
    return _pieces(split, sentence, number, values, runs, stretches, own) if stretches else []


def _pieces(
    split: Split, sentence: int, number: np.ndarray, values: np.ndarray, runs: np.ndarray, stretches: list[tuple[float, int, int, int]], own: int
) -> list[Piece]:
    """The sentence cut at its stretches (margin, first word, word after the last, language), the clearest on top; a
    capitalised word that was left out just before a piece opens it."""
    language = np.full(len(number), own)
    for _, i, j, k in sorted(stretches):
        language[i:j] = k
    firsts = np.concatenate([[0], np.flatnonzero(language[1:] != language[:-1]) + 1, [len(number)]])
    opens = [int(split.word_begin[number[i] - (2 if number[i] - number[i - 1] > 1 else 1)]) for i in firsts[1:-1]]
    bounds = [int(split.begin[sentence]), *opens, int(split.end[sentence])]
    out = []
    for n, (i, j) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
        k, total, size = int(language[i]), values[i:j].sum(axis=0), int(runs[i:j].sum())
        rival = np.delete(total, k).max() if k == own else total[own]
        margin = float(total[k] - rival) / np.sqrt(max(size, 1))
        out.append((bounds[n], bounds[n + 1], k, margin, float(split.letters[sentence]) * size / runs.sum()))
    return out


def clean_label(label: Column) -> Column:
    """A language label without spelling, null where there is none."""
    code = F.element_at(F.split(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "-"), 1)
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    known = F.coalesce(alias[code], code)
    return F.when(label.isNotNull() & ~F.lower(F.trim(label)).isin(*NO_LABEL), known)


def corpus_profiles(samples: DataFrame, sample_lang: str, sample: str, docs: DataFrame, key: str, text: str, label: str) -> Profiles:
    """Profiles fitted on at most MAX_SAMPLES known sentences and about SAMPLE_ROWS labelled texts in the corpus's own mix of
    languages, but LANGUAGE_ROWS of every language that has them, chosen by a hash of their id, the texts cut to
    SAMPLE_CHARS for fitting only. These bounds fit the model; every row is then classified whole. One pass over the labels
    counts the languages, one over the texts takes the rows whose hash is below their language's share."""
    known = (
        samples.where(F.col(sample).isNotNull()).select(F.col(sample_lang).alias("l"), F.col(sample).alias("s"))
        .orderBy(F.xxhash64("s"), "s", "l").limit(MAX_SAMPLES).collect()
    )
    named = docs.select(F.col(key).alias("k"), clean_label(F.col(label)).alias("l"), F.col(text).alias("t")).where(F.col("l").isin(*LANGUAGES))
    counts = {r.l: r.n for r in named.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = max(sum(counts.values()), 1)
    wanted = {lang: max(LANGUAGE_ROWS, round(SAMPLE_ROWS * n / every)) for lang, n in counts.items()}
    # twice the wanted share, as short texts are left out
    share = F.coalesce(*[F.when(F.col("l") == lang, F.lit(min(1.0, 2 * wanted[lang] / n))) for lang, n in counts.items()], F.lit(0.0))
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    rows = named.where((place < share * (1 << 30)) & (F.length("t") >= MIN_LETTERS)).select("l", place.alias("h"), "k", F.substring("t", 1, SAMPLE_CHARS).alias("t"))
    chosen: dict[str, list[str]] = {}
    for r in rows.orderBy("h", "k").limit(3 * (SAMPLE_ROWS + LANGUAGE_ROWS * len(LANGUAGES))).collect():
        if len(chosen.setdefault(r.l, [])) < wanted[r.l]:
            chosen[r.l].append(r.t)
    return fit([(r.l, r.s) for r in known], [(lang, t) for lang in LANGUAGES for t in chosen.get(lang, ())])


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first number, texts) of blocks of about CHUNK_CHARS characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def _confidence(margin):
    return 1.0 / (1.0 + np.exp(-STEEPNESS * np.maximum(margin, 0.0)))


def text_languages(df: DataFrame, key: str, text: str, profiles: Profiles, *keep: str) -> DataFrame:
    """row_id, n_letters, lang (main language), langs ARRAY (all, sorted), confidence, and the columns keep.

    A text without a run of GRAM letters has a null language, an empty array and confidence 0; a null text gives no row.
    Repeated rows are classified each; an empty table gives no rows. One narrow stage, the table of runs is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast((profiles.table, profiles.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(*shared.value)
        for batch in batches:
            letters, lang, langs, confidence = [], [], [], []
            for _, part in _chunks(batch.column(1).to_pylist()):
                split, _, margin, main, sets, _ = sentence_languages(model, part)
                letters += np.bincount(split.text, weights=split.letters, minlength=len(part)).astype(int).tolist()
                weight = np.bincount(split.text, weights=split.letters * margin, minlength=len(part))
                mean = weight / np.maximum(np.bincount(split.text, weights=split.letters, minlength=len(part)), 1)
                lang += [model.languages[k] if k >= 0 else None for k in main]
                langs += [sorted(model.languages[k] for k in s) for s in sets]
                confidence += np.where(main >= 0, _confidence(mean), 0.0).tolist()
            columns = [batch.column(0), pa.array(letters, pa.int32()), pa.array(lang, pa.string()), pa.array(langs, pa.list_(pa.string())), pa.array(confidence, pa.float64())]
            names = ["row_id", "n_letters", "lang", "langs", "confidence"]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(2 + k) for k in range(len(keep))], names=names + [f"keep_{c}" for c in keep])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    extra = "".join(f", `keep_{c}` {types[f'keep_{c}']}" for c in keep)
    return rows.mapInArrow(run, "row_id bigint, n_letters int, lang string, langs array<string>, confidence double" + extra)


def language_segments(df: DataFrame, key: str, text: str, profiles: Profiles) -> DataFrame:
    """row_id, start INT, end INT, lang, confidence: the stretches of one language, of consecutive sentences or parts of
    one; a sentence that holds a stretch of another language is cut there."""
    shared = df.sparkSession.sparkContext.broadcast((profiles.table, profiles.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(*shared.value)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for at, part in _chunks(batch.column(1).to_pylist()):
                split, language, margin, _, _, cuts = sentence_languages(model, part)
                last = (-1, -1)
                whole = zip(split.begin.tolist(), split.end.tolist(), language.tolist(), margin.tolist(), split.letters.tolist())
                for t, (b, e, k, m, n) in ((t, p) for i, (t, w) in enumerate(zip(split.text.tolist(), whole)) for p in cuts.get(i, (w,))):
                    if k < 0:
                        if last[0] == t:
                            out[-1][2] = e
                    elif (t, k) == last:
                        out[-1][2], out[-1][4], out[-1][5] = e, out[-1][4] + m * n, out[-1][5] + n
                    else:
                        out.append([ids[at + t], b, e, model.languages[k], m * n, n])
                        last = (t, k)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            columns.append(pa.array([float(_confidence(r[4] / max(r[5], 1))) for r in out], pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "start", "end", "lang", "confidence"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row_id bigint, start int, end int, lang string, confidence double")


def label_corrections(df: DataFrame, key: str, text: str, label: str, profiles: Profiles, min_letters: int = MIN_LETTERS) -> DataFrame:
    """row_id, lang: the languages of the texts of at least min_letters letters whose label is missing, names a language
    that the text isn't in, or that hold whole sentences in several languages."""
    found = text_languages(df, key, text, profiles, label).where((F.col("n_letters") >= min_letters) & (F.size("langs") > 0))
    given = clean_label(F.col(f"keep_{label}"))
    wrong = given.isNull() | ~F.array_contains("langs", F.coalesce(given, F.lit(""))) | (F.size("langs") > 1)
    return found.where(wrong).select("row_id", F.explode("langs").alias("lang"))
