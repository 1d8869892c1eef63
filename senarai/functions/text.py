"""The text stages as column functions: case folding, cleansing, slang, elongation, tokens, stopwords, stems.

All are expressions the optimizer sees; none needs Python on the workers. A null text is treated as the empty one.
Character classes are spelled out, so that results don't depend on a regular-expression engine's idea of a word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0b\x{85}\p{Z}"
TRIMMED = " \t\n\r\x00\x0b"
MIN_CHARS = 3
#: Blocks of emoji and symbols that are removed; later blocks are kept on purpose.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"


def case_fold(text: Column) -> Column:
    return F.lower(text)


def cleanse(text: Column) -> Column:
    """Drops links, addresses, repost markers, mentions, tags, quotes and emoji; squeezes !, ?, . and blanks.

    Other punctuation and digits stay: that is what the specified behaviour keeps.
    """
    steps = (
        (rf"https?://[^{SPACE}]+", " "),
        (rf"(?<![{WORD}])[{WORD}.+-]+@[{WORD}.-]+\.[a-z]{{2,}}(?![{WORD}])", " "),
        (rf"(?<![{WORD}])(?:rt|via)(?![{WORD}])", " "),
        (rf"[@#][{WORD}]+", " "),
        ("[\"']", " "),
        ("!{2,}", "!"),
        (r"\?{2,}", "?"),
        (r"\.{2,}", "."),
        (EMOJI, " "),
        (rf"[{SPACE}]+", " "),
    )
    return F.btrim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text), F.lit(TRIMMED))


def letters_only(text: Column) -> Column:
    """The strict cleansing that keeps letters and blanks only."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, rf"[^\p{{L}}{SPACE}]", " "), rf"[{SPACE}]+", " "), F.lit(TRIMMED))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda t: t != "")


def normalize_slang(text: Column) -> Column:
    """Whole tokens replaced by the dictionary; a token with punctuation attached is left alone."""
    table = F.create_map(*[F.lit(x) for pair in lexicons.SLANG.items() for x in pair])
    return F.array_join(F.transform(tokenize(text), lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def squeeze_elongation(text: Column) -> Column:
    """Any character repeated three times or more becomes one, digits too."""
    return F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1")


def drop_stopwords(tokens: Column) -> Column:
    """Tokens of more than two characters outside the stop list, order and repetitions kept."""
    return F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*lexicons.STOPWORDS))


def stem(word: Column) -> Column:
    """One suffix off words of more than 5 characters, then one prefix off what still has more than 6."""
    suffixes, prefixes = "|".join(lexicons.SUFFIXES), "|".join(lexicons.PREFIXES)
    ended = F.when(F.length(word) > 5, F.regexp_replace(word, rf"(?:{suffixes})\z", "")).otherwise(word)
    begun = F.when(F.length(ended) > 6, F.regexp_replace(ended, f"^(?:{prefixes})", "")).otherwise(ended)
    return F.when((F.length(word) < 4) | word.isin(*lexicons.UNSTEMMED), word).otherwise(begun)


def stem_tokens(tokens: Column) -> Column:
    return F.transform(tokens, stem)


def too_short(text: Column) -> Column:
    """Texts of fewer than three characters pass through no stage."""
    return F.length(F.btrim(text, F.lit(TRIMMED))) < MIN_CHARS


def classifier_text(text: Column) -> Column:
    """Lower-cased letters and single blanks, the form the classifier reads."""
    return letters_only(F.lower(text))


def clean_label(label: Column) -> Column:
    return F.lower(F.btrim(label, F.lit(TRIMMED)))


def sentiment_synonym(label: Column) -> Column:
    """English or Indonesian class names to the Indonesian ones; anything else, and null, is netral."""
    name = clean_label(label)
    return F.when(name.isin("positive", "positif"), "positif").when(name.isin("negative", "negatif"), "negatif").otherwise("netral")


def capitalize_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000_000))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def percent(share: Column, digits: int) -> Column:
    """A share as a percentage with fixed digits and thousands separators."""
    return F.format_number(F.round(share * 100, digits), digits)
