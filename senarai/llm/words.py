"""Terms and words of a text, as columns and in Python.

Term: maximal run of Unicode letters, lower-cased. Word: maximal run of Unicode letters and digits, lower-cased.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII_TERM = re.compile(r"[a-z]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_TERM = regex.compile(r"\p{L}+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def terms_of(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_TERM.findall(text.lower())
    return [t.lower() for t in _TERM.findall(text)]


def words_of(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(text)]


def term_array(text: Column) -> Column:
    """The terms of a text in the JVM. Lower-casing can change what is a letter only for two capitals (a dotted I
    becomes two characters, a Greek sigma depends on its neighbours); only texts with those are lower-cased per term."""
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"(\p{L}+)"), 1)
    odd = text.contains("İ") | text.contains("Σ")
    return F.when(odd, F.transform(runs(text), lambda t: F.lower(t))).otherwise(runs(F.lower(text)))
