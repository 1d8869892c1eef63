"""Which column of a table is the text, the label or to be dropped, decided once from the column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

DROP_KEYWORDS = ("score", "time", "at")
PREPROCESS_TEXT = ("ulasan", "text", "content", "message", "body")
LABELLING_TEXT = (*PREPROCESS_TEXT, "review")
CLASSIFIER_TEXT = ("text", "ulasan", "content", "message", "body", "review", "preprocessed", "tweet", "isi", "komentar", "teks")
CLASSIFIER_LABEL = ("label", "sentiment", "sentimen", "class", "category", "kategori", "target", "kelas")
EVALUATION_REQUIRED = ("text", "actual_label", "predicted_label", "confidence")


class SchemaError(ValueError):
    """A table lacks what an operation needs."""


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def drop_by_keyword(df: DataFrame, keywords: Sequence[str] = DROP_KEYWORDS) -> DataFrame:
    """Without the columns whose trimmed lower-case name contains a keyword."""
    kept = [c for c in df.columns if not any(k in c.strip().lower() for k in keywords)]
    return df.select(*map(_quoted, kept))


def exact_text_column(columns: Sequence[str], candidates: Sequence[str] = PREPROCESS_TEXT) -> str | None:
    """The first column with exactly a candidate's name, else the last column."""
    for c in columns:
        if c.strip().lower() in candidates:
            return c
    return columns[-1] if columns else None


def containing_text_column(columns: Sequence[str]) -> str | None:
    """The first column whose name contains a candidate, else the first column."""
    for c in columns:
        if any(k in c.strip().lower() for k in CLASSIFIER_TEXT):
            return c
    return columns[0] if columns else None


def containing_label_column(columns: Sequence[str]) -> str | None:
    """The first column whose name contains a candidate, else the second column, if any."""
    for c in columns:
        if any(k in c.strip().lower() for k in CLASSIFIER_LABEL):
            return c
    return columns[1] if len(columns) > 1 else None


def find_by_column(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The first column, in table order, that has one of the names; names are trimmed."""
    wanted = {n.lower() for n in names}
    return next((c for c in columns if c.strip().lower() in wanted), None)


def find_by_name(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The column of the first name, in name order, that the table has; names aren't trimmed."""
    lowered = [c.lower() for c in columns]
    return next((columns[lowered.index(n)] for n in names if n in lowered), None)


def is_labelled(columns: Sequence[str]) -> bool:
    lowered = {c.lower() for c in columns}
    return "raw" in lowered and bool(lowered & {"sentiment", "label"})


def missing(columns: Sequence[str], needed: Sequence[str] = EVALUATION_REQUIRED) -> list[str]:
    """The needed columns that a table lacks, case ignored."""
    return [n for n in needed if n not in {c.lower() for c in columns}]


def require(columns: Sequence[str], needed: Sequence[str] = EVALUATION_REQUIRED) -> None:
    if lacking := missing(columns, needed):
        raise SchemaError(f"missing columns: {', '.join(lacking)}")


def review_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """(sentiment column, text column) of a table for review; the text falls back to the first column."""
    sentiment = find_by_name(columns, ("sentiment", "label"))
    text = find_by_name(columns, ("raw", "text", "tweet", "content"))
    return sentiment, text or (columns[0] if columns else None)


def usable(df: DataFrame, text: str | None, label: str | None = None) -> DataFrame:
    """df, if it can be worked on: SchemaError for a table without columns, without rows, without the text column, or, where
    a label column is named, without a row that has both."""
    if not df.columns:
        raise SchemaError("the header is empty")
    if text is None or text not in df.columns:
        raise SchemaError("there is no text column")
    if df.isEmpty():
        raise SchemaError("there are no rows")
    if label is not None and (label not in df.columns or df.where(f"coalesce({_quoted(text)}, '') <> '' AND coalesce({_quoted(label)}, '') <> ''").isEmpty()):
        raise SchemaError("there are no labelled rows")
    return df
