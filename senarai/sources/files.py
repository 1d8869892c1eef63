"""Delimited and JSON sources and sinks with the dialect of the specification: all strings, empty cells empty."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TRIMMED
from .schema import SchemaError, _quoted

MAX_NAME = 50
UPLOAD_SUFFIXES = (".csv", ".txt")
#: Rows that a preview shows, by what it is of.
PREVIEW_ROWS = {"preprocess": 2_000, "labelling": 2_000, "classification": 100, "evaluation": 100, "review": 100}


def check_upload(path: str, method_name: str | None = None) -> None:
    """Arguments of an upload: a .csv or .txt file, a method name of at most 50 characters."""
    if not path.lower().endswith(UPLOAD_SUFFIXES):
        raise ValueError("a csv or txt file is needed")
    if method_name is not None and not 0 < len(method_name) <= MAX_NAME:
        raise ValueError("a method name has 1 to 50 characters")


def read_csv(spark: SparkSession, path: str, limit: int | None = None, trim: bool = False, multiline: bool = True) -> DataFrame:
    """All columns as strings, empty and missing cells as ''. trim: blanks around cells and names are cut. limit: the first
    rows of the file, or of a folder's files in the order of their names.

    Quotes inside quoted fields are doubled. multiline=False lets one large file be split over tasks where no field
    holds a line break. Blank lines are dropped, surplus cells cut, a byte-order mark is removed by the reader. A file that
    isn't there raises SchemaError.
    """
    try:
        df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, escape='"', quote='"')
    except AnalysisException as reason:
        raise SchemaError(f"can't read {path}: {reason.getCondition()}") from reason
    if limit is not None:
        order = ("__file", "__at")
        placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
        df = placed.orderBy(*order).limit(limit).drop(*order)
    cell = lambda c: F.btrim(F.col(c), F.lit(TRIMMED)) if trim else F.col(c)
    return df.select(*[F.coalesce(cell(_quoted(c)), F.lit("")).alias(c.strip() if trim else c) for c in df.columns])


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """Rows with a number that follows their order in the source: unique and increasing, not dense."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str, *columns: str) -> None:
    """A folder of part files with a header; nulls are written as empty cells."""
    chosen = columns or tuple(df.columns)
    df.select(*[F.coalesce(F.col(_quoted(c)).cast("string"), F.lit("")).alias(c) for c in chosen]).write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_preprocessed(df: DataFrame, path: str) -> None:
    out = df.select(F.col("stemming").alias("preprocessed"), *(["sentiment"] if "sentiment" in df.columns else []))
    write_csv(out, path)


def write_labelled(df: DataFrame, path: str) -> None:
    write_csv(df, path, "raw", "sentiment", "confidence")


def write_predictions(df: DataFrame, path: str) -> None:
    write_csv(df, path, "text", "actual_label", "predicted_label", "confidence")


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A whole result set as a reloadable store."""
    if fmt not in ("parquet", "json", "orc"):
        raise SchemaError(f"unknown format {fmt}")
    df.write.mode("overwrite").format(fmt).save(path)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def remove_results(spark: SparkSession, path: str) -> bool:
    """Deletes a stored result, wherever the path's file system is; False if there was none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (section, line, cells) as one ordered text of ragged comma-separated rows."""
    quoted = F.transform("cells", lambda c: F.when(c.rlike('[",\\n ]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    text = lines.orderBy("section", "line").select(F.array_join(quoted, ",").alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)
