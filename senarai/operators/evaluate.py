"""Metrics of predictions: per class, macro, accuracy, confusion matrix, comparison of methods, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import LABELS
from ..functions.text import capitalize_first, clean_label, percent


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * (p * r) / F.when(p + r > 0, p + r).otherwise(1.0)).otherwise(0.0)


def cells(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by columns, actual, predicted, n: counts of cleaned labels, null as ''. The one pass over the data; everything
    else is derived from this table of a few rows."""
    label = lambda c: F.coalesce(clean_label(F.col(c)), F.lit(""))
    return df.groupBy(*by, label(actual).alias("actual"), label(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, label, tp, fp, fn, precision, recall, f1_score for the three classes, present or not.

    Rows with other labels count as false positives or negatives of the known side.
    """
    scaffold = counted.select("*", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    a, p, n, c = F.col("actual"), F.col("predicted"), F.col("n"), F.col("label")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    sums = scaffold.groupBy(*by, "label").agg(
        total((a == c) & (p == c)).alias("tp"), total((a != c) & (p == c)).alias("fp"), total((a == c) & (p != c)).alias("fn")
    )
    tp = F.col("tp")
    out = sums.withColumn("precision", _ratio(tp, tp + F.col("fp"))).withColumn("recall", _ratio(tp, tp + F.col("fn")))
    return out.withColumn("f1_score", _f1(F.col("precision"), F.col("recall")))


def method_metrics(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, sample_count, correct, accuracy, precision, recall, f1_score: macro means over exactly three classes."""
    macro = class_metrics(counted, by).groupBy(*by).agg(
        F.sum("tp").alias("correct"),
        *[(F.sum(m) / len(LABELS)).alias(m) for m in ("precision", "recall", "f1_score")],
    )
    totals = counted.groupBy(*by).agg(F.sum("n").alias("sample_count"))
    joined = macro.join(totals, list(by)) if by else macro.join(F.broadcast(totals))
    return joined.select(*by, "sample_count", "correct", _ratio(F.col("correct"), F.col("sample_count")).alias("accuracy"), "precision", "recall", "f1_score")


def confusion(counted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, actual, predicted, n, total_samples, pct over the full 3 x 3 scaffold; total and pct count all rows."""
    zero = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(p).alias("p")) for a in LABELS for p in LABELS]))
    full = counted.select(*by, "actual", "predicted", "n", zero.alias("cell"))
    hit = (F.col("actual") == F.col("cell.a")) & (F.col("predicted") == F.col("cell.p"))
    out = full.groupBy(*by, F.col("cell.a").alias("actual"), F.col("cell.p").alias("predicted")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n"), F.sum("n").alias("total_samples")
    )
    return out.withColumn("pct", F.round(_ratio(F.col("n"), F.col("total_samples")) * 100, 2))


def confusion_metrics(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1_score from the in-matrix rows only, with accuracy, correct, incorrect of all rows."""
    rows = matrix.select("*", F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    a, p, c, n = F.col("actual"), F.col("predicted"), F.col("label"), F.col("n")
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    per = rows.groupBy("label").agg(
        total((a == c) & (p == c)).alias("tp"), total(a == c).alias("row_n"), total(p == c).alias("col_n"),
        total(a == p).alias("correct"), F.max("total_samples").alias("total_samples"),
    )
    per = per.withColumn("precision", _ratio(F.col("tp"), F.col("col_n"))).withColumn("recall", _ratio(F.col("tp"), F.col("row_n")))
    return per.select(
        "label", "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1_score"),
        _ratio(F.col("correct"), F.col("total_samples")).alias("accuracy"), "correct", (F.col("total_samples") - F.col("correct")).alias("incorrect"),
    )


def compare(methods: DataFrame, method: str, first_seen: str) -> DataFrame:
    """methods with `place`: by accuracy, equal ones in order of first_seen. One row a method, so one task sorts them."""
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("accuracy"), F.asc(first_seen), F.asc(method))
    return methods.withColumn("place", F.row_number().over(order))


def best_method(methods: DataFrame, method: str, first_seen: str) -> DataFrame:
    """best_method, best_accuracy: the first of the strictly largest accuracy; null if every accuracy is 0."""
    top = methods.where("accuracy > 0").orderBy(F.desc("accuracy"), F.asc(first_seen), F.asc(method)).limit(1)
    return top.agg(F.first(method).alias("best_method"), F.coalesce(F.first("accuracy"), F.lit(0.0)).alias("best_accuracy"))


def report(ranked: DataFrame, method: str, best: DataFrame, matrix: DataFrame | None = None, title: str = "") -> DataFrame:
    """section INT, line INT, cells ARRAY<STRING>: the comparison, the best method and, if given, a confusion matrix."""
    spark = ranked.sparkSession
    line = lambda section, rows: spark.createDataFrame([(section, i, r) for i, r in rows], "section int, line int, cells array<string>")
    head = line(0, [(0, ["EVALUATION REPORT - COMPARISON RESULTS"]), (1, [""]), (2, ["Method Name", "Sample Count", "Accuracy (%)", "Precision (%)", "Recall (%)", "F1-Score (%)"])])
    pct = lambda c: percent(F.col(c), 2)
    body = ranked.select(
        F.lit(1).alias("section"), F.col("place").alias("line"),
        F.array(F.col(method), F.col("sample_count").cast("string"), pct("accuracy"), pct("precision"), pct("recall"), pct("f1_score")).alias("cells"),
    )
    text = F.coalesce(F.col("best_method"), F.lit(""))
    lines = F.array(F.array(F.lit("")), F.array(F.lit("Best Method:"), text), F.array(F.lit("Best Accuracy:"), F.concat(pct("best_accuracy"), F.lit("%"))))
    tail = best.select(F.lit(2).alias("section"), F.posexplode(lines).alias("line", "cells"))
    out = head.unionByName(body).unionByName(tail)
    if matrix is not None:
        top = line(3, [(0, [""]), (1, [f"CONFUSION MATRIX - {title}"]), (2, [""]), (3, ["Actual \\ Predicted", *[x.capitalize() for x in LABELS]])])
        place = F.array_position(F.array(*map(F.lit, LABELS)), F.col("actual")).cast("int") + 3
        number = lambda p: F.coalesce(F.sum(F.when(F.col("predicted") == p, F.col("n"))), F.lit(0)).cast("string")
        rows = matrix.groupBy("actual").agg(*[number(p).alias(p) for p in LABELS])
        grid = rows.select(F.lit(3).alias("section"), place.alias("line"), F.array(capitalize_first(F.col("actual")), *[F.col(p) for p in LABELS]).alias("cells"))
        out = out.unionByName(top).unionByName(grid)
    return out
