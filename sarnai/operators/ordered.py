"""Operators over ordered rows: islands, merged spans, decoding, histograms, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of an equal value: by, value, run number and length."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    return rows.withColumn("run", F.sum(first).over(w)).groupBy(*by, "run", value).agg(F.count("*").alias("length"))


def merged_spans(rows: DataFrame, by: list[str], begin: str, end: str, gap: Column) -> DataFrame:
    """Spans merged while the next begins within gap of all ends so far."""
    w = Window.partitionBy(*by).orderBy(begin, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(begin) - before > gap), 1).otherwise(0)
    marked = rows.withColumn("_new", new)
    grouped = marked.withColumn("group", F.sum("_new").over(w))
    return grouped.groupBy(*by, "group").agg(F.min(begin).alias("begin"), F.max(end).alias("end"), F.count("*").alias("n"))


def ctc_decode(frames: DataFrame, by: list[str], order: list[str], label: str, probability: str, blank: int = 0) -> DataFrame:
    """Greedy: repeats of the frame before and blanks drop. Confidence is over all frames that are not blank."""
    w = Window.partitionBy(*by).orderBy(*order)
    rank = F.row_number().over(w)
    kept = (F.col(label) != blank) & ~F.col(label).eqNullSafe(F.lag(label).over(w))
    marked = frames.withColumns({"_at": rank, "_kept": kept})
    labels = F.transform(F.array_sort(F.collect_list(F.when(F.col("_kept"), F.struct("_at", label)))), lambda s: s[label])
    inked = F.col(label) != blank
    return marked.groupBy(*by).agg(labels.alias("labels"), F.round(F.avg(F.when(inked, F.col(probability))), 4).alias("confidence"), F.count_if(inked).alias("inked"))


def otsu(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The first threshold of largest between-class variance, from a histogram: one row per bin is windowed."""
    bins = rows.groupBy(*by, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("v")
    every = Window.partitionBy(*by)
    n0, s0 = F.sum("n").over(w), F.sum(F.col("n") * F.col("v")).over(w)
    n, s = F.sum("n").over(every), F.sum(F.col("n") * F.col("v")).over(every)
    cum = bins.select(*by, "v", n0.alias("n0"), s0.alias("s0"), n.alias("n"), s.alias("s"))
    gap = F.col("n") * F.col("s0") - F.col("n0") * F.col("s")
    score = F.when(F.col("n0") < F.col("n"), F.round(gap.cast("double") * gap / (F.col("n0") * (F.col("n") - F.col("n0"))), 3))
    return cum.withColumn("score", score).groupBy(*by).agg(F.max_by("v", F.struct("score", -F.col("v"))).alias("threshold"), F.max("n").alias("n"))


def calls_in_window(rows: DataFrame, by: list[str], at_seconds: Column, seconds: int) -> DataFrame:
    """How many calls each call's last seconds hold, itself and its ties included."""
    w = Window.partitionBy(*by).orderBy("_at").rangeBetween(-seconds, Window.currentRow)
    return rows.withColumn("_at", at_seconds).withColumn("in_window", F.count("*").over(w)).drop("_at")


def greedy_pack(sizes: Column, limit: int, separator: int = 2) -> Column:
    """Sums of consecutive sizes packed up to a limit; a size over it stands alone."""
    last = lambda acc: F.element_at(acc, -1)

    def put(acc: Column, n: Column) -> Column:
        fits = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + separator + n <= limit)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(last(acc) + separator + n))).otherwise(F.concat(acc, F.array(n)))

    return F.aggregate(sizes, F.array().cast("array<int>"), put)


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    raised = F.transform(values, lambda x: F.exp(x.cast("double") - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))
