"""Sinks: event log lines and the export of feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarnai.shared import discard, materialize

BOM = "﻿"


def append_events(rows: DataFrame, event: str, path: str) -> None:
    """A JSON line per row, its event first, nulls kept; appended, so a log grows by files."""
    line = F.to_json(F.struct(F.lit(event).alias("event"), *rows.columns), {"ignoreNullFields": "false"})
    rows.select(line.alias("value")).write.mode("append").text(path)


def write_export(rows: DataFrame, path: str, order: str = "feedback_id") -> None:
    """CSV in the order of ids: the part files, joined in the order of their names, are one file with one byte order mark and header.
    No rows: the first column's name alone. Rows are quoted where they must be, with quotes doubled."""
    names = rows.columns
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = F.concat_ws(",", *(quoted(F.col(c).cast("string")) for c in names))
    spark = rows.sparkSession
    if rows.isEmpty():
        spark.createDataFrame([(BOM + order,)], "value string").write.text(path)
        return
    made = materialize(rows.orderBy(order).select(F.spark_partition_id().alias("_file"), F.monotonically_increasing_id().alias("_at"), line.alias("line")), "export")
    first = made.agg(F.min("_at")).first()[0]
    header = F.lit(BOM + ",".join(names) + "\r\n")
    text = F.when(F.col("_at") == first, F.concat(header, "line")).otherwise(F.col("line"))
    made.withColumn("value", text).repartitionByRange("_file").sortWithinPartitions("_at").select("value").write.option("lineSep", "\r\n").text(path)
    discard(made)
