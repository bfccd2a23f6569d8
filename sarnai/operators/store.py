"""Requests, feedback and settings as folds over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SETTINGS = ("fg", "bg", "size", "font", "fix_letters", "punctuation", "show_time", "mode")


def _latest(value: Column, seq: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), seq))


def fold_live(log: DataFrame, keys: list[str], seq: str, rating: str, correction: str) -> DataFrame:
    """Upsert by key: the last rating wins, the last correction that is not null stays, the first seq is the id.
    Rows with a null in the key are never merged."""
    whole = ~F.greatest(*(F.col(k).isNull().cast("int") for k in keys)).cast("boolean")
    merged = log.where(whole).groupBy(*keys).agg(
        F.min(seq).alias("first_seq"), F.max_by(rating, seq).alias("rating"), _latest(F.col(correction), F.col(seq)).alias("correction")
    )
    alone = log.where(~whole).select(*keys, F.col(seq).alias("first_seq"), F.col(rating).alias("rating"), F.col(correction).alias("correction"))
    return merged.unionByName(alone)


def restore_first_wins(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The recovery tool's rule: the first event of a key is kept, later ones are skipped."""
    names = [c for c in log.columns if c not in keys]
    whole = ~F.greatest(*(F.col(k).isNull().cast("int") for k in keys)).cast("boolean")
    kept = log.where(whole).groupBy(*keys).agg(F.min_by(F.struct(*names), seq).alias("row")).select(*keys, "row.*")
    return kept.unionByName(log.where(~whole).select(*keys, *names))


def fold_settings(log: DataFrame) -> DataFrame:
    """From user_id, field, value, seq; field 'reset' clears what came before it, but for mode."""
    reset = Window.partitionBy("user_id")
    rows = log.withColumn("reset_at", F.max(F.when(F.col("field") == "reset", F.col("seq"))).over(reset))
    live = (F.col("field") == "mode") | F.col("reset_at").isNull() | (F.col("seq") > F.col("reset_at"))
    value = lambda f: F.max_by(F.when(live, F.col("value")), F.when(live & (F.col("field") == f), F.col("seq"))).alias(f)
    return rows.groupBy("user_id").agg(*map(value, SETTINGS))


def nonempty_settings(folded: DataFrame) -> DataFrame:
    """user_id and a map of the settings that are neither null nor empty."""
    pairs = F.create_map(*(x for f in SETTINGS for x in (F.lit(f), F.col(f))))
    return folded.select("user_id", F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != "")).alias("settings"))


def export(feedback: DataFrame, requests: DataFrame, only_corrections: bool = False) -> DataFrame:
    """Feedback with its request, inner; ordered by the feedback's id."""
    if only_corrections:
        feedback = feedback.where(F.col("correction").isNotNull() & (F.col("correction") != ""))
    return feedback.join(requests, "request_id").orderBy("feedback_id")


def route_lines(lines: DataFrame) -> DataFrame:
    """value -> route (request, feedback, broken, blank) of raw log lines."""
    event = F.get_json_object("value", "$.event")
    known = event.isin("request", "feedback") & F.try_parse_json("value").isNotNull()
    return lines.withColumn("route", F.when(F.trim(F.col("value")) == "", "blank").when(known, event).otherwise("broken"))
