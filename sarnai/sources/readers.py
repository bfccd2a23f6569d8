"""Readers of the event log, word lists and nested rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUEST = (
    "id long, created_at string, user_id long, username string, chat_id long, target string, source_script string, input_text string, translit string, "
    "todo string, cyrillic string, elapsed_ms double, steps_json string, ok int, error string, letters_json string"
)
FEEDBACK = "request_id long, created_at string, user_id long, username string, rating string, correction string"
EVENT = f"event string, {REQUEST}, request_id long, rating string, correction string"


def event_log(lines: DataFrame) -> DataFrame:
    """Raw lines (value), batch or stream -> route and the fields of every event. Blank lines are left out; a line
    that is no JSON object with a known event is ``broken``."""
    row = F.from_json("value", EVENT, {"mode": "PERMISSIVE"})
    parsed = lines.where(F.trim(F.col("value")) != "").select("value", row.alias("e"))
    known = F.col("e.event").isin("request", "feedback")
    return parsed.select(F.when(known, F.col("e.event")).otherwise("broken").alias("route"), "value", "e.*").drop("event")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    return event_log(spark.read.text(path))


def stream_event_log(spark: SparkSession, path: str) -> DataFrame:
    return event_log(spark.readStream.text(path))


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocabulary with frequencies, trusted words, protected words) of a word list: word, n, kind d, k or r."""
    rows = spark.read.csv(path, sep="\t", schema="word string, n long, kind string")
    vocabulary = rows.where(F.col("kind").isin("d", "k")).groupBy("word").agg(F.max("n").alias("n"))
    return vocabulary, rows.where("kind = 'd'").select("word").distinct(), rows.where("kind = 'r'").select("word").distinct()


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="word string, n long")


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """font, pair, n of a JSON file that maps fonts to pairs to counts."""
    text = spark.read.text(path, wholetext=True)
    fonts = text.select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("font", "pairs"))
    return fonts.select("font", F.explode("pairs").alias("pair", "n"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule, key, chunk, n of a JSON file of nested count tables."""
    text = spark.read.text(path, wholetext=True)
    rules = text.select(F.explode(F.from_json("value", "map<string,map<string,map<string,long>>>")).alias("rule", "keys"))
    return rules.select("rule", F.explode("keys").alias("key", "chunks")).select("rule", "key", F.explode("chunks").alias("chunk", "n"))


def largest_size(sizes: Column) -> Column:
    """The entry of the largest area of array<struct<url,width,height>>; ties: the first."""
    area = lambda s: F.coalesce(s["width"], F.lit(0)) * F.coalesce(s["height"], F.lit(0))
    return F.aggregate(sizes, F.element_at(sizes, 1), lambda best, s: F.when(area(s) > area(best), s).otherwise(best))


def last_write_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at")
