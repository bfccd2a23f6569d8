"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source. Weights 5, 2, 1 repeat over the sources in code point order, null last. Targets
share all sizes by weight but stop at ``MOST`` times the source's own size; what is above goes to the others by
weight until none is above. That fixed point is min(MOST * size, level * weight): the sources capped are the
first in the order of MOST * size / weight, so one running sum over the (few) sources finds the level.
The repetition rate is target / size. A document is taken floor(rate) times, and once more if a number in
[0, 1) from the hash of its id is below the fraction; the same ids, the same mix.

The sources, not the documents, are sorted in one task, and their sums make a row each of a few dozen bytes: ten million sources
take it a few hundred megabytes, which it sorts on disk. Null texts have size 0. Repeated rows are taken alike. A null id draws
its own number. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sarnai.llm.common import WORD, materialize, unused

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
BROADCAST_ROWS = 10_000  # sources, at most, for their rates to be broadcast


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) of 52 bits of the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows of source and size."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    cap = (MOST * F.col("source_size")).cast("long")
    sources = sources.withColumn("weight", weight.cast("long")).withColumn("cap", cap)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumns(
        {
            "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(onward)
        }
    )
    # the level is the first at which the source in turn is not above its cap
    holds = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    sources = sources.withColumn("level", F.first(holds, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return sources.select("source", "source_size", target.alias("target"))


def _with_rates(rows: DataFrame, found: DataFrame, of: str = "_mix_source") -> DataFrame:
    """Every row with the totals of its source; broadcast only if they are few, else a shuffled join that AQE splits."""
    found = found.withColumnsRenamed({"source": of})
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    return rows.join(found, rows["source"].eqNullSafe(found[of]), "inner").drop(of)


def copies(doc_id: Column, source_size: Column, target: Column) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + (draw(doc_id) < rate - F.floor(rate)).cast("long")).cast("long")


def mix_report(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    sizes = materialize(documents.select("doc_id", "source", text_size(F.col("text")).alias("size")), "mix-sizes")
    found = materialize(targets(sizes), "mix-targets")
    taken = F.col("size") * copies(F.col("doc_id"), F.col("source_size"), F.col("target"))
    return _with_rates(sizes, found).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(documents: DataFrame) -> DataFrame:
    """The mix itself: each row of documents as often as it is taken, its columns unchanged, whatever their names."""
    of, total, target, copy = (unused(documents.columns, name) for name in ("_mix_source", "_mix_size", "_mix_target", "_mix_copy"))
    sizes = documents.select("source", text_size(F.col("text")).alias("size"))
    found = materialize(targets(sizes), "mix-targets").withColumnsRenamed({"source_size": total, "target": target})
    n = copies(F.col("doc_id"), F.col(f"`{total}`"), F.col(f"`{target}`")).cast("int")
    rows = _with_rates(documents, found, of).withColumn(copy, F.explode(F.array_repeat(F.lit(0), n)))
    return rows.select(*(F.col(f"`{c}`") for c in documents.columns))


SQL = """
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS cap FROM per
), weighs AS (
  SELECT list(struct_pack(source := source, source_size := source_size, weight := weight, cap := cap)) AS ws, sum(source_size) AS total FROM weighed
), shares AS (  -- sources above their cap are held to it and the rest is shared again, until none is above
  SELECT 0 AS i, ws, ws[1:0] AS held, total::DOUBLE / list_sum(list_transform(ws, lambda w: w.weight))::DOUBLE AS lvl FROM weighs
  UNION ALL
  SELECT i + 1, open, next, CASE WHEN len(open) > 0 THEN ((SELECT total FROM weighs) - list_sum(list_transform(next, lambda w: w.cap)))::DOUBLE / list_sum(list_transform(open, lambda w: w.weight))::DOUBLE END
  FROM (SELECT i, list_filter(ws, lambda w: w.cap >= lvl * w.weight) AS open, list_concat(held, list_filter(ws, lambda w: w.cap < lvl * w.weight)) AS next, len(held) AS before FROM shares) WHERE len(next) > before
), last_share AS (
  SELECT ws, held, lvl FROM shares QUALIFY row_number() OVER (ORDER BY i DESC) = 1
), targets AS (
  SELECT w.source AS source, w.source_size AS source_size, lvl * w.weight AS target FROM (SELECT unnest(ws) AS w, lvl FROM last_share)
  UNION ALL SELECT w.source, w.source_size, w.cap::DOUBLE FROM (SELECT unnest(held) AS w FROM last_share)
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0
    < rate - floor(rate))::INT))::BIGINT AS taken
FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source
"""
