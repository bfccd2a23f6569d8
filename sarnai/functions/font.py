"""Text for fonts whose glyphs are written by rules learned as counts: back-off lookup and the best segmentation.

The rule tables are closed lists of a font family (a few thousand entries), checked against ``MOST_RULES`` before
they travel with the plan.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarnai.functions.text import dashes_to_vertical, rewrite
from sarnai.ship import ship

# Limits, marks and letters of the rules.
SPAN, CONTEXT_COUNT, FINAL_BONUS = 2, 3, 100.0
FINAL_LONG_A, NOT_BEFORE_IT = "aˉ", "aeiouöübkp"
MACRONS = [("ā", "aˉ"), ("ē", "eˉ"), ("ī", "iˉ"), ("ō", "oˉ"), ("ū", "uˉ"), ("ȫ", "öˉ"), ("ǖ", "üˉ")]
LETTERS = "a-zāēīōūȫǖöüγčšǰˉ"
MARKS_FROM, MARKS_TO = ",.!?-", "︐︒︕︖\u202f"
SPINE, WORD_SPACE = "_", "  "
MOST_RULES = 200_000


def split_latin(word: Column) -> Column:
    return rewrite(F.regexp_replace(F.lower(F.trim(word)), r"(?U)\s+", "-"), MACRONS)


def between(chunk: Column) -> Column:
    """Marks in their vertical form, a hyphen as narrow blank, blanks and the dash; the rest goes."""
    kept = F.regexp_replace(chunk, r"(?U)[^\s,.!?\x{FE31}-]", "")
    return F.translate(kept, MARKS_FROM, MARKS_TO)


class Rules:
    """tables: rule -> key -> chunk -> count; rates: unit -> rate."""

    def __init__(self, tables: dict[str, dict[str, dict[str, int]]], rates: dict[str, float]):
        self.tables, self.rates = tables, rates

    def chunk(self, place: str, before: str, unit: str, after: str) -> tuple[str, float] | None:
        """The commonest way to write a unit there, and its share, from the narrowest table with enough counts."""
        asks = (("r_tri", (place, before, unit, after), CONTEXT_COUNT), ("r_prev", (place, before, unit), CONTEXT_COUNT), ("r_next", (place, unit, after), CONTEXT_COUNT),
                ("r_pos", (place, unit), 1), ("r_uni", (unit,), 1))
        for table, key, least in asks:
            ways = self.tables[table].get("|".join(key))
            if ways and (total := sum(ways.values())) >= least:
                best = max(ways, key=ways.get)
                return best, ways[best] / total
        return None

    def word(self, s: str) -> str:
        """The segmentation of the best summed log score; a word without one stays."""
        reach: dict[int, tuple[float, str]] = {0: (0.0, "")}
        for end in range(1, len(s) + 1):
            ways = []
            for begin in range(max(0, end - SPAN), end):
                unit = s[begin:end]
                if begin not in reach or unit not in self.tables["r_uni"]:
                    continue
                first, last = begin == 0, end == len(s)
                place = {(True, True): "S", (True, False): "I", (False, True): "F", (False, False): "M"}[first, last]
                found = self.chunk(place, "#" if first else s[begin - 1], unit, "#" if last else s[end])
                if found is None:
                    continue
                score = reach[begin][0] + math.log(self.rates.get(unit, 1e-3) + 1e-9) + math.log(found[1])
                if unit == FINAL_LONG_A and last and (first or s[begin - 1] not in NOT_BEFORE_IT):
                    score += FINAL_BONUS
                ways.append((score, -begin, reach[begin][1] + found[0]))
            if ways:
                top = max(w[0] for w in ways)
                best = max((w for w in ways if w[0] == top), key=lambda w: w[1])
                reach[end] = (best[0], best[2])
        return reach[len(s)][1] if len(s) in reach else s


def rules_of(rows: DataFrame, rates: DataFrame) -> Rules:
    """From rule, key, chunk, n and unit, rate; both bounds are checked."""
    found = rows.limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} font rules")
    tables: dict = {t: {} for t in ("r_uni", "r_pos", "r_prev", "r_next", "r_tri")}
    for rule, key, chunk, n in found:
        tables.setdefault(rule, {}).setdefault(key, {})[chunk] = n
    spaces = rates.limit(MOST_RULES + 1).collect()
    if len(spaces) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rates")
    return Rules(tables, dict(map(tuple, spaces)))


def translit_to_font(texts: DataFrame, key: str, text: str, rules: Rules) -> DataFrame:
    """key and record: words by the rules, each distinct one once; what is between them by marks."""
    spark = texts.sparkSession
    ship(spark)

    def write(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(lambda w: rules.word(unicodedata.normalize("NFC", w)))

    write.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    runs = F.regexp_extract_all(dashes_to_vertical(F.col(text)), F.lit(rf"(?iu)([{LETTERS}]+|[^{LETTERS}]+)"), F.lit(1))
    parts = texts.select(key, F.posexplode_outer(runs).alias("_pos", "_part")).withColumn("_is", F.col("_part").rlike(rf"(?iu)^[{LETTERS}]"))
    words = parts.where("_is").select("_part").distinct().withColumn("_made", F.pandas_udf(write, "string")(split_latin(F.col("_part"))))
    joined = parts.join(words, "_part", "left").withColumn("_out", F.coalesce("_made", between(F.col("_part")), F.lit("")))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_out"))), lambda s: s["_out"]), "").alias("record"))


def space_pairs(records: DataFrame, key: str, record: str, gaps: DataFrame) -> DataFrame:
    """key and fitted: as many stem pieces between two symbols as the font's table (pair, n) says; blanks are doubled."""
    record = F.col(record)
    at = F.sequence(F.lit(1), F.length(record))
    pair = lambda i: F.when(i > 1, F.substring(record, i - 1, F.lit(2)))
    symbols = F.when(F.length(record) > 0, F.transform(at, lambda i: F.struct(i.alias("at"), F.substring(record, i, F.lit(1)).alias("ch"), pair(i).alias("pair"))))
    rows = records.select(key, F.explode_outer(symbols).alias("s")).select(key, "s.*")
    rows = rows.join(gaps.groupBy("pair").agg(F.max("n").alias("n")), "pair", "left")
    piece = F.concat(F.repeat(F.lit(SPINE), F.coalesce("n", F.lit(0)).cast("int")), F.when(F.col("ch") == " ", WORD_SPACE).otherwise(F.col("ch")))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))), lambda s: s["piece"]), "").alias("fitted"))


def fit_charset(text: Column, have: str, substitutes: dict[str, str]) -> Column:
    """Symbols the font lacks become their substitutes if it has those, else a blank unless one is there already."""
    able = {a: b for a, b in substitutes.items() if all(c == " " or c in have for c in b)}
    known = F.create_map(*(F.lit(x) for pair in able.items() for x in pair)) if able else F.create_map().cast("map<string,string>")
    ok = lambda c: c.isin(*have, " ", "\n") | c.rlike(r"^\p{Cf}$")

    def put(acc: Column, c: Column) -> Column:
        swapped = F.try_element_at(known, c)
        return F.when(ok(c), F.concat(acc, c)).when(swapped.isNotNull(), F.concat(acc, swapped)).when(acc.endswith(" "), acc).otherwise(F.concat(acc, F.lit(" ")))

    return F.aggregate(F.split(text, ""), F.lit(""), put)
