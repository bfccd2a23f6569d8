"""From read columns to a page's text: junk, margins, unsure words, tight gaps, the choice among turned readings.

A column row holds page_id, col, text, probs (one a symbol) and its box x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of the reader's alphabet and thresholds.
MARKS = " ᠂᠃︱︖︕"
NARROW, LONG = "\u202f", "\u1843"
VOWELS = "ᠠᡄᡅᡆᡇᡈᡉ"
LETTERS, VARIANTS = "ᠠ-ᢪ", "᠋-᠏"
UNSURE, JUNK_MEAN, JUNK_SHARE, UNREADABLE_LETTERS = 0.9, 0.8, 0.5, 7
TURN_GAIN, TURN_CONFIDENCE, FEW_LETTERS, MIN_LETTERS = 1.5, 0.85, 10, 2
PIXELS_A_FRAME = 4
LATIN_FROM, LATIN_TO = "᠂᠃︖︕︱᠅᠀", ",.?!—."  # the last mark goes


def median(values: Column) -> Column:
    v, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(v, low) + F.get(v, high)) / 2)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values))


def symbols(text: Column, probs: Column) -> Column:
    """array<struct<ch,p>> of a text of the basic plane and its probabilities."""
    return F.transform(probs, lambda p, i: F.struct(F.substring(text, i + 1, F.lit(1)).alias("ch"), p.alias("p")))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{MARKS}{NARROW}]", ""))


def is_junk(text: Column, probs: Column) -> Column:
    """Too few letters for a word, or unsure of most of them."""
    kept = F.filter(symbols(text, probs), lambda s: ~s["ch"].isin(*MARKS, NARROW, LONG))
    p = F.transform(kept, lambda s: s["p"])
    n = F.size(p)
    unsure = F.size(F.filter(p, lambda x: x < UNSURE)) >= JUNK_SHARE * n
    return F.coalesce((n < 2) | ((n < 3) & (median(p) < UNSURE)) | ((mean(p) < JUNK_MEAN) & unsure), F.lit(True))


def mark_columns(columns: DataFrame) -> DataFrame:
    """junk, margin (a short column above or below all tall ones) and unreadable (junk of a neighbour's size)."""
    page = Window.partitionBy("page_id")
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = columns.withColumn("junk", is_junk(F.col("text"), F.col("probs")))
    rows = rows.withColumns({"_n": F.count("*").over(page), "_w": F.percentile(wide, 0.5).over(page)})
    tall = high >= 2 * F.col("_w")
    rows = rows.withColumns({"_top": F.min(F.when(tall, F.col("y0"))).over(page), "_bottom": F.max(F.when(tall, F.col("y1"))).over(page)})
    outside = (F.col("y0") >= F.col("_bottom")) | (F.col("y1") <= F.col("_top"))
    rows = rows.withColumn("margin", F.coalesce((F.col("_n") >= 3) & ~tall & outside, F.lit(False)))
    good = ~F.col("junk")
    rows = rows.withColumns({
        "_kept": F.count_if(good).over(page), "_kw": F.percentile(F.when(good, wide), 0.5).over(page), "_kh": F.max(F.when(good, high)).over(page),
    })
    alike = wide.between(0.6 * F.col("_kw"), 1.6 * F.col("_kw")) & high.between(2 * F.col("_kw"), 1.15 * F.col("_kh"))
    rows = rows.withColumn("unreadable", F.coalesce((F.col("_kept") >= 3) & ~good & (letters(F.col("text")) >= UNREADABLE_LETTERS) & alike, F.lit(False)))
    return rows.drop("_n", "_w", "_top", "_bottom", "_kept", "_kw", "_kh")


def trim_unsure(text: Column, probs: Column) -> Column:
    """array<array<struct<ch,p>>>: the words left when unsure words and marks at both ends are gone."""
    start = F.array(F.array().cast("array<struct<ch:string,p:double>>"))

    def put(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.array(s))))
        return F.when(s["ch"] == " ", F.concat(acc, start)).otherwise(grown)

    words = F.filter(F.aggregate(symbols(text, probs.cast("array<double>")), start, put), lambda w: F.size(w) > 0)
    sure = lambda w: median(F.transform(w, lambda s: s["p"])) >= UNSURE
    bare = lambda w: F.forall(w, lambda s: s["ch"].isin(*MARKS))

    def between(ws: Column, good) -> Column:
        at = F.filter(F.transform(ws, lambda w, i: F.when(good(w), i)), lambda i: i.isNotNull())
        return F.when(F.size(at) == 0, F.slice(ws, 1, 0)).otherwise(F.slice(ws, F.array_min(at) + 1, F.array_max(at) - F.array_min(at) + 1))

    kept = between(words, sure)
    first = F.array_min(F.filter(F.transform(kept, lambda w, i: F.when(~bare(w), i)), lambda i: i.isNotNull()))
    kept = F.when(first.isNull(), F.slice(kept, 1, 0)).otherwise(F.slice(kept, first + 1, F.size(kept)))
    # unsure marks at the end of the last word that keeps anything
    loose = lambda s: s["ch"].isin(*MARKS) & (s["p"] < UNSURE)
    firm = lambda w: F.array_max(F.filter(F.transform(w, lambda s, i: F.when(~loose(s), i)), lambda i: i.isNotNull()))
    end = F.array_max(F.filter(F.transform(kept, lambda w, i: F.when(firm(w).isNotNull(), i)), lambda i: i.isNotNull()))
    kept = F.when(end.isNull(), F.slice(kept, 1, 0)).otherwise(F.slice(kept, 1, end + 1))
    return F.transform(kept, lambda w, i: F.when(i == F.size(kept) - 1, F.slice(w, 1, F.coalesce(firm(w), F.lit(-1)) + 1)).otherwise(w))


def words_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.array_join(F.transform(w, lambda s: s["ch"]), "")), " ")


def tight_gaps(text: Column, frames: Column, blank: Column) -> Column:
    """Of each symbol: a narrow blank with no empty stripe between its neighbours' frames. blank: flag of each pixel."""
    n = F.length(text)

    def tight(f: Column, i: Column) -> Column:
        inner = (F.substring(text, i + 1, F.lit(1)) == NARROW) & (i > 0) & (i < n - 1)
        begin, end = F.get(frames, i - 1) * PIXELS_A_FRAME, F.get(frames, i + 1) * PIXELS_A_FRAME + PIXELS_A_FRAME
        return F.coalesce(F.when(inner, ~F.exists(F.slice(blank, begin + 1, F.greatest(end - begin, F.lit(0))), lambda b: b)), F.lit(False))

    return F.transform(frames, tight)


def tidy(text: Column) -> Column:
    """Words of one or two letters without a vowel lose them, narrow blanks at marks and ends go, blanks collapse."""
    count = lambda w: F.regexp_count(w, F.lit(f"[{LETTERS}]"))

    def word(w: Column) -> Column:
        hollow = count(w).between(1, 2) & ~w.rlike(f"[{VOWELS}]")
        return F.when(hollow, F.regexp_replace(w, f"[{VARIANTS}{LETTERS}]", "")).otherwise(w)

    parts = F.regexp_extract_all(text, F.lit(f"([^ {NARROW}]+|[ {NARROW}]+)"), F.lit(1))
    c = F.array_join(F.transform(parts, word), "")
    c = F.regexp_replace(c, f"{NARROW}+(?=[{MARKS}]|$)|(?<=[{MARKS}]){NARROW}+|^{NARROW}+", "")
    c = F.regexp_replace(F.regexp_replace(c, f"{NARROW}+", NARROW), " +", " ")
    return F.trim(c)


def to_translit(todo: Column) -> Column:
    """A read line in transliteration: every gap is a blank, marks are Latin ones."""
    from sarnai.functions.text import todo_to_translit

    return F.translate(todo_to_translit(F.translate(todo, NARROW, " ")), LATIN_FROM, LATIN_TO)


def best_turn(readings: DataFrame) -> DataFrame:
    """Of page_id, turn, confidence, letters (turn 0 first): the reading to use.

    A turned reading wins over the best so far if it is sure, has letters enough and holds clearly more, or as much
    and surer. A page has four turns at most, so its readings are one small array."""
    row = F.struct("turn", "confidence", "letters")
    mass = lambda r: r["letters"] * r["confidence"]

    def better(best: Column, r: Column) -> Column:
        able = (r["confidence"] >= TURN_CONFIDENCE) & (r["letters"] >= FEW_LETTERS)
        more = best.isNull() | (mass(r) > TURN_GAIN * mass(best))
        surer = (r["confidence"] >= best["confidence"] + 0.03) & (mass(r) >= 0.9 * mass(best))
        return F.when(able & (more | surer), r).otherwise(best)

    every = readings.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("rs"))
    upright = F.try_element_at(F.filter("rs", lambda r: r["turn"] == 0), F.lit(1))
    chosen = F.aggregate(F.filter("rs", lambda r: r["turn"] != 0), upright, better)
    return every.select("page_id", chosen.alias("r")).where("r IS NOT NULL").select("page_id", "r.*")


def best_reading(readings: DataFrame) -> DataFrame:
    """Of page_id, candidate, confidence, letters: with letters first, then the surest, then the earliest."""
    w = Window.partitionBy("page_id").orderBy(F.desc((F.col("letters") >= MIN_LETTERS).cast("int")), F.desc("confidence"), "candidate")
    return readings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def flip_gain(columns: DataFrame, most: int = 4) -> DataFrame:
    """page_id and how much surer the tallest columns read upside down; up and down: probabilities of each way."""
    w = Window.partitionBy("page_id").orderBy(F.desc(F.col("y1") - F.col("y0")), "col")
    big = columns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, b: a + b)) / F.sum(F.size(c))
    return big.groupBy("page_id").agg(F.coalesce(total(F.col("down")) - total(F.col("up")), F.lit(0.0)).alias("gain"))
