"""Lexicon lookups, blocking, suffixes, joins of broken words and a character language model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarnai.functions.text import query_keys, skeleton, vowel_row

# What a letter may be written as, and the cost.
SUB_COST = {
    "ә": {"я": 0.3, "а": 0.5, "э": 0.8, "е": 1.0},
    "ө": {"о": 0.3, "ё": 0.5, "е": 2.0, "э": 2.0},
    "ү": {"у": 0.3, "ю": 0.5},
    "һ": {"г": 0.5, "х": 1.0, "": 2.5},
    "җ": {"ж": 0.3, "дж": 1.0},
    "ң": {"н": 0.3, "нг": 1.0},
}
COST_WEIGHT = 2.0
PEN_LIFT_GAIN, RARE = 10.0, 5
INITIAL_COST = 0.5
ORDER = 5
SUFFIX_PART = 2  # a hyphenated part of at most this is a suffix unless the dictionary has it


def words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos and lower-cased word of every run between blanks."""
    split = F.filter(F.split(F.lower(text), r"[ \n]+"), lambda w: w != "")
    return rows.select(key, F.posexplode(split).alias("pos", "word"))


def provenance(tokens: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """dict: the word is known; split: hyphenated, and every part is known or longer than a suffix; else model.
    Counts by key."""
    known = dictionary.select("word").distinct().withColumn("known", F.lit(True))
    types = tokens.select("word").distinct()  # each type is looked up once
    whole = types.join(known, "word", "left")
    parts = F.filter(F.split("word", "-"), lambda p: p != "")
    pieces = whole.where(F.col("known").isNull() & (F.size(parts) > 1)).select("word", F.explode(F.array_distinct(parts)).alias("part"))
    alone = F.coalesce("has", F.lit(False)) | (F.length("part") > SUFFIX_PART)
    split = pieces.join(known.select(F.col("word").alias("part"), F.lit(True).alias("has")), "part", "left").groupBy("word").agg(F.bool_and(alone).alias("splits"))
    source = F.when(F.col("known"), "dict").when(F.col("splits"), "split").otherwise("model")
    of_type = whole.join(split, "word", "left").select("word", source.alias("source"))
    counted = tokens.join(of_type, "word").groupBy(key)
    return counted.agg(*(F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("dict", "split", "model")))


def good_stems(counts: DataFrame, trusted: DataFrame | None = None, stem_freq: int = 3) -> DataFrame:
    """Words that occur often enough, and trusted ones."""
    stems = counts.where(F.col("n") >= stem_freq).select("word")
    return stems if trusted is None else stems.union(trusted.select("word")).distinct()


def mine_suffixes(counts: DataFrame, stem_min: int = 3, suffix_max: int = 5, stem_freq: int = 3, least: int = 30, trusted: DataFrame | None = None) -> DataFrame:
    """(row of the stem's vowels, suffix) with the summed frequency of words with a good stem; word, n in."""
    n = F.length("word")
    low, high = F.greatest(n - suffix_max, F.lit(stem_min)), n - 1
    long = counts.where(~F.col("word").contains("-") & (high >= low))
    cuts = long.select("word", "n", F.explode(F.sequence(low, high)).alias("k"))
    cuts = cuts.select("n", F.col("word").substr(F.lit(1), F.col("k")).alias("stem"), F.col("word").substr(F.col("k") + 1, F.lit(1 << 20)).alias("suffix"))
    stems = good_stems(counts, trusted, stem_freq).withColumnRenamed("word", "stem")
    sums = cuts.join(stems, "stem", "left_semi").groupBy(vowel_row(F.col("stem")).alias("vowels"), "suffix").agg(F.sum("n").alias("freq"))
    return sums.where(F.col("freq") >= least)


def protected_prefix(types: DataFrame, protected: DataFrame) -> DataFrame:
    """Words that are protected or have a protected prefix of length in [max(4, len - 4), len - 1]."""
    n = F.length("word")
    prefixes = F.when(n - 1 >= F.greatest(F.lit(4), n - 4), F.transform(F.sequence(F.greatest(F.lit(4), n - 4), n - 1), lambda k: F.col("word").substr(F.lit(1), k)))
    keys = F.concat(F.array("word"), F.coalesce(prefixes, F.array().cast("array<string>")))
    return types.select("word", F.explode(keys).alias("key")).join(protected.select(F.col("word").alias("key")).distinct(), "key", "left_semi").select("word").distinct()


def should_join(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    """a, b -> join: the joined word is known and at least as common as the rarer part."""
    for name, c in (("n_a", F.col("a")), ("n_b", F.col("b")), ("n_ab", F.concat("a", "b"))):
        pairs = pairs.withColumn("word", c).join(freq.withColumnRenamed("n", name), "word", "left").drop("word")
    zero = lambda c: F.coalesce(c, F.lit(0))
    ok = (zero(F.col("n_ab")) > 0) & (F.col("n_ab") >= F.least(zero(F.col("n_a")), zero(F.col("n_b"))))
    return pairs.select("a", "b", F.coalesce(ok, F.lit(False)).alias("joined"))


def goes_right(triples: DataFrame, freq: DataFrame) -> DataFrame:
    """a, b, c -> right: the piece b, no word itself, rather joins c than a: bc is known, joins, and is commoner than ab."""
    counted = triples
    for name, x in (("n_b", F.col("b")), ("n_c", F.col("c")), ("n_ab", F.concat("a", "b")), ("n_bc", F.concat("b", "c"))):
        counted = counted.withColumn("word", x).join(freq.withColumnRenamed("n", name), "word", "left").drop("word")
    n = {k: F.coalesce(k, F.lit(0)) for k in ("n_b", "n_c", "n_ab", "n_bc")}
    right = (n["n_b"] == 0) & (n["n_bc"] > 0) & (n["n_bc"] >= F.least(n["n_b"], n["n_c"])) & (n["n_bc"] > n["n_ab"])
    return counted.select("a", "b", "c", right.alias("right"))


def pen_lifts(pairs: DataFrame, freq: DataFrame, gain: float = PEN_LIFT_GAIN, types: DataFrame | None = None) -> DataFrame:
    """a, b -> gain, lifted: a rare b (or a short unknown a), and the model of word types (of freq, unless given) finds ab likelier than a and b."""
    counted = pairs
    for name, x in (("n_a", F.col("a")), ("n_b", F.col("b"))):
        counted = counted.withColumn("word", x).join(freq.withColumnRenamed("n", name), "word", "left").drop("word")
    fragment = (F.coalesce("n_b", F.lit(0)) < RARE) | ((F.coalesce("n_a", F.lit(0)) == 0) & (F.length("a") <= 2))
    counted = counted.withColumn("fragment", fragment)
    texts = counted.where("fragment").select(F.explode(F.array("a", "b", F.concat("a", "b"))).alias("word")).distinct()
    logp = witten_bell(freq.select("word").distinct() if types is None else types, texts)
    for name, x in (("l_a", F.col("a")), ("l_b", F.col("b")), ("l_ab", F.concat("a", "b"))):
        counted = counted.withColumn("word", x).join(logp.withColumnRenamed("logp", name), "word", "left").drop("word")
    more = F.when(F.col("fragment"), F.col("l_ab") - F.col("l_a") - F.col("l_b"))
    return counted.select("a", "b", more.alias("gain"), F.coalesce(more > gain, F.lit(False)).alias("lifted"))


def _grams(types: DataFrame) -> DataFrame:
    """word, i, ch and ctx of each order k for word types padded with ^ and $."""
    padded = F.concat(F.lit("^" * (ORDER - 1)), F.col("word"), F.lit("$"))
    at = types.select("word", padded.alias("p"), F.explode(F.sequence(F.lit(ORDER), F.length(padded))).alias("i"))
    return at.select("word", "i", F.col("p").substr(F.col("i"), F.lit(1)).alias("ch"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDER - 1)), lambda k: F.struct(k.alias("k"), F.col("p").substr(F.col("i") - k, k).alias("ctx")))).alias("c")).select("word", "i", "ch", "c.k", "c.ctx")


def ngram_counts(types: DataFrame) -> DataFrame:
    return _grams(types).groupBy("k", "ctx", "ch").agg(F.count("*").alias("n"))


def witten_bell(train: DataFrame, words_: DataFrame) -> DataFrame:
    """word and logp under the model of train's word types: Witten-Bell from order 1 up, base 1 / (characters + 1)."""
    counts = ngram_counts(train)
    contexts = counts.groupBy("k", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    base = counts.where("k = 0").agg((1.0 / (F.count("*") + 1)).alias("base"))  # one row
    rows = _grams(words_).join(contexts, ["k", "ctx"], "left").join(counts, ["k", "ctx", "ch"], "left")
    levels = rows.groupBy("word", "i").agg(F.array_sort(F.collect_list(F.struct("k", "total", "types", F.coalesce("n", F.lit(0)).alias("n")))).alias("levels"))

    def step(p: Column, s: Column) -> Column:
        lam = s["total"] / (s["total"] + s["types"])
        return F.when(s["total"].isNull(), p).otherwise(lam * s["n"] / s["total"] + (1 - lam) * p)

    p = F.aggregate("levels", F.col("base"), step)
    return levels.withColumn("base", base.scalar()).groupBy("word").agg(F.sum(F.log(p)).alias("logp"))


def channel(right: str, written: str) -> tuple[float, tuple[tuple[str, str], ...]] | None:
    """The least cost at which ``right`` may have been written so, and the substitutions; none if it cannot."""
    reach: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for letter in right:
        after: dict[int, tuple[float, tuple]] = {}
        for at, (cost, subs) in reach.items():
            for form, price in ((letter, 0.0), *SUB_COST.get(letter, {}).items()):
                if written.startswith(form, at):
                    way = (cost + price, subs if form == letter else (*subs, (letter, form)))
                    to = at + len(form)
                    if to not in after or way[0] < after[to][0]:
                        after[to] = way
        reach = after
    return reach.get(len(written))


def channel_cost(right: str, written: str) -> float | None:
    found = channel(right, written)
    return None if found is None else found[0]


CHANNEL = "struct<cost:double,subs:array<struct<letter:string,form:string,price:double>>>"


def channel_rows(right: pd.Series, written: pd.Series) -> pd.DataFrame:
    rows = []
    for v, w in zip(right, written, strict=True):
        found = channel(v, w)
        rows.append((None, None) if found is None else (found[0], [{"letter": a, "form": b, "price": SUB_COST[a][b]} for a, b in found[1]]))
    return pd.DataFrame(rows, columns=["cost", "subs"])


def keyed_candidates(written: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, candidate, n, cost, subs: an equi-join on blocking keys, then the exact channel.

    A word that begins with й and а or у is also tried with я or ю there, at a small cost."""
    initial = F.when(F.col("word").rlike("^й[ау]"), F.concat(F.when(F.col("word").startswith("йа"), "я").otherwise("ю"), F.substring("word", 3, 1 << 30)))
    forms = F.filter(F.array(F.struct(F.col("word").alias("form"), F.lit(0.0).alias("extra")), F.struct(initial.alias("form"), F.lit(INITIAL_COST).alias("extra"))), lambda f: f["form"].isNotNull())
    tried = written.select("word", F.explode(forms).alias("f")).select("word", "f.form", "f.extra")
    keyed = tried.select("word", "form", "extra", F.explode(query_keys(F.col("form"))).alias("key"))
    lexicon = vocabulary.select(F.col("word").alias("candidate"), "n", skeleton(F.col("word")).alias("key"))
    pairs = keyed.join(lexicon, "key").select("word", "form", "extra", "candidate", "n").distinct()
    scored = pairs.withColumn("c", F.pandas_udf(channel_rows, CHANNEL)("candidate", "form")).where("c.cost IS NOT NULL")
    total = F.col("c.cost") + F.col("extra")
    best = scored.groupBy("word", "candidate").agg(F.max("n").alias("n"), F.min_by(F.struct(total.alias("cost"), F.col("c.subs").alias("subs")), F.struct(total, "extra")).alias("b"))
    return best.select("word", "candidate", "n", "b.cost", "b.subs")


def candidates(written: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, candidate, score, rank. Ties: freq, then word."""
    scored = keyed_candidates(written, vocabulary).withColumn("score", F.log(F.col("n") + 1) - COST_WEIGHT * F.col("cost"))
    w = Window.partitionBy("word").orderBy(F.desc("score"), F.desc("n"), "candidate")
    return scored.select("word", "candidate", "score", F.row_number().over(w).alias("rank"))
