"""Repair of texts typed without the special letters, as joins over distinct words.

Words that the vocabulary lacks are looked up once each, through blocking keys and the exact channel. A first pass
learns each author's substitutions from the words that leave no doubt; the second scores all candidates with those
at a discount. Words without a candidate are repaired part by part at hyphens, else as a known stem and a mined suffix.
Texts are expected in NFC. Null texts give null; a key names one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarnai.functions.text import CYRILLIC, LOOKALIKE_FROM, diff_words, is_russian, match_case, normalize_lookalikes, query_keys, skeleton, vowel_row
from sarnai.operators import lexicon
from sarnai.shared import materialize
from sarnai.ship import ship

# Letters, weights and thresholds.
SPECIAL, CONSONANTS = "әөүһҗң", "бвгджзйклмнпрстфхцчшщһҗң"
TWINS = "a-zA-Z" + LOOKALIKE_FROM
HARD = f"ё|яя|юю|^й[ау]|(?<=[^-э])э|[{CONSONANTS}][яю]"
HABIT_DISCOUNT, SURE_MARGIN, SPLIT_PENALTY, BEST_STEMS = 0.3, 2.0, 1.0, 3
STEM_MIN, SUFFIX_MAX = 3, 5
LONG_TEXT, SOME_WORDS, SOME_SHARE = 7, 2, 0.15
BEFORE_SENTENCE, SENTENCE_END = r"[ \t«\"'(—–-]+$", r"[.!?\n…]$"


@dataclass(frozen=True)
class Lexicon:
    vocabulary: DataFrame  # word, n
    protected: DataFrame  # word
    trusted: DataFrame  # word

    def suffixes(self) -> DataFrame:
        return lexicon.mine_suffixes(self.vocabulary, STEM_MIN, SUFFIX_MAX, trusted=self.trusted)


def score(n: Column, cost: Column) -> Column:
    return F.log(n + 1) - lexicon.COST_WEIGHT * cost


def _tokens(texts: DataFrame, key: str) -> DataFrame:
    """key, pos, part, word (null between words) and whether a sentence begins there."""
    runs = F.regexp_extract_all("norm", F.lit(f"([{CYRILLIC}]+(?:-[{CYRILLIC}]+)*|[^{CYRILLIC}]+)"), F.lit(1))
    rows = texts.select(key, F.posexplode(runs).alias("pos", "part"))
    before = F.lag("part").over(Window.partitionBy(key).orderBy("pos"))
    bare = F.regexp_replace(before, BEFORE_SENTENCE, "")
    starts = before.isNull() | bare.rlike(SENTENCE_END) | ((bare == "") & (F.col("pos") == 1))
    return rows.select(key, "pos", "part", F.when(F.col("part").rlike(f"^[{CYRILLIC}]"), F.lower("part")).alias("word"), starts.alias("starts"))


def _unknown(types: DataFrame, known: Lexicon) -> DataFrame:
    rest = types.join(known.vocabulary.select("word").distinct(), "word", "left_anti")
    return rest.join(lexicon.protected_prefix(rest, known.protected), "word", "left_anti")


def _cuts(word: Column) -> Column:
    n = F.length(word)
    low = F.greatest(F.lit(STEM_MIN), n - SUFFIX_MAX)
    cut = lambda k: F.struct(F.substring(word, F.lit(1), k).alias("stem"), F.substring(word, k + 1, n).alias("tail"))
    return F.when(low < n, F.transform(F.sequence(low, n - 1), cut))


def detect(texts: DataFrame, key: str, tokens: DataFrame, unknown: DataFrame, ranked: DataFrame) -> DataFrame:
    """key, russian and flag: hard, vocab, length, partial or empty."""
    best = ranked.where("rank = 1").select("word", ((F.col("candidate") != F.col("word")) & F.col("candidate").rlike(f"[{SPECIAL}]")).alias("hit"))
    marked = unknown.withColumns({"unknown": F.lit(True), "hard": F.col("word").rlike(HARD)}).join(best, "word", "left")
    words = tokens.where("word IS NOT NULL").join(marked, "word", "left")
    sums = words.groupBy(key).agg(F.count("*").alias("n"), F.count_if("hard").alias("n_hard"), F.count_if("hit").alias("n_hit"))
    foreign = F.filter(F.regexp_extract_all("text", F.lit(r"(?U)([\w'-]+)"), F.lit(1)), lambda t: t.rlike(f"[{CYRILLIC}]") & t.rlike(f"[{TWINS}]"))
    facts = texts.select(key, "russian", "_force", F.size(foreign).alias("n_twins"), F.regexp_count(F.lower("norm"), F.lit(f"[{SPECIAL}]")).alias("n_special")).join(sums, key, "left")
    n, hit, none = F.coalesce("n", F.lit(0)), F.coalesce("n_hit", F.lit(0)), F.col("n_special") == 0
    flag = (
        F.when(F.col("russian"), "").when((F.col("n_twins") > 0) | (F.coalesce("n_hard", F.lit(0)) > 0), "hard").when(none & (hit > 0), "vocab")
        .when(none & (n >= LONG_TEXT), "length").when((hit >= SOME_WORDS) & (hit >= SOME_SHARE * n), "partial").otherwise("")
    )
    return facts.select(key, "russian", flag.alias("flag"), "_force")


def repair(documents: DataFrame, key: str, text: str, known: Lexicon, force: Column | bool = False) -> DataFrame:
    """key, flag, russian, fixed and fixes (pairs of words before and after) of every row.

    force: of a row, its author asked for it, so it is repaired without a flag too, but for its capitalised names."""
    ship(documents.sparkSession)
    force = F.lit(force) if isinstance(force, bool) else force
    texts = documents.select(key, F.col(text).alias("text"), force.alias("_force")).withColumn("norm", normalize_lookalikes(F.col("text")))
    texts = texts.withColumn("russian", is_russian(F.col("text")))
    tokens = materialize(_tokens(texts, key), "letters-tokens")
    unknown = materialize(_unknown(tokens.where("word IS NOT NULL").select("word").distinct(), known), "letters-unknown")

    # what may have been meant by each word, hyphenated part and stem
    parts = unknown.where(F.col("word").contains("-")).select(F.explode(F.split("word", "-")).alias("word")).distinct()
    parts = parts.join(known.vocabulary.select("word").distinct(), "word", "left_anti")
    bases = unknown.where(~F.col("word").contains("-")).union(parts).distinct()
    cuts = bases.select("word", F.explode(_cuts(F.col("word"))).alias("c")).select("word", "c.stem", "c.tail")
    units = unknown.union(parts).union(cuts.select("stem")).distinct()
    pairs = materialize(lexicon.keyed_candidates(units, known.vocabulary), "letters-pairs")

    plain = pairs.join(unknown, "word", "left_semi").withColumn("score", score(F.col("n"), F.col("cost")))
    w = Window.partitionBy("word").orderBy(F.desc("score"), F.desc("n"), "candidate")
    ranked = plain.withColumns({"rank": F.row_number().over(w), "margin": F.col("score") - F.lead("score").over(w)})
    flags = materialize(detect(texts, key, tokens, unknown, ranked), "letters-flags")

    # first pass: an author's substitutions, a small set for each text
    sure = ranked.where((F.col("rank") == 1) & (F.col("margin").isNull() | (F.col("margin") > SURE_MARGIN))).select("word", "subs")
    seen = tokens.join(sure, "word").select(key, F.explode("subs").alias("s")).select(key, F.concat_ws(">", "s.letter", "s.form").alias("habit"))
    habits = seen.groupBy(key).agg(F.collect_set("habit").alias("habits"))

    # second pass: each word of a text once
    wanted = flags.where(~F.col("russian") & (F.col("_force") | (F.col("flag") != ""))).select(key)
    mine = tokens.join(unknown, "word", "left_semi").select(key, "word").distinct().join(wanted, key, "left_semi")
    my_parts = mine.where(F.col("word").contains("-")).select(key, F.explode(F.split("word", "-")).alias("word")).join(parts, "word", "left_semi").select(key, "word")
    my_bases = mine.where(~F.col("word").contains("-")).union(my_parts).distinct()
    my_cuts = my_bases.join(cuts, "word")
    asked = mine.union(my_parts).union(my_cuts.select(key, "stem")).distinct().join(habits, key, "left")
    used = F.filter("subs", lambda s: F.array_contains(F.coalesce("habits", F.array().cast("array<string>")), F.concat_ws(">", s["letter"], s["form"])))
    cheaper = F.aggregate(used, F.lit(0.0), lambda a, s: a + s["price"] * (1 - HABIT_DISCOUNT))
    scored = asked.join(pairs, "word").select(key, "word", "candidate", "n", score(F.col("n"), F.col("cost") - cheaper).alias("score"))
    scored = materialize(scored, "letters-scored")
    best = scored.groupBy(key, "word").agg(F.min_by("candidate", F.struct(-F.col("score"), -F.col("n"), "candidate")).alias("best"))
    split = _stem_and_suffix(scored, my_cuts, known, key)
    single = my_bases.join(best, [key, "word"], "left").join(split, [key, "word"], "left").select(key, "word", F.coalesce("best", "split", "word").alias("new"))
    single = materialize(single, "letters-single")

    pieces = mine.where(F.col("word").contains("-")).select(key, "word", F.posexplode(F.split("word", "-")).alias("at", "piece"))
    fixed = pieces.join(single.select(key, F.col("word").alias("piece"), "new"), [key, "piece"], "left")
    joined = fixed.groupBy(key, "word").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("new", "piece").alias("new")))).alias("ps"))
    compound = joined.select(key, "word", F.array_join(F.transform("ps", lambda p: p["new"]), "-").alias("made"))
    compound = compound.join(best, [key, "word"], "left").select(key, "word", F.coalesce("best", "made").alias("new"))
    new = materialize(single.join(mine, [key, "word"], "left_semi").union(compound), "letters-new")

    placed = tokens.join(new, [key, "word"], "left").join(flags, key)
    first = F.substring("part", 1, 1)
    named = (F.col("flag") == "") & (F.upper(first) == first) & (F.lower(first) != first) & ~F.col("starts")
    out = F.when(F.col("new").isNotNull() & (F.col("new") != F.col("word")) & ~named, match_case(F.col("part"), F.col("new"))).otherwise(F.col("part"))
    made = placed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", out.alias("out")))), lambda s: s["out"]), "").alias("_fixed"))
    whole = texts.drop("russian", "_force").join(flags, key, "left").join(made, key, "left").withColumn("fixed", F.when(F.col("text").isNotNull(), F.coalesce("_fixed", "norm")))
    return whole.select(key, "flag", "russian", "fixed", F.when(F.col("text").isNotNull(), diff_words(F.col("text"), F.col("fixed"))).alias("fixes"))


def _stem_and_suffix(scored: DataFrame, cuts: DataFrame, known: Lexicon, key: str) -> DataFrame:
    """key, word, split: the best of a good stem and a suffix that its vowels allow."""
    good = lexicon.good_stems(known.vocabulary, known.trusted).withColumnRenamed("word", "candidate")
    w = Window.partitionBy(key, "stem").orderBy(F.desc("score"), F.desc("n"), "candidate")
    stems = scored.withColumnRenamed("word", "stem").join(good, "candidate", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= BEST_STEMS)
    suffixes = known.suffixes().select("vowels", "suffix", "freq", skeleton(F.col("suffix")).alias("k"))
    tails = cuts.select("tail").distinct().select("tail", F.explode(query_keys(F.col("tail"))).alias("k")).join(suffixes, "k").select("tail", "vowels", "suffix", "freq").distinct()
    tails = tails.withColumn("c", F.pandas_udf(lexicon.channel_rows, lexicon.CHANNEL)("suffix", "tail")).where("c.cost IS NOT NULL")
    ways = cuts.join(stems, [key, "stem"]).withColumn("vowels", vowel_row(F.col("candidate"))).join(tails, ["tail", "vowels"])
    total = F.col("score") + F.log("freq") - lexicon.COST_WEIGHT * F.col("c.cost") - SPLIT_PENALTY
    made = F.concat("candidate", "suffix")
    return ways.groupBy(key, "word").agg(F.min_by(made, F.struct(-total, made)).alias("split"))
