"""The flagship conversion: a request's text into its target's script, as one plan over all requests.

Words of Cyrillic texts are looked up once each: in the dictionary, else part by part at hyphens, else by the model.
Without a model such words stay as written. Which branch a request takes is a column, so nothing is run per request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarnai.functions import recurrent
from sarnai.functions import text as T
from sarnai.functions.messages import MODES, capitalize_sentences
from sarnai.operators import letters
from sarnai.operators.lexicon import SUFFIX_PART
from sarnai.shared import materialize

# Letters of words of mixed script.
WORD = "а-яёәөүһҗңa-z"


@dataclass(frozen=True)
class Models:
    word: str | None = None  # file of the model from Cyrillic
    line: str | None = None  # file of the segmenter of transliterated lines
    back: str | None = None  # file of the model to Cyrillic
    threshold: float = 0.5


def error_of(text: Column, target: Column, script: Column) -> Column:
    guard = T.input_guard(text)
    return (
        F.when(guard != "ok", guard).when(script == "unknown", "unknown_script").when((target == "fix") & (script != "cyrillic"), "not_cyrillic")
        .when((target == "todo") & (script == "todo"), "already_todo").when(~F.coalesce(target, F.lit("")).isin(*MODES), "unknown_target")
    )


def transliterate(texts: DataFrame, key: str, text: str, dictionary: DataFrame, model: str | None = None) -> DataFrame:
    """key, translit, n_dict, n_split, n_model. dictionary: word, translit (one row a word)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]+(?:-[{WORD}]+)*|[^{WORD}]+)"), F.lit(1))
    tokens = texts.select(key, F.posexplode_outer(runs).alias("pos", "part"))
    words = tokens.where(F.col("part").rlike(f"^[{WORD}]")).select(F.col("part").alias("word")).distinct()
    known = dictionary.select("word", F.col("translit").alias("entry"))
    looked = words.join(known, "word", "left")
    pieces = looked.where(F.col("entry").isNull() & F.col("word").contains("-")).select("word", F.posexplode(F.split("word", "-")).alias("at", "piece"))
    found = pieces.join(known.withColumnRenamed("word", "piece"), "piece", "left")
    alone = F.col("entry").isNotNull() | (F.length("piece") > SUFFIX_PART)
    able = found.groupBy("word").agg(F.bool_and(alone).alias("able")).where("able").select("word")
    parts = found.join(able, "word", "left_semi").select("word", "at", "piece", F.nullif("entry", F.lit("")).alias("entry"))
    whole = looked.where(F.col("entry").isNull()).join(able, "word", "left_anti").select("word")
    asked = whole.union(parts.where("entry IS NULL").select("piece")).distinct()
    guess = recurrent.translate_word(texts.sparkSession, model)("word") if model else F.col("word")
    guessed = asked.select("word", guess.alias("guess"))
    split = parts.join(guessed.withColumnRenamed("word", "piece"), "piece", "left").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("entry", "guess").alias("made")))).alias("ps"))
    split = split.select("word", F.array_join(F.transform("ps", lambda p: p["made"]), " ").alias("joined"))
    made = looked.join(split, "word", "left").join(guessed, "word", "left")
    source = F.when(F.col("entry").isNotNull(), "dict").when(F.col("joined").isNotNull(), "split").otherwise("model")
    made = made.select(F.col("word").alias("part"), F.coalesce("entry", "joined", "guess").alias("made"), source.alias("source"))
    out = tokens.join(made, "part", "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("made", "part").alias("out")))).alias("os"), *(F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("dict", "split", "model"))
    )
    return out.select(key, F.array_join(F.transform("os", lambda o: o["out"]), "").alias("translit"), "n_dict", "n_split", "n_model")


def convert(
    requests: DataFrame, key: str, dictionary: DataFrame, known: letters.Lexicon | None = None, models: Models | None = None,
    fix_letters: bool = False, punctuation: str = "off",
) -> DataFrame:
    """From key, text, target: key, target, script, error, translit, todo, cyrillic, fixed, flag, fixes.

    A request that cannot be served has an error and no results; null and empty texts are such. Without ``known``
    no letters are checked, without ``models.line`` and ``models.back`` there is no way back to Cyrillic."""
    models = models or Models()
    fixes = "array<struct<before:string,after:string>>"
    classified = requests.select(key, "target", T.strip(F.col("text")).alias("text")).withColumn("script", T.detect_script(F.coalesce("text", F.lit(""))))
    rows = materialize(classified.withColumn("error", error_of(F.col("text"), F.col("target"), F.col("script"))), "convert-rows")
    good, script, target, text = rows.where("error IS NULL"), F.col("script"), F.col("target"), F.col("text")
    nothing = F.lit(None).cast("string")

    # each script is a branch over the classified rows; only Cyrillic texts, looked up word by word, come back by their key
    cyrillic = good.where("script = 'cyrillic'")
    if known is None:
        checked = cyrillic.select(key, "target", "text", "script", nothing.alias("fixed"), nothing.alias("flag"), F.lit(None).cast(fixes).alias("fixes"))
    else:
        checked = cyrillic.join(letters.repair(cyrillic, key, "text", known, force=target == "fix").drop("russian"), key)
    use = (target == "fix") | F.lit(fix_letters)
    checked = checked.select(key, "target", "text", "script", F.when(use, F.coalesce("fixed", "text")).otherwise(text).alias("fixed"), "flag", F.when(use, F.col("fixes")).alias("fixes"))
    latin = transliterate(checked.where("target <> 'fix'"), key, "fixed", dictionary, models.word)
    looked = checked.join(latin.select(key, "translit"), key, "left")
    direct = F.when(target == "fix", nothing).when(script == "translit", text).when(target != "image", T.todo_to_translit(text))
    other = good.where("script <> 'cyrillic'").select(
        key, "target", "text", "script", nothing.alias("fixed"), nothing.alias("flag"), F.lit(None).cast(fixes).alias("fixes"), direct.alias("translit")
    )
    whole = looked.unionByName(other)
    drawn = target.isin("todo", "image")
    whole = whole.withColumn("_todo", F.when(drawn & (script == "todo"), text).when(drawn, T.translit_to_todo(F.col("translit"))))
    whole = whole.withColumn("todo", T.apply_punctuation(F.col("_todo"), punctuation))
    if models.line and models.back:
        lines = whole.where((target == "translit") & script.isin("todo", "translit")).select(key, F.posexplode(F.split("translit", "\n")).alias("_at", "_text"))
        lines = lines.select(F.struct(key, "_at").alias("_line"), "_text")
        back = recurrent.lines_to_cyrillic(lines, "_line", "_text", models.line, models.back, models.threshold)
        back = back.groupBy(F.col(f"_line.{key}").alias(key)).agg(F.array_sort(F.collect_list(F.struct("_line._at", "cyrillic"))).alias("_ls"))
        whole = whole.join(back.select(key, capitalize_sentences(F.array_join(F.transform("_ls", lambda x: x["cyrillic"]), "\n")).alias("cyrillic")), key, "left")
    else:
        whole = whole.withColumn("cyrillic", nothing)
    results = whole.select(key, "target", "script", nothing.alias("error"), "translit", "todo", "cyrillic", F.when(target == "fix", F.col("fixed")).alias("fixed"), "flag", "fixes")
    failed = rows.where("error IS NOT NULL").select(key, "target", "script", "error", *(nothing.alias(c) for c in ("translit", "todo", "cyrillic", "fixed", "flag")), F.lit(None).cast(fixes).alias("fixes"))
    return results.unionByName(failed)
