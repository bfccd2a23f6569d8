"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sarnai.functions import text as T
from sarnai.operators import lexicon, ordered, store
from sarnai.plans import rules_sql as S
from sarnai.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name; sql: its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """SELECT count(*) AS n_requests, count(DISTINCT user_id) AS n_users, count_if(event_type = 'error') AS n_errors,
    count_if(event_type <> 'error') AS n_ok, round(sum(CASE WHEN event_type <> 'error' THEN value END), 2) AS ok_ms,
    coalesce(round(avg(CASE WHEN event_type <> 'error' THEN value END), 4), 0.0) AS avg_ms,
    count_if(event_type IN ('click', 'purchase')) AS n_up, count_if(event_type = 'error') AS n_down FROM events"""
)
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return load(spark, sf_dir, "events").agg(
        F.count("*").alias("n_requests"), F.countDistinct("user_id").alias("n_users"), F.count_if(~ok).alias("n_errors"),
        F.count_if(ok).alias("n_ok"), F.round(F.sum(F.when(ok, F.col("value"))), 2).alias("ok_ms"),
        F.coalesce(F.round(F.avg(F.when(ok, F.col("value"))), 4), F.lit(0.0)).alias("avg_ms"),
        F.count_if(F.col("event_type").isin("click", "purchase")).alias("n_up"), F.count_if(~ok).alias("n_down"),
    )


TOKENS = "SELECT {key} AS k, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda w: w <> '')) AS word FROM {table}"


def _tokens(name: str, key: str = "1") -> str:
    return TOKENS.format(table=name, key=key)


@query("SELECT event_type AS target, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM events GROUP BY event_type")
def stats_by_target(spark, sf_dir):
    n = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("target")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # one row per target


def _feedback(spark, sf_dir):
    requests = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "lang", "source", F.length("text").alias("n_chars"))
    rating = F.when(F.col("quality") == 1, "up").otherwise("down")
    feedback = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("feedback_id"), F.col("doc_id").alias("request_id"), rating.alias("rating"), "toxic")
    return feedback, requests


EXPORT = """SELECT l.doc_id AS request_id, l.doc_id AS feedback_id, CASE WHEN quality = 1 THEN 'up' ELSE 'down' END AS rating,
  CASE WHEN toxic = 1 THEN 'fix' END AS correction, lang, source, length(text)::INT AS n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


@query(EXPORT)
def feedback_export(spark, sf_dir):
    feedback, requests = _feedback(spark, sf_dir)
    return store.export(feedback.select("request_id", "feedback_id", "rating", F.when(F.col("toxic") == 1, "fix").alias("correction")), requests)


@query(f"SELECT * FROM ({EXPORT}) WHERE correction <> ''")
def feedback_export_corrections(spark, sf_dir):
    feedback, requests = _feedback(spark, sf_dir)
    return store.export(feedback.select("request_id", "feedback_id", "rating", F.when(F.col("toxic") == 1, "fix").alias("correction")), requests, True)


def _log(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 40).alias("request_id"), F.when(F.col("user_id") % 7 != 0, F.col("event_type")).alias("who"), F.col("event_id").alias("seq"),
        F.when(F.col("value") > 50, "up").otherwise("down").alias("rating"), F.when(F.col("value") > 90, F.col("props")).alias("correction"),
    )


LOG = """SELECT user_id % 40 AS request_id, CASE WHEN user_id % 7 <> 0 THEN event_type END AS who, event_id AS seq,
  CASE WHEN value > 50 THEN 'up' ELSE 'down' END AS rating, CASE WHEN value > 90 THEN props END AS correction FROM events"""


@query(
    f"""WITH log AS ({LOG}) SELECT request_id, who, min(seq) AS first_seq, arg_max(rating, seq) AS rating,
    arg_max(correction, seq) FILTER (correction IS NOT NULL) AS correction FROM log WHERE who IS NOT NULL GROUP BY ALL
    UNION ALL SELECT request_id, who, seq, rating, correction FROM log WHERE who IS NULL"""
)
def feedback_upsert_fold(spark, sf_dir):
    return store.fold_live(_log(spark, sf_dir), ["request_id", "who"], "seq", "rating", "correction")


@query(
    f"""WITH log AS ({LOG}) SELECT * FROM log WHERE who IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id, who ORDER BY seq) = 1
    UNION ALL SELECT * FROM log WHERE who IS NULL"""
)
def feedback_restore_first(spark, sf_dir):
    return store.restore_first_wins(_log(spark, sf_dir), ["request_id", "who"], "seq")


def _settings_log(spark, sf_dir):
    field = F.when(F.col("event_type") == "click", "fg").when(F.col("event_type") == "view", "bg").when(F.col("event_type") == "purchase", "mode").when(F.col("event_id") % 97 == 0, "reset").otherwise("size")
    value = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    return load(spark, sf_dir, "events").select("user_id", field.alias("field"), value.alias("value"), F.col("event_id").alias("seq"))


_SETTING = lambda f, live: f"arg_max(value, seq) FILTER (field = '{f}'{live}) AS {f}"
SETTINGS_SQL = f"""WITH log AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'fg' WHEN event_type = 'view' THEN 'bg' WHEN event_type = 'purchase' THEN 'mode'
  WHEN event_id % 97 = 0 THEN 'reset' ELSE 'size' END AS field, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'v' || event_id END AS value, event_id AS seq FROM events),
 late AS (SELECT *, max(CASE WHEN field = 'reset' THEN seq END) OVER (PARTITION BY user_id) AS r FROM log)
 SELECT user_id, {", ".join(_SETTING(f, "" if f == "mode" else " AND (r IS NULL OR seq > r)") for f in store.SETTINGS)} FROM late GROUP BY user_id"""


@query(SETTINGS_SQL)
def settings_fold(spark, sf_dir):
    return store.fold_settings(_settings_log(spark, sf_dir))


@query(f"""SELECT user_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {f} <> '' THEN '{f}=' || {f} END" for f in store.SETTINGS)}], lambda x: x IS NOT NULL), ',') AS settings FROM ({SETTINGS_SQL})""")
def settings_nonempty(spark, sf_dir):
    found = store.nonempty_settings(store.fold_settings(_settings_log(spark, sf_dir)))
    items = F.transform(F.filter(F.array(*map(F.lit, store.SETTINGS)), lambda f: F.map_contains_key("settings", f)), lambda f: F.concat(f, F.lit("="), F.element_at("settings", f)))
    return found.select("user_id", F.array_join(items, ",").alias("settings"))


@query("SELECT CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 10000 THEN 'too_long' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents) GROUP BY 1")
def input_guard(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(T.input_guard(F.col("text")).alias("status")).agg(F.count("*").alias("n"))


def mixed_scripts(spark, sf_dir) -> DataFrame:
    """doc_id and the text of documents put, by its id, into Cyrillic letters, into Todo letters, into both, into digits and marks, or left."""
    d, at = load(spark, sf_dir, "documents"), F.col("doc_id") % 5
    cyrillic, todo = F.translate("text", *MIXED_CYRILLIC), F.translate("text", *MIXED_TODO)
    marks = F.regexp_replace("text", "[^ \\n.,!?]", "7")
    text = F.when(at == 1, cyrillic).when(at == 2, todo).when(at == 3, F.concat(F.substring(todo, 1, 40), F.substring(cyrillic, 41, 1 << 20))).when(at == 4, marks).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"))


# Letter for letter, so that a text keeps its length.
MIXED_CYRILLIC = ("abvgdeziklmnoprstufhABVGDEZIKLMNOPRSTUFH", "абвгдезиклмнопрстуфхАБВГДЕЗИКЛМНОПРСТУФХ")
MIXED_TODO = ("aeioubgdlmnrstABDGEIOU", "ᠠᡄᡅᡆᡇᡋᡎᡑᠯᡏᠨᠷᠰᡐᠠᡋᡑᡎᡄᡅᡆᡇ")
MIXED = f"""SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN c WHEN 2 THEN d WHEN 3 THEN substr(d, 1, 40) || substr(c, 41) WHEN 4 THEN regexp_replace(text, '[^ \\n.,!?]', '7', 'g') ELSE text END AS text
  FROM (SELECT doc_id, text, translate(text, '{MIXED_CYRILLIC[0]}', '{MIXED_CYRILLIC[1]}') AS c, translate(text, '{MIXED_TODO[0]}', '{MIXED_TODO[1]}') AS d FROM documents)"""
SCRIPT = "CASE WHEN regexp_matches(text, '[\\x{1800}-\\x{18AF}]') THEN 'todo' WHEN regexp_matches(text, '[а-яёА-ЯЁәөүһҗңӘӨҮҺҖҢ]') THEN 'cyrillic' WHEN regexp_matches(text, '[a-zA-ZāēīōūȫǖöüγčšǰĀĒĪŌŪȪǕÖÜΓČŠ]') THEN 'translit' ELSE 'unknown' END"


@query(f"SELECT doc_id, {SCRIPT} AS script FROM ({MIXED})")
def script_detect(spark, sf_dir):
    return mixed_scripts(spark, sf_dir).select("doc_id", T.detect_script(F.col("text")).alias("script"))


STRIPPED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[;()\\[\\]«»“”„…]+', ' ', 'g'), ' {2,}', ' ', 'g'), ' ')), chr(10))"


@query(f"SELECT doc_id, md5({STRIPPED}) AS digest FROM documents")
def strip_marks(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_marks(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({S.to_todo('text')}) AS digest FROM documents")
def translit_to_todo(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.translit_to_todo(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(todo) AS todo, md5({S.todo_to_translit('todo')}) AS translit FROM (SELECT doc_id, {S.normalize_ocr(S.to_todo('text'))} AS todo FROM documents)")
def todo_round_trip(spark, sf_dir):
    made = load(spark, sf_dir, "documents").select("doc_id", T.normalize_ocr(T.translit_to_todo(F.col("text"))).alias("todo"))
    digest = lambda c: F.md5(c.cast("binary"))
    return made.select("doc_id", digest(F.col("todo")).alias("todo"), digest(T.todo_to_translit(F.col("todo"))).alias("translit"))


@query(S.punctuation(f"SELECT item_id, {S.to_todo('text')} AS todo FROM benchmark", "item_id", "todo"))
def punctuation_modes(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").select("item_id", T.translit_to_todo(F.col("text")).alias("todo"))
    return b.select("item_id", *(T.apply_punctuation(F.col("todo"), F.lit(m)).alias(m) for m in ("off", "frame", "all")))


@query(f"WITH t AS (SELECT DISTINCT translate(word, 'aeouhkn', 'аеоугхң') AS word FROM ({_tokens('benchmark')})) SELECT translate(word, 'җңәяаэеөёоүюуһгх', 'жнaaaaaaaauuuggg') AS skeleton, count(*) AS n FROM t GROUP BY 1")
def skeleton_blocks(spark, sf_dir):
    words = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").select(F.translate("word", "aeouhkn", "аеоугхң").alias("word")).distinct()
    return words.groupBy(T.skeleton(F.col("word")).alias("skeleton")).agg(F.count("*").alias("n"))


@query(
    f"""WITH t AS (SELECT translate(word, 'aeoui', 'аеоуи') AS w FROM ({_tokens('conversations')})) SELECT CASE WHEN regexp_matches(w, '[аоуы]') AND regexp_matches(w, '[әөүеэ]') THEN 'm'
    WHEN regexp_matches(w, '[аоуы]') THEN 'b' WHEN regexp_matches(w, '[әөүеэ]') THEN 'f' ELSE 'n' END AS vowels, count(*) AS n FROM t GROUP BY 1"""
)
def vowel_rows(spark, sf_dir):
    words = lexicon.words(load(spark, sf_dir, "conversations"), "conv_id", "text")
    return words.groupBy(T.vowel_row(F.translate("word", "aeoui", "аеоуи")).alias("vowels")).agg(F.count("*").alias("n"))


@query(
    f"""WITH t AS ({_tokens('documents', 'doc_id')}), d AS (SELECT DISTINCT word FROM ({_tokens('benchmark')})), y AS (SELECT DISTINCT word FROM t),
    s AS (SELECT word, CASE WHEN word IN (FROM d) THEN 'dict' WHEN (SELECT count(*) > 1 AND bool_and(p IN (FROM d) OR length(p) > 2) FROM unnest(string_split(word, '-')) u(p) WHERE p <> '') THEN 'split' ELSE 'model' END AS s FROM y)
    SELECT k AS doc_id, count_if(s = 'dict') AS n_dict, count_if(s = 'split') AS n_split, count_if(s = 'model') AS n_model FROM t JOIN s USING (word) GROUP BY k"""
)
def lexicon_provenance(spark, sf_dir):
    dictionary = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text")
    return lexicon.provenance(lexicon.words(load(spark, sf_dir, "documents"), "doc_id", "text"), dictionary, "doc_id")


@query(
    f"""WITH c AS (SELECT word, count(*) AS n FROM ({_tokens('documents')}) GROUP BY word), x AS (SELECT word, n, unnest(range(greatest(length(word) - 5, 3), length(word))) AS k FROM c WHERE NOT contains(word, '-')),
    p AS (SELECT n, word[1:k] AS stem, word[k + 1:] AS suffix FROM x) SELECT CASE WHEN regexp_matches(translate(stem, 'яюё', 'ауо'), '[аоуы]') THEN 'b' ELSE 'n' END AS vowels, suffix, sum(n)::BIGINT AS freq
    FROM p WHERE stem IN (SELECT word FROM c WHERE n >= 3) GROUP BY ALL HAVING sum(n) >= 30"""
)
def suffix_mine(spark, sf_dir):
    counts = lexicon.words(load(spark, sf_dir, "documents"), "doc_id", "text").groupBy("word").agg(F.count("*").alias("n"))
    return lexicon.mine_suffixes(counts)


@query(
    f"""WITH d AS (SELECT DISTINCT word FROM ({_tokens('benchmark')})), y AS (SELECT DISTINCT word FROM ({_tokens('conversations')}))
    SELECT word FROM y WHERE word IN (FROM d) OR EXISTS (SELECT 1 FROM unnest(range(greatest(4, length(y.word) - 4), length(y.word))) u(k) WHERE y.word[1:k] IN (FROM d))"""
)
def prefix_protect(spark, sf_dir):
    types = lexicon.words(load(spark, sf_dir, "conversations"), "conv_id", "text").select("word").distinct()
    return lexicon.protected_prefix(types, lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text"))


COUNTS = f"""f AS MATERIALIZED (SELECT word, count(*) AS n FROM ({_tokens('documents')}) GROUP BY word),
  t AS MATERIALIZED (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\n]+'), lambda w: w <> '') AS ws FROM benchmark)"""


def _counted(sql: str, parts: str) -> str:
    """SQL over p (pairs or triples) and f (counts) with a column n_<name> for each name=expression."""
    found = [x.split("=") for x in parts.split(", ")]
    wanted = " UNION ".join(f"SELECT {e} AS word FROM p" for _, e in found)
    few = f"few AS MATERIALIZED (SELECT word, n FROM f WHERE word IN ({wanted}))"
    joins = " ".join(f"LEFT JOIN few AS f_{name} ON f_{name}.word = {e}" for name, e in found)
    counts = ", ".join(f"coalesce(f_{name}.n, 0) AS n_{name}" for name, _ in found)
    return f"{few}, counted AS (SELECT p.*, {counts} FROM p {joins}) {sql}"


PAIRS = "p AS MATERIALIZED (SELECT DISTINCT ws[i] AS a, ws[i + 1] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM t))"


@query(f"WITH {COUNTS}, {PAIRS}, " + _counted("SELECT a, b, n_ab > 0 AND n_ab >= least(n_a, n_b) AS joined FROM counted", "a=a, b=b, ab=a || b"))
def join_decisions(spark, sf_dir):
    freq = lexicon.words(load(spark, sf_dir, "documents"), "doc_id", "text").groupBy("word").agg(F.count("*").alias("n"))
    t = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text")
    pairs = t.withColumn("b", F.lead("word").over(Window.partitionBy("item_id").orderBy("pos"))).where("b IS NOT NULL").select(F.col("word").alias("a"), "b").distinct()
    return lexicon.should_join(pairs, freq)


NGRAMS = f"""WITH y AS (SELECT DISTINCT word FROM ({_tokens('benchmark')})), p AS (SELECT word, '^^^^' || word || '$' AS p FROM y), i AS (SELECT word, p, unnest(range(5, length(p) + 1)) AS i FROM p),
  g AS (SELECT word, i, p[i] AS ch, k::INT AS k, CASE WHEN k = 0 THEN '' ELSE p[i - k : i - 1] END AS ctx FROM i, range(0, 5) r(k))"""


@query(f"{NGRAMS} SELECT k, ctx, ch, count(*) AS n FROM g GROUP BY ALL")
def ngram_counts(spark, sf_dir):
    types = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").select("word").distinct()
    return lexicon.ngram_counts(types)


@query(
    f"""{NGRAMS}, c AS (SELECT k, ctx, ch, count(*) AS n FROM g GROUP BY ALL), x AS (SELECT k, ctx, sum(n) AS total, count(*) AS types FROM c GROUP BY ALL),
    b AS (SELECT 1.0::DOUBLE / (count(*) + 1) AS base FROM c WHERE k = 0), s AS (SELECT g.word, g.i, g.k, c.n / total::DOUBLE AS r, total / (total + types)::DOUBLE AS lam FROM g JOIN c USING (k, ctx, ch) JOIN x USING (k, ctx)),
    l AS (SELECT word, i, list(struct_pack(r := r, lam := lam) ORDER BY k) AS v FROM s GROUP BY ALL)
    SELECT word, round(sum(ln(v[5].lam * v[5].r + (1 - v[5].lam) * (v[4].lam * v[4].r + (1 - v[4].lam) * (v[3].lam * v[3].r + (1 - v[3].lam) * (v[2].lam * v[2].r + (1 - v[2].lam) * (v[1].lam * v[1].r + (1 - v[1].lam) * base)))))), 5) AS logp FROM l, b GROUP BY word"""
)
def witten_bell(spark, sf_dir):
    types = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").select("word").distinct()
    return lexicon.witten_bell(types, types).select("word", F.round("logp", 5).alias("logp"))


CYRILLIC_LETTERS = ("abvgdeziklmnoprstufxyhjcwq", "абвгдезиклмнопрстуфхыһйцүә")
_SUBS = ", ".join(f"('{letter}', '{form}', {price}::DOUBLE)" for letter, forms in lexicon.SUB_COST.items() for form, price in forms.items())
_SKELETON = lambda e: f"translate({e}, 'җңәяаэеөёоүюуһгх', 'жнaaaaaaaauuuggg')"
_KEYS = "list_distinct([" + ", ".join(_SKELETON(e) for e in ("form", "replace(form, 'дж', 'ж')", "replace(form, 'нг', 'н')", "replace(replace(form, 'дж', 'ж'), 'нг', 'н')")) + "])"
CANDIDATES = f"""WITH RECURSIVE voc AS MATERIALIZED (SELECT w AS candidate, {_SKELETON('w')} AS k, count(*) AS n FROM (SELECT translate(lower(word), '{CYRILLIC_LETTERS[0]}', '{CYRILLIC_LETTERS[1]}') AS w FROM ({_tokens('benchmark')}))
    WHERE regexp_full_match(w, '[а-яһүә]+') GROUP BY 1, 2),
  typed AS (SELECT DISTINCT unnest(regexp_extract_all(translate(translate(lower(text), '{CYRILLIC_LETTERS[0]}', '{CYRILLIC_LETTERS[1]}'), 'һүә', 'гуа'), '[а-я]+')) AS word FROM conversations),
  forms AS (SELECT word, word AS form, 0.0::DOUBLE AS extra FROM typed UNION ALL SELECT word, CASE WHEN word[2] = 'а' THEN 'я' ELSE 'ю' END || word[3:], 0.5 FROM typed WHERE regexp_matches(word, '^й[ау]')),
  pairs AS MATERIALIZED (SELECT DISTINCT form, candidate FROM (SELECT form, unnest({_KEYS}) AS k FROM forms) JOIN voc USING (k)),
  subs(letter, made, price) AS (VALUES {_SUBS}),
  walk(form, candidate, i, j, cost) AS (
    SELECT form, candidate, 0, 0, 0.0::DOUBLE FROM pairs
    UNION ALL
    SELECT form, candidate, i + 1, j + length(made), cost + price FROM (
      SELECT w.*, substr(candidate, i + 1, 1) AS made, 0.0::DOUBLE AS price FROM walk w WHERE i < length(candidate)
      UNION ALL SELECT w.*, s.made, s.price FROM walk w JOIN subs s ON s.letter = substr(w.candidate, w.i + 1, 1))
    WHERE starts_with(substr(form, j + 1), made)
  ), cost AS (SELECT form, candidate, min(cost) AS cost FROM walk WHERE i = length(candidate) AND j = length(form) GROUP BY ALL),
  scored AS (SELECT word, candidate, n, ln(n + 1) - 2.0 * min(cost + extra) AS score FROM forms JOIN cost USING (form) JOIN voc USING (candidate) GROUP BY word, candidate, n)
  SELECT word, candidate, round(score, 4) AS score, row_number() OVER (PARTITION BY word ORDER BY score DESC, n DESC, candidate)::INT AS rank FROM scored"""


@query(CANDIDATES)
def letters_candidates(spark, sf_dir):
    """Candidates of every distinct word of conversations, put into Cyrillic letters as in letter_repair, from the benchmark's words."""
    ship(spark)
    cyrillic = lambda c: F.translate(F.lower(c), "abvgdeziklmnoprstufxyhjcwq", "абвгдезиклмнопрстуфхыһйцүә")
    vocabulary = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").select(cyrillic("word").alias("word"))
    vocabulary = vocabulary.where(F.col("word").rlike("^[а-яһүә]+$")).groupBy("word").agg(F.count("*").alias("n"))
    texts = load(spark, sf_dir, "conversations").select(F.translate(cyrillic("text"), "һүә", "гуа").alias("text"))
    written = texts.select(F.explode(F.regexp_extract_all("text", F.lit("[а-я]+"), F.lit(0))).alias("word")).distinct()
    return lexicon.candidates(written, vocabulary).select("word", "candidate", F.round("score", 4).alias("score"), "rank")


@query(
    """WITH t AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations),
    s AS (SELECT conv_id, turn, regexp_extract_all(a, '[\\w\\pL''-]+') AS x, regexp_extract_all(b, '[\\w\\pL''-]+') AS y FROM t WHERE a IS NOT NULL)
    SELECT conv_id, turn, (CASE WHEN len(x) <> len(y) THEN 1 ELSE len(list_filter(list_zip(x, y), lambda p: p[1] <> p[2])) END)::INT AS n_pairs FROM s"""
)
def diff_words(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = load(spark, sf_dir, "conversations").withColumn("before", before).where("before IS NOT NULL")
    return t.select("conv_id", "turn", F.size(T.diff_words(F.col("before"), F.col("text"))).alias("n_pairs"))


@query(
    """WITH s AS (SELECT conv_id, list(length(text) ORDER BY turn) AS n FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, list_reduce(list_transform(n, lambda x: [x]), lambda acc, x: CASE WHEN acc[-1] + 2 + x[1] <= 3500 THEN list_concat(acc[:-2], [acc[-1] + 2 + x[1]]) ELSE list_concat(acc, x) END) AS packs FROM s)
    SELECT conv_id, array_to_string(packs, ' ') AS packs FROM p"""
)
def greedy_pack_turns(spark, sf_dir):
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"])
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(sizes.alias("sizes"))
    return c.select("conv_id", F.array_join(ordered.greedy_pack(F.col("sizes"), 3500).cast("array<string>"), " ").alias("packs"))


@query("SELECT p_partkey, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 10)::BIGINT AS page FROM part")
def pagination(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return load(spark, sf_dir, "part").select("p_partkey", F.floor((at - 1) / 10).alias("page"))


@query(
    """SELECT event_id, CASE WHEN event_id % 10 = 1 AND event_id % 100 <> 11 THEN event_id || ' столбец' WHEN event_id % 10 BETWEEN 2 AND 4 AND event_id % 100 NOT BETWEEN 12 AND 14
    THEN event_id || ' столбца' ELSE event_id || ' столбцов' END AS label FROM events"""
)
def plural_words(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", T.plural(F.col("event_id")).alias("label"))


@query("SELECT event_id, CASE WHEN ms < 1000 THEN round_even(ms, 0)::BIGINT || ' мс' ELSE replace(round_even(ms / 1000, 2)::DECIMAL(20, 2)::VARCHAR, '.', ',') || ' с' END AS took FROM (SELECT event_id, floor(value * 2) * 10 + 1 AS ms FROM events)")
def fmt_ms(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", T.fmt_ms((F.floor(F.col("value") * 2) * 10 + 1).cast("double")).alias("took"))


@query(
    """WITH b AS (SELECT l_returnflag, l_quantity::BIGINT AS v, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT l_returnflag, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0,
    sum(n) OVER e AS n, sum(n * v) OVER e AS s FROM b WINDOW w AS (PARTITION BY l_returnflag ORDER BY v), e AS (PARTITION BY l_returnflag)),
    q AS (SELECT *, CASE WHEN n0 < n THEN round(((n * s0 - n0 * s)::DOUBLE * (n * s0 - n0 * s) / (n0 * (n - n0)))::DOUBLE, 3) END AS score FROM c)
    SELECT l_returnflag, v AS threshold, n::BIGINT AS n FROM q QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC NULLS LAST, v) = 1"""
)
def otsu_threshold(spark, sf_dir):
    return ordered.otsu(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query(
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
    SELECT event_type, length, count(*) AS n FROM (SELECT user_id, event_type, g, count(*) AS length FROM r GROUP BY ALL) GROUP BY ALL"""
)
def run_lengths(spark, sf_dir):
    return ordered.runs(load(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type").groupBy("event_type", "length").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS b, floor(epoch(ts))::BIGINT + (value * 60)::BIGINT AS z FROM events), m AS (SELECT *, max(z) OVER (PARTITION BY user_id ORDER BY b, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR b - p > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, z) AS g FROM m)
    SELECT user_id, min(b) AS span_begin, max(z) AS span_end, count(*) AS n FROM g GROUP BY user_id, g"""
)
def merged_spans(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("b"), (F.unix_timestamp("ts") + F.round(F.col("value") * 60).cast("long")).alias("z"))
    return ordered.merged_spans(e, ["user_id"], "b", "z", F.lit(600)).select("user_id", F.col("begin").alias("span_begin"), F.col("end").alias("span_end"), "n")


@query(
    """WITH f AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS k, value FROM events),
    l AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM f)
    SELECT user_id, string_agg(k::VARCHAR, ' ' ORDER BY event_id) FILTER (k <> 0 AND k IS DISTINCT FROM p) AS labels, round(avg(value) FILTER (k <> 0), 4) AS confidence, count_if(k <> 0) AS inked FROM l GROUP BY user_id"""
)
def ctc_decode(spark, sf_dir):
    k = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    out = ordered.ctc_decode(load(spark, sf_dir, "events").withColumn("k", k), ["user_id"], ["event_id"], "k", "value")
    return out.withColumn("labels", F.array_join(F.transform("labels", lambda x: x.cast("string")), " "))


@query(
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)
    SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS confidence FROM x"""
)
def softmax_confidence(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(ordered.softmax(F.col("embedding"))), 6).alias("confidence"))


@query(
    """SELECT user_id, max(c) AS most_in_window FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS c
    FROM events) GROUP BY user_id"""
)
def rate_limit_audit(spark, sf_dir):
    rows = ordered.calls_in_window(load(spark, sf_dir, "events"), ["user_id"], F.unix_timestamp("ts"), 3600)
    return rows.groupBy("user_id").agg(F.max("in_window").alias("most_in_window"))


@query(
    """WITH l AS (SELECT *, last_value(CASE WHEN event_type IN ('error', 'click', 'signup') THEN event_id END IGNORE NULLS) OVER w AS at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT v.user_id, v.event_id, v.at AS request_id FROM l v JOIN events e ON e.event_id = v.at AND e.event_type = 'error' WHERE v.event_type = 'view'
    QUALIFY row_number() OVER (PARTITION BY v.user_id, v.at ORDER BY v.event_id) = 1"""
)
def pending_correction(spark, sf_dir):
    from sarnai.streaming.corrections import pending

    kind = F.when(F.col("event_type") == "error", "down").when(F.col("event_type").isin("click", "signup"), "command").when(F.col("event_type") == "view", "text").otherwise("other")
    log = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").alias("request_id"))
    return pending(log, ["user_id"]).select("user_id", F.col("seq").alias("event_id"), "request_id")
