"""Named queries for routing, replies, repair, reading and layout over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sarnai.functions import messages as M
from sarnai.operators import convert, layout, letters, lexicon, reading
from sarnai.plans import rules_sql as S
from sarnai.plans.catalogue import COUNTS, MIXED, NGRAMS, SCRIPT, _counted, _tokens, load, mixed_scripts, query
from sarnai.ship import ship

KIND = "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'off' WHEN 2 THEN 'on' WHEN 3 THEN 'frame' WHEN 4 THEN 'all' WHEN 5 THEN 'todo' WHEN 6 THEN 'fix' ELSE event_type END"


@query(
    f"""WITH s AS (SELECT event_id, {KIND} AS v FROM events) SELECT event_id, CASE WHEN v IN ('translit', 'todo', 'image', 'fix') THEN v ELSE 'translit' END AS mode,
    CASE WHEN v IN ('off', 'frame', 'all') THEN v ELSE 'off' END AS punctuation, v IS DISTINCT FROM 'off' AS show_time, coalesce(v = 'on', false) AS fix_letters FROM s"""
)
def settings_options(spark, sf_dir):
    v = F.col("v")
    rows = load(spark, sf_dir, "events").select("event_id", F.expr(KIND).alias("v"))
    return rows.select("event_id", M.valid_mode(v).alias("mode"), M.valid(v, M.PUNCTUATION, "off").alias("punctuation"), M.show_time(v).alias("show_time"), M.fix_letters(v).alias("fix_letters"))


@query(
    """SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'drop' WHEN event_type = 'click' THEN 'action' WHEN event_type = 'signup' THEN 'command'
    WHEN user_id % 5 = 0 AND NOT (event_id % 3 = 0 OR event_type = 'view' OR event_id % 7 = 0) THEN 'drop' WHEN event_type = 'view' THEN 'command'
    WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'ask_again' ELSE 'correction' END WHEN event_id % 13 = 0 THEN 'image' WHEN event_id % 2 = 1 THEN 'text' ELSE 'hint' END AS route FROM events"""
)
def message_routes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    at, kind = F.col("event_id"), F.col("event_type")
    keys = F.when(kind == "click", F.create_map(F.lit("a"), F.lit("fb"))).when(kind == "signup", F.create_map(F.lit("cmd"), F.lit("help"))).otherwise(F.create_map().cast("map<string,string>"))
    command = F.when(kind == "view", F.struct(F.lit("todo").alias("name"), F.lit("").alias("args")))
    route = M.route_message(
        F.when(F.col("user_id") % 11 == 0, -1).otherwise(F.col("user_id") + 1), F.when(F.col("user_id") % 5 == 0, M.CHAT_PEERS + 1).otherwise(F.col("user_id")),
        F.when(at % 2 == 1, "x").otherwise(" \n"), keys, command, at % 7 == 0, at % 3 == 0, at % 13 == 0,
    )
    return e.select("event_id", route.alias("route"))


@query("SELECT event_id, CASE WHEN w = 0 OR h = 0 THEN true ELSE greatest(w, h) <= 19 * least(w, h) AND w + h <= 14000 END AS ok FROM (SELECT event_id, event_id * 37 % 9000 AS w, event_id * 53 % 9000 AS h FROM events)")
def photo_sizes(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", M.photo_ok(F.col("event_id") * 37 % 9000, F.col("event_id") * 53 % 9000).alias("ok"))


@query(
    f"""SELECT doc_id, CASE WHEN quality = 1 THEN '✏️ Исправление' || chr(10) || chr(10) || '{M.FIX_TITLE}' || chr(10) || lang || chr(10) || chr(10) || '{M.LETTERS_FIXED}' || source || ' → ' || lang
    ELSE '🔤 Транслитерация' || chr(10) || chr(10) || '{M.LABEL_TRANSLIT}' || chr(10) || source || chr(10) || chr(10) || '{M.LABEL_CYRILLIC}' || chr(10) || lang END
    || CASE WHEN toxic = 1 THEN chr(10) || chr(10) || '⏱ 413 мс' ELSE '' END AS reply FROM labels JOIN documents USING (doc_id)"""
)
def reply_texts(spark, sf_dir):
    good, fix = F.col("quality") == 1, F.struct(F.col("source").alias("before"), F.col("lang").alias("after"))
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    none = F.array().cast("array<struct<before:string,after:string>>")
    reply = M.render(F.when(good, "fix").otherwise("translit"), F.lit("todo"), F.col("source"), F.lit("x"), F.col("lang"), F.col("lang"), F.when(good, F.array(fix)).otherwise(none), F.lit(""), F.lit(412.7), F.col("toxic") == 1)
    return rows.select("doc_id", reply.alias("reply"))


@query(
    """WITH RECURSIVE cut AS (
      SELECT doc_id, 0 AS i, text AS rest, NULL::VARCHAR AS piece FROM documents WHERE text IS NOT NULL
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN length(rest) > 4096 THEN ltrim(substr(rest, upto + 1), chr(10)) END, CASE WHEN length(rest) > 4096 THEN regexp_replace(substr(rest, 1, upto), '[\\s]+$', '') ELSE rest END
      FROM (SELECT *, CASE WHEN contains(h, chr(10) || chr(10)) AND two > 0 THEN two WHEN one > 0 THEN one ELSE 4096 END AS upto FROM (
        SELECT *, length(h) - strpos(reverse(h), chr(10) || chr(10)) - 1 AS two, CASE WHEN contains(h, chr(10)) THEN length(h) - strpos(reverse(h), chr(10)) ELSE 0 END AS one FROM (SELECT *, substr(rest, 1, 4096) AS h FROM cut WHERE rest IS NOT NULL)))
    ), p AS (SELECT doc_id, i, piece, max(i) OVER (PARTITION BY doc_id) AS last FROM cut WHERE i > 0)
    SELECT doc_id, count(*)::INT AS n_pieces, string_agg(md5(piece), ' ' ORDER BY i) AS digest FROM p WHERE NOT (piece = '' AND i = last AND i > 1) GROUP BY doc_id"""
)
def split_messages(spark, sf_dir):
    """The pieces of every text, as their number and digests."""
    pieces = M.split_text(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", pieces.alias("p")).select("doc_id", F.size("p").alias("n_pieces"), F.array_join(F.transform("p", lambda x: F.md5(x.cast("binary"))), " ").alias("digest"))


@query("SELECT conv_id, turn, (turn // 10)::BIGINT AS batch FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)")
def attachment_batches(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    batches = M.chunks(F.sequence(F.lit(0), F.col("n") - 1), M.ATTACHMENTS)
    rows = c.select("conv_id", F.posexplode(batches).alias("batch", "turns")).select("conv_id", "batch", F.explode("turns").alias("turn"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("batch").cast("long").alias("batch"))


@query()
def letter_repair(spark, sf_dir):
    """Texts of conversations put into Cyrillic letters against a vocabulary from the benchmark; held against golden texts in the tests."""
    ship(spark)
    cyrillic = lambda c: F.translate(F.lower(c), "abvgdeziklmnoprstufxyhjcwq", "абвгдезиклмнопрстуфхыһйцүә")
    vocabulary = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").select(cyrillic("word").alias("word"))
    vocabulary = vocabulary.where(F.col("word").rlike("^[а-яһүә]+$")).groupBy("word").agg(F.count("*").alias("n"))
    texts = load(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.translate(cyrillic("text"), "һүә", "гуа").alias("text"))
    none = vocabulary.where("false").select("word")
    fixed = letters.repair(texts, "id", "text", letters.Lexicon(vocabulary, none, none))
    return fixed.select("id", "flag", F.size("fixes").alias("n_fixes"), F.md5(F.col("fixed").cast("binary")).alias("digest"))


TRIPLES = "p AS MATERIALIZED (SELECT DISTINCT ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM t))"


@query(f"WITH {COUNTS}, {TRIPLES}, " + _counted('SELECT a, b, c, n_b = 0 AND n_bc > 0 AND n_bc >= least(n_b, n_c) AND n_bc > n_ab AS "right" FROM counted', "b=b, c=c, ab=a || b, bc=b || c"))
def joins_to_the_right(spark, sf_dir):
    freq = lexicon.words(load(spark, sf_dir, "documents"), "doc_id", "text").groupBy("word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("item_id").orderBy("pos")
    t = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("word").alias("a"), F.lead("word").over(w).alias("b"), F.lead("word", 2).over(w).alias("c"))
    return lexicon.goes_right(t.where("c IS NOT NULL").distinct(), freq)


INK = "SELECT user_id AS page_id, event_id AS y, event_id * 7 % 60 AS x0, event_id * 7 % 60 + 1 + event_id % 9 AS x1 FROM events"
BOXES = "SELECT user_id AS page_id, (event_id % 3)::INT AS col, event_id AS piece, event_id * 31 % 4000 AS y0, event_id * 31 % 4000 + 1 + event_id % 40 AS y1, event_id % 25 AS x0, event_id % 25 + 1 + event_id % 7 AS x1, event_id * 17 % 90 + 1 AS ink FROM events"


def _rows(spark, sf_dir: str, sql: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr(*sql.removeprefix("SELECT ").removesuffix(" FROM events").replace("::INT", "").split(", "))


@query(f"WITH r AS ({INK}), p AS (SELECT page_id, unnest(range(x0, x1)) AS x FROM r) SELECT page_id, x, count(*) AS n FROM p GROUP BY ALL")
def ink_projection(spark, sf_dir):
    found = layout.projection(_rows(spark, sf_dir, INK))
    return found.select("page_id", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "n")


@query(f"SELECT page_id, median(x1 - x0) AS s FROM ({INK}) GROUP BY page_id")
def stroke_widths(spark, sf_dir):
    return layout.stroke_width(_rows(spark, sf_dir, INK))


@query(
    f"""WITH r AS ({INK}), p AS (SELECT DISTINCT page_id, (y // 150)::BIGINT AS y, unnest(range(x0, x1)) AS x FROM r), g AS (SELECT *, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS g FROM p)
    SELECT page_id, x, min(y) AS y0, max(y) + 1 AS y1 FROM g GROUP BY page_id, x, g"""
)
def vertical_ink(spark, sf_dir):
    runs = _rows(spark, sf_dir, INK).withColumn("y", F.floor(F.col("y") / 150))
    return layout.islands(layout.pixels(runs).distinct(), ["page_id", "x"], "y", "y0", "y1")


@query(
    f"""WITH b AS ({BOXES}), d AS (SELECT page_id, count(*) FILTER (ink BETWEEN 0.9 AND 13.5) AS n, median(ink) FILTER (ink BETWEEN 0.9 AND 13.5) AS dot FROM b GROUP BY page_id)
    SELECT page_id, round(greatest(3.0, CASE WHEN n >= 5 THEN 0.35 * dot ELSE 0.72 END)::DOUBLE, 6) AS speck FROM d"""
)
def speck_areas(spark, sf_dir):
    boxes = _rows(spark, sf_dir, BOXES)
    s = boxes.select("page_id").distinct().withColumn("s", F.lit(3.0))
    return layout.speck_area(boxes, s).select("page_id", F.round("speck", 6).alias("speck"))


@query(
    f"""WITH b AS ({BOXES}), m AS (SELECT *, max(y1) OVER (PARTITION BY page_id, col ORDER BY y0, y1, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b)
    SELECT page_id, col, piece, sum(CASE WHEN y0 - p > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, col ORDER BY y0, y1, piece)::BIGINT AS "group" FROM m"""
)
def column_groups(spark, sf_dir):
    return layout.vertical_groups(_rows(spark, sf_dir, BOXES), F.lit(12)).select("page_id", "col", "piece", "group")


@query(
    f"""WITH b AS ({BOXES}), m AS (SELECT *, max(y1) OVER (PARTITION BY page_id, col ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM b)
    SELECT page_id, col, p AS y0, y0 AS y1 FROM m WHERE y0 - p >= 20"""
)
def column_gaps(spark, sf_dir):
    return layout.gaps(_rows(spark, sf_dir, BOXES), F.lit(20))


@query(
    f"""WITH b AS ({BOXES}), w AS (SELECT page_id, median(w) AS w FROM (SELECT page_id, col, max(x1) - min(x0) AS w FROM b WHERE ink > 36 GROUP BY ALL) GROUP BY page_id)
    SELECT page_id, w FROM w"""
)
def column_widths(spark, sf_dir):
    boxes = _rows(spark, sf_dir, BOXES)
    return layout.column_width(boxes, boxes.select("page_id").distinct().withColumn("s", F.lit(3.0))).select("page_id", "w")


@query(
    """WITH v AS (SELECT l_returnflag, l_quantity::BIGINT AS v FROM lineitem), c AS (SELECT DISTINCT l_returnflag, v FROM v), x AS (SELECT c.l_returnflag, c.v AS t, avg((v.v <= c.v)::INT) AS w, avg(v.v) FILTER (v.v <= c.v) AS a, avg(v.v) FILTER (v.v > c.v) AS b, var_pop(v.v) AS var
    FROM c JOIN v USING (l_returnflag) GROUP BY ALL) SELECT l_returnflag, round(max(w * (1 - w) * (b - a) ** 2 / var), 6) AS separability FROM x GROUP BY l_returnflag"""
)
def value_separability(spark, sf_dir):
    found = layout.separability(load(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("v")), ["l_returnflag"], "v")
    return found.select("l_returnflag", F.round("separability", 6).alias("separability"))


@query(
    """WITH p AS (SELECT l_returnflag, quantile_cont(l_quantity::DOUBLE, 0.005) AS lo, quantile_cont(l_quantity::DOUBLE, 0.995) AS hi FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, floor(least(greatest((l_quantity::DOUBLE - lo) * 255 / (hi - lo), 0.0), 255.0))::INT AS stretched, count(*) AS n FROM lineitem JOIN p USING (l_returnflag) GROUP BY ALL"""
)
def stretched_levels(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("v"))
    return layout.stretch(rows, ["l_returnflag"], "v").groupBy("l_returnflag", "stretched").agg(F.count("*").alias("n"))


READINGS = "SELECT user_id AS page_id, event_id AS candidate, round(value / 100, 4) AS confidence, (event_id % 5)::INT AS letters FROM events"


@query(f"SELECT * FROM ({READINGS}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY (letters >= 2) DESC, confidence DESC, candidate) = 1")
def best_readings(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("candidate"), F.round(F.col("value") / 100, 4).alias("confidence"), (F.col("event_id") % 5).cast("int").alias("letters"))
    return reading.best_reading(rows)


@query(f"{NGRAMS} SELECT ctx, count(DISTINCT ch) AS types FROM g WHERE k = 2 GROUP BY ctx")
def context_types(spark, sf_dir):
    counts = lexicon.ngram_counts(lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").select("word").distinct())
    return counts.where("k = 2").groupBy("ctx").agg(F.count("*").alias("types"))


@query(
    f"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, ['translit', 'todo', 'image', 'fix', 'other'][(doc_id // 5 % 5 + 1)::INT] AS target FROM ({MIXED})),
    s AS (SELECT *, {SCRIPT} AS script FROM t), e AS (SELECT *, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 10000 THEN 'too_long' WHEN script = 'unknown' THEN 'unknown_script'
      WHEN target = 'fix' AND script <> 'cyrillic' THEN 'not_cyrillic' WHEN target = 'todo' AND script = 'todo' THEN 'already_todo' WHEN target = 'other' THEN 'unknown_target' END AS error FROM s),
    c AS (SELECT *, regexp_extract_all(lower(text), '[{convert.WORD}]+(?:-[{convert.WORD}]+)*|[^{convert.WORD}]+') AS parts FROM e WHERE error IS NULL AND script = 'cyrillic' AND target <> 'fix'),
    d AS MATERIALIZED (SELECT translate(word, 'abvgdeziklmnoprstufh', 'абвгдезиклмнопрстуфх') AS word, min(word) AS translit FROM ({_tokens('benchmark')}) GROUP BY 1),
    p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM c), m AS (SELECT doc_id, string_agg(coalesce(d.translit, part), '' ORDER BY i) AS latin FROM p LEFT JOIN d ON d.word = part GROUP BY doc_id),
    w AS (SELECT e.doc_id, e.target, e.script, e.error, e.text, latin, CASE WHEN e.error IS NULL AND e.target <> 'fix' THEN CASE e.script WHEN 'translit' THEN e.text WHEN 'cyrillic' THEN latin
      WHEN 'todo' THEN CASE WHEN e.target = 'translit' THEN {S.todo_to_translit('e.text')} END END END AS translit FROM e LEFT JOIN m USING (doc_id))
    SELECT doc_id, target, script, error, md5(translit) AS digest, CASE WHEN error IS NULL AND target IN ('todo', 'image') THEN md5({S.strip_marks("CASE WHEN script = 'todo' THEN text ELSE " + S.to_todo('translit') + " END")}) END AS todo_digest FROM w"""
)
def convert_requests(spark, sf_dir):
    """Requests in every script and for every target; words of Cyrillic texts are looked up in a dictionary from the benchmark."""
    targets = F.array(*map(F.lit, (*M.MODES, "other")))
    requests = mixed_scripts(spark, sf_dir).select("doc_id", "text", F.get(targets, (F.floor(F.col("doc_id") / 5) % 5).cast("int")).alias("target"))
    words = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").select(F.translate("word", "abvgdeziklmnoprstufh", "абвгдезиклмнопрстуфх").alias("word"), F.col("word").alias("translit"))
    dictionary = words.groupBy("word").agg(F.min("translit").alias("translit"))
    done = convert.convert(requests, "doc_id", dictionary)
    return done.select("doc_id", "target", "script", "error", F.md5(F.col("translit").cast("binary")).alias("digest"), F.md5(F.col("todo").cast("binary")).alias("todo_digest"))


_WORD = convert.WORD
_LATIN = "abvgdeziklmnoprstufxyhjcwq", "абвгдезиклмнопрстуфхыһйцүә"


@query(
    f"""WITH d AS MATERIALIZED (SELECT translate(word, '{_LATIN[0]}', '{_LATIN[1]}') AS word, min(word) AS entry FROM ({_tokens('benchmark')}) GROUP BY 1),
    t AS (SELECT concat_ws('/', conv_id, turn) AS id, translate(lower(text), '{_LATIN[0]}', '{_LATIN[1]}') AS text FROM conversations),
    p AS (SELECT id, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(text, '[{_WORD}]+(?:-[{_WORD}]+)*|[^{_WORD}]+') AS x FROM t)),
    w AS (SELECT DISTINCT part, entry FROM p LEFT JOIN d ON d.word = part WHERE regexp_matches(part, '^[{_WORD}]')),
    h AS (SELECT part, unnest(string_split(part, '-')) AS piece, generate_subscripts(string_split(part, '-'), 1) AS j FROM w WHERE entry IS NULL AND contains(part, '-')),
    g AS (SELECT h.part, string_agg(coalesce(nullif(d.entry, ''), piece), ' ' ORDER BY j) AS joined FROM h LEFT JOIN d ON d.word = piece GROUP BY h.part HAVING bool_and(d.entry IS NOT NULL OR length(piece) > 2)),
    s AS (SELECT w.part, coalesce(entry, joined, w.part) AS made, CASE WHEN entry IS NOT NULL THEN 'dict' WHEN joined IS NOT NULL THEN 'split' ELSE 'model' END AS source FROM w LEFT JOIN g USING (part))
    SELECT id, md5(coalesce(string_agg(coalesce(made, p.part), '' ORDER BY i), '')) AS digest, count_if(source = 'dict')::BIGINT AS n_dict, count_if(source = 'split')::BIGINT AS n_split, count_if(source = 'model')::BIGINT AS n_model
    FROM (SELECT DISTINCT id FROM t) LEFT JOIN p USING (id) LEFT JOIN s USING (part) GROUP BY id"""
)
def convert_cyrillic(spark, sf_dir):
    """Conversations put into Cyrillic letters, transliterated by a dictionary from the benchmark; golden texts are in the tests."""
    cyrillic = lambda c: F.translate(F.lower(c), "abvgdeziklmnoprstufxyhjcwq", "абвгдезиклмнопрстуфхыһйцүә")
    words = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").select(cyrillic("word").alias("word"), F.col("word").alias("translit"))
    dictionary = words.groupBy("word").agg(F.min("translit").alias("translit"))
    texts = load(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), cyrillic("text").alias("text"))
    done = convert.transliterate(texts, "id", "text", dictionary)
    return done.select("id", F.md5(F.col("translit").cast("binary")).alias("digest"), "n_dict", "n_split", "n_model")
