"""Named queries for readers, sinks, readings and pieces of pages: what is written is read back and held against SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarnai.functions import font
from sarnai.functions import messages as M
from sarnai.operators import layout, lexicon, reading
from sarnai.plans.catalogue import COUNTS, NGRAMS, PAIRS, _counted, _tokens, load, query
from sarnai.plans.dialogue import BOXES, INK, _rows
from sarnai.shared import shared_folder
from sarnai.sources import readers, writers

NL = "chr(10)"


def _folder(spark, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@query("""SELECT '{"event":"vote","event_id":' || event_id || ',"event_type":"' || event_type || '","props":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"u' || user_id || '"' END || '}' AS value FROM events""")
def event_lines(spark, sf_dir):
    rows, to = load(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("props")), _folder(spark, "event-lines")
    writers.append_events(rows.where("event_id % 2 = 0"), "vote", to)
    writers.append_events(rows.where("event_id % 2 <> 0"), "vote", to)
    return spark.read.text(to)


@query(
    f"""SELECT 'feedback_id,lang,note' AS line UNION ALL
    SELECT l.doc_id || ',' || coalesce(lang, '') || ',' || CASE WHEN toxic = 1 THEN '"a ""b"", ' || l.doc_id || '"' ELSE '' END FROM labels l JOIN documents USING (doc_id)"""
)
def export_file(spark, sf_dir):
    """The lines of the export; the reader leaves out its byte order mark, which the tests look at."""
    note = F.when(F.col("toxic") == 1, F.concat(F.lit('a "b", '), F.col("doc_id").cast("string")))
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("feedback_id"), "lang", note.alias("note"))
    to = _folder(spark, "export")
    writers.write_export(rows, to)
    return spark.read.option("lineSep", "\r\n").text(to).select(F.col("value").alias("line"))


_LISTED = f"SELECT word, count(*) AS n, ['d', 'k', 'r'][(count(*) % 3 + 1)::INT] AS kind FROM ({_tokens('benchmark')}) WHERE regexp_full_match(word, '[a-z]+') GROUP BY word"


@query(f"WITH l AS ({_LISTED}) SELECT 'vocabulary' AS list, word, n FROM l WHERE kind <> 'r' UNION ALL SELECT 'trusted', word, NULL FROM l WHERE kind = 'd' UNION ALL SELECT 'protected', word, NULL FROM l WHERE kind = 'r' UNION ALL SELECT 'frequency', word, n FROM l")
def word_lists(spark, sf_dir):
    counted = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text").where("word RLIKE '^[a-z]+$'").groupBy("word").agg(F.count("*").alias("n"))
    kind = F.get(F.array(*map(F.lit, "dkr")), (F.col("n") % 3).cast("int"))
    lists, counts = _folder(spark, "word-list"), _folder(spark, "word-counts")
    counted.select("word", "n", kind.alias("kind")).write.csv(lists, sep="\t")
    counted.select("word", "n").write.csv(counts, sep="\t")
    vocabulary, trusted, protected = readers.read_vocabulary(spark, lists)
    named = lambda df, name: df.select(F.lit(name).alias("list"), "word", (F.col("n") if "n" in df.columns else F.lit(None).cast("long")).alias("n"))
    return named(vocabulary, "vocabulary").unionByName(named(trusted, "trusted")).unionByName(named(protected, "protected")).unionByName(named(readers.read_frequencies(spark, counts), "frequency"))


@query(
    """SELECT 'rule' AS kind, 'r' || (p_partkey % 3) AS name, p_brand AS key, p_type AS chunk, max(p_partkey) AS n FROM part GROUP BY ALL
    UNION ALL SELECT 'gap', p_brand, p_type, '', max(p_size) FROM part GROUP BY ALL"""
)
def rule_files(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    rules = part.groupBy(F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("name"), F.col("p_brand").alias("key"), F.col("p_type").alias("chunk")).agg(F.max("p_partkey").alias("n"))
    gaps = part.groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("key")).agg(F.max("p_size").alias("n"))
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    nested = rules.groupBy("name", "key").agg(entries("chunk", "n").alias("chunks")).groupBy("name").agg(entries("key", "chunks").alias("keys"))
    at, to = _folder(spark, "rules"), _folder(spark, "gaps")
    nested.groupBy().agg(F.to_json(entries("name", "keys")).alias("value")).write.text(at)
    gaps.groupBy("name").agg(entries("key", "n").alias("pairs")).groupBy().agg(F.to_json(entries("name", "pairs")).alias("value")).write.text(to)
    found = readers.read_rules(spark, at).select(F.lit("rule").alias("kind"), F.col("rule").alias("name"), "key", "chunk", "n")
    return found.unionByName(readers.read_gaps(spark, to).select(F.lit("gap").alias("kind"), F.col("font").alias("name"), F.col("pair").alias("key"), F.lit("").alias("chunk"), F.col("n").cast("long").alias("n")))


@query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS a FROM events")
def parsed_presses(spark, sf_dir):
    payload = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a":"'), F.col("event_type"), F.lit('"}'))).otherwise("none")
    obj = F.to_json(F.struct("user_id", F.col("event_id").cast("string").alias("event_id"), payload.alias("payload")))
    rows = load(spark, sf_dir, "events").select(M.parse_press(obj).alias("p"))
    return rows.select(F.col("p.event_id").cast("long").alias("event_id"), F.col("p.user_id").cast("long").alias("user_id"), F.try_element_at("p.payload", F.lit("a")).alias("a"))


_BETWEEN = "translate(regexp_replace(text, '[^\\s,.!?\\x{FE31}-]', '', 'g'), ',.!?-', '︐︒︕︖' || chr(8239))"


@query(f"SELECT item_id, md5({_BETWEEN}) AS digest FROM benchmark")
def font_marks(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.md5(font.between(F.col("text")).cast("binary")).alias("digest"))


_LETTERS = "ᠠᡄᡅᡆᡇᠨᡋᠯᠷᠰ"
_READ = f"SELECT user_id AS page_id, event_id AS col, translate((event_id * 7919)::VARCHAR, '0123456789', '{_LETTERS}') AS t, event_id % 4 AS k FROM events"


@query(
    f"""WITH r AS ({_READ}), t AS (SELECT page_id, col, t[1:2] || chr(8239) || t[3:3] || CASE k WHEN 0 THEN '  ' WHEN 1 THEN chr(8239) || '᠃' WHEN 2 THEN '︖' || chr(8239) ELSE ' ' END || t[4:] || ' ' AS t FROM r),
    p AS (SELECT page_id, col, list_transform(regexp_extract_all(t, '[^ \\x{{202F}}]+|[ \\x{{202F}}]+'), lambda w: CASE WHEN len(regexp_extract_all(w, '[ᠠ-ᢪ]')) BETWEEN 1 AND 2 AND NOT regexp_matches(w, '[ᠠᡄᡅᡆᡇᡈᡉ]') THEN regexp_replace(w, '[᠋-᠏ᠠ-ᢪ]', '', 'g') ELSE w END) AS ws FROM t),
    c AS (SELECT page_id, col, array_to_string(ws, '') AS c FROM p), m AS (SELECT page_id, col, regexp_replace(regexp_replace(regexp_replace(c, '^\\x{{202F}}+', ''), '\\x{{202F}}+([{reading.MARKS}])', '\\1', 'g'), '([{reading.MARKS}])\\x{{202F}}+', '\\1', 'g') AS c FROM c),
    e AS (SELECT page_id, col, regexp_replace(regexp_replace(regexp_replace(c, '\\x{{202F}}+$', ''), '\\x{{202F}}+', chr(8239), 'g'), ' +', ' ', 'g') AS c FROM m) SELECT page_id, col, trim(c, ' ') AS tidy FROM e"""
)
def tidied_readings(spark, sf_dir):
    t = F.translate((F.col("event_id") * 7919).cast("string"), "0123456789", _LETTERS)
    k = F.col("event_id") % 4
    middle = F.when(k == 0, "  ").when(k == 1, reading.NARROW + "᠃").when(k == 2, "︖" + reading.NARROW).otherwise(" ")
    line = F.concat(F.substring(t, 1, 2), F.lit(reading.NARROW), F.substring(t, 3, 1), middle, F.substring(t, 4, 99), F.lit(" "))
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("col"), reading.tidy(line).alias("tidy"))


_COLUMNS = "SELECT user_id AS page_id, event_id AS col, event_id % 9 AS k, event_id % 50 * 30 AS x0, event_id % 50 * 30 + 10 + event_id % 3 AS x1, CASE WHEN event_id % 11 = 0 THEN 400 ELSE event_id % 5 END AS y0, CASE WHEN event_id % 11 = 0 THEN 410 ELSE 100 + event_id % 7 END AS y1, (floor(value) + 0.5) / 100 AS p FROM events"


@query(
    f"""WITH c AS ({_COLUMNS}), j AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, k < 2 OR (k < 3 AND p < 0.9) OR (p < 0.8 AND p < 0.9) AS junk FROM c),
    a AS (SELECT *, count(*) OVER g AS n, median(w) OVER g AS mw, count(*) FILTER (NOT junk) OVER g AS kept, median(w) FILTER (NOT junk) OVER g AS kw, max(h) FILTER (NOT junk) OVER g AS kh FROM j WINDOW g AS (PARTITION BY page_id)),
    b AS (SELECT *, h >= 2 * mw AS tall FROM a), t AS (SELECT *, min(y0) FILTER (tall) OVER g AS top, max(y1) FILTER (tall) OVER g AS bottom FROM b WINDOW g AS (PARTITION BY page_id))
    SELECT page_id, col, junk, coalesce(n >= 3 AND NOT tall AND (y0 >= bottom OR y1 <= top), false) AS margin, coalesce(kept >= 3 AND junk AND k >= 7 AND w BETWEEN 0.6 * kw AND 1.6 * kw AND h BETWEEN 2 * kw AND 1.15 * kh, false) AS unreadable FROM t"""
)
def marked_columns(spark, sf_dir):
    e, k = F.col("event_id"), (F.col("event_id") % 9).cast("int")
    special = e % 11 == 0
    rows = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("page_id"), e.alias("col"), F.substring(F.lit("ᠠᡋ" * 5), F.lit(1), k).alias("text"), F.array_repeat((F.floor("value") + 0.5) / 100, k).alias("probs"),
        (e % 50 * 30).alias("x0"), (e % 50 * 30 + 10 + e % 3).alias("x1"), F.when(special, 400).otherwise(e % 5).alias("y0"), F.when(special, 410).otherwise(100 + e % 7).alias("y1"),
    )
    return reading.mark_columns(rows).select("page_id", "col", "junk", "margin", "unreadable")


@query(
    f"""WITH b AS ({BOXES}), cw AS (SELECT page_id, median(w) AS w FROM (SELECT page_id, col, max(x1) - min(x0) AS w FROM b WHERE ink > 36 GROUP BY ALL) GROUP BY page_id), k AS (SELECT b.*, w FROM b JOIN cw USING (page_id)),
    m AS (SELECT *, max(y1) OVER (PARTITION BY page_id, col ORDER BY y0, y1, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM k), g AS (SELECT *, sum(CASE WHEN y0 - p > 1.2 * w THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, col ORDER BY y0, y1, piece) AS g FROM m),
    i AS (SELECT *, sum(ink) OVER (PARTITION BY page_id, col, g) AS gi FROM g), t AS (SELECT *, max(gi) OVER (PARTITION BY page_id, col) AS most FROM i), f AS (SELECT * FROM t WHERE gi >= 0.15 * most OR gi > 60 * 9),
    x AS (SELECT *, min(x0) FILTER (ink > 36) OVER c AS bx0, max(x1) FILTER (ink > 36) OVER c AS bx1 FROM f WINDOW c AS (PARTITION BY page_id, col))
    SELECT page_id, col, piece FROM x WHERE ink > 36 OR bx0 IS NULL OR (x0 + x1) / 2 BETWEEN bx0 - 0.5 * w AND bx1 + 0.5 * w UNION ALL SELECT page_id, col, piece FROM b WHERE page_id NOT IN (SELECT page_id FROM cw)"""
)
def kept_pieces(spark, sf_dir):
    boxes = _rows(spark, sf_dir, BOXES)
    return layout.drop_strays(boxes, boxes.select("page_id").distinct().withColumn("s", F.lit(3.0))).select("page_id", "col", "piece")


@query(
    f"""WITH r AS ({INK}), q AS (SELECT DISTINCT page_id, x0 + 2 AS x FROM r WHERE y % 5 = 0), n AS (SELECT DISTINCT q.page_id, q.x, r.y // 40 AS y FROM q JOIN r ON r.page_id = q.page_id AND r.x0 <= q.x + 1 AND r.x1 > q.x - 1),
    g AS (SELECT *, y - row_number() OVER (PARTITION BY page_id, x ORDER BY y) AS g FROM n) SELECT DISTINCT page_id, x FROM (SELECT page_id, x, count(*) AS h FROM g GROUP BY page_id, x, g) WHERE h >= 3"""
)
def spined_points(spark, sf_dir):
    runs = _rows(spark, sf_dir, INK)
    points = runs.where("y % 5 = 0").select("page_id", (F.col("x0") + 2).alias("x")).distinct()
    s = runs.select("page_id").distinct().withColumn("s", F.lit(1.0))
    return layout.has_spine(runs.withColumn("y", F.floor(F.col("y") / 40)), points, s)


def _probability(k: int) -> str:
    """Of the symbol after a context of k symbols, from the levels below."""
    if k < 0:
        return "base"
    lower = _probability(k - 1)
    return f"CASE WHEN v[{k + 1}].total IS NULL THEN {lower} ELSE v[{k + 1}].total / (v[{k + 1}].total + v[{k + 1}].types) * v[{k + 1}].n / v[{k + 1}].total + (1 - v[{k + 1}].total / (v[{k + 1}].total + v[{k + 1}].types)) * ({lower}) END"


@query(
    f"""WITH {COUNTS}, {PAIRS}, {_counted("SELECT a, b, n_b < 5 OR (n_a = 0 AND length(a) <= 2) AS piece FROM counted", "a=a, b=b").replace("counted AS (", "counted AS MATERIALIZED (").replace(") SELECT a, b, n_b", "), pieces AS MATERIALIZED (SELECT a, b, n_b", 1)}),
    {NGRAMS.removeprefix("WITH ").replace("y AS (", "y0 AS (", 1).replace("FROM y)", "FROM y0)", 1).replace("p AS (", "pt AS (", 1).replace("FROM p)", "FROM pt)", 1)},
    c AS MATERIALIZED (SELECT k, ctx, ch, count(*)::DOUBLE AS n FROM g GROUP BY ALL), x AS MATERIALIZED (SELECT k, ctx, sum(n) AS total, count(*)::DOUBLE AS types FROM c GROUP BY ALL), b0 AS (SELECT 1.0::DOUBLE / (count(*) + 1) AS base FROM c WHERE k = 0),
    asked AS (SELECT a AS word FROM pieces WHERE piece UNION SELECT b FROM pieces WHERE piece UNION SELECT a || b FROM pieces WHERE piece), padded AS (SELECT word, '^^^^' || word || '$' AS s FROM asked), ai AS (SELECT word, s, unnest(range(5, length(s) + 1)) AS i FROM padded),
    ag AS (SELECT word, i, s[i] AS ch, k::INT AS k, CASE WHEN k = 0 THEN '' ELSE s[i - k : i - 1] END AS ctx FROM ai, range(0, 5) r(k)), l AS (SELECT word, i, list(struct_pack(total := total, types := types, n := coalesce(n, 0)) ORDER BY k) AS v FROM ag LEFT JOIN x USING (k, ctx) LEFT JOIN c USING (k, ctx, ch) GROUP BY ALL),
    lp AS MATERIALIZED (SELECT word, sum(ln({_probability(4)})) AS logp FROM l, b0 GROUP BY word)
    SELECT a, b, CASE WHEN piece THEN round(ab.logp - la.logp - lb.logp, 4) END AS gain, coalesce(piece AND ab.logp - la.logp - lb.logp > 10, false) AS lifted FROM pieces LEFT JOIN lp la ON la.word = a LEFT JOIN lp lb ON lb.word = b LEFT JOIN lp ab ON ab.word = a || b"""
)
def pen_lift_gains(spark, sf_dir) -> DataFrame:
    """Pairs of the benchmark's words, counted in documents; the model of symbols is of the benchmark's word types."""
    bench = lexicon.words(load(spark, sf_dir, "benchmark"), "item_id", "text")
    counts = lexicon.words(load(spark, sf_dir, "documents"), "doc_id", "text").groupBy("word").agg(F.count("*").alias("n"))
    pairs = load(spark, sf_dir, "benchmark").select(F.filter(F.split(F.lower("text"), "[ \n]+"), lambda w: w != "").alias("ws"))
    pairs = pairs.select(F.explode(F.arrays_zip(F.slice("ws", 1, F.size("ws") - 1).alias("a"), F.slice("ws", 2, F.size("ws") - 1).alias("b"))).alias("p")).select("p.a", "p.b").distinct()
    found = lexicon.pen_lifts(pairs, counts, types=bench.select("word").distinct())
    return found.select("a", "b", F.round("gain", 4).alias("gain"), "lifted")
