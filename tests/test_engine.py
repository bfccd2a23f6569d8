"""Folds, ordered operators, lexicon, sources and the stream against small hand-made rows and the SQL oracles."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sarnai.operators import lexicon, ordered, store
from sarnai.plans import catalogue, dialogue  # noqa: F401 - dialogue registers its queries
from sarnai.sources import readers
from sarnai.streaming import corrections

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


LOG = [(1, 10, "down", None, 1), (1, 10, "down", "fix", 2), (1, 10, "up", None, 3), (3, None, "up", None, 4), (3, None, "down", "x", 5)]


def test_live_and_restore_differ(spark):
    log = spark.createDataFrame(LOG, "request_id long, user_id long, rating string, correction string, seq long")
    live = {(r.request_id, r.rating, r.correction) for r in store.fold_live(log, ["request_id", "user_id"], "seq", "rating", "correction").collect()}
    first = {(r.request_id, r.rating, r.correction) for r in store.restore_first_wins(log, ["request_id", "user_id"], "seq").collect()}
    assert live == {(1, "up", "fix"), (3, "up", None), (3, "down", "x")}
    assert first == {(1, "down", None), (3, "up", None), (3, "down", "x")}


def test_reset_keeps_mode(spark):
    log = spark.createDataFrame([(1, "fg", "red", 1), (1, "mode", "image", 2), (1, "reset", None, 3), (2, "fg", "blue", 4)], "user_id long, field string, value string, seq long")
    rows = {r.user_id: r for r in store.fold_settings(log).collect()}
    assert (rows[1].fg, rows[1].mode, rows[2].fg) == (None, "image", "blue")


def test_ctc(spark):
    frames = spark.createDataFrame([(1, i, k, 0.5) for i, k in enumerate([0, 3, 3, 0, 3, 5, 5, 0])], "col int, t int, k int, p double")
    row = ordered.ctc_decode(frames, ["col"], ["t"], "k", "p").first()
    assert (row.labels, row.inked) == ([3, 3, 5], 5)


def test_greedy_pack(spark):
    row = spark.range(1).select(ordered.greedy_pack(F.array(*map(F.lit, [5, 4, 20, 1, 1])), 11).alias("p")).first()
    assert row.p == [11, 20, 4]


@pytest.mark.parametrize(("right", "written", "cost"), [("бәәдл", "бяядл", 0.6), ("һалун", "hалун", None), ("күн", "кюн", 0.5), ("җил", "джил", 1.0), ("аһ", "а", 2.5), ("күн", "кон", None)])
def test_channel(right, written, cost):
    got = lexicon.channel_cost(right, written)
    assert got == (None if cost is None else pytest.approx(cost))


def test_joins(spark):
    freq = spark.createDataFrame([("ged", 5), ("gedeq", 2881), ("ü", 4), ("dü", 9057), ("örgöǰi", 173), ("kü", 2), ("örgöǰikü", 2), ("erdeni", 183)], "word string, n long")
    pairs = spark.createDataFrame([("ged", "eq"), ("d", "ü"), ("örgöǰi", "kü"), ("erdeni", "dü")], "a string, b string")
    assert {(r.a, r.joined) for r in lexicon.should_join(pairs, freq).collect()} == {("ged", True), ("d", True), ("örgöǰi", True), ("erdeni", False)}


def test_candidates_prefer_frequent(spark):
    vocabulary = spark.createDataFrame([("бәәнт", 9), ("баант", 500)], "word string, n long")
    rows = lexicon.candidates(spark.createDataFrame([("бяянт",)], "word string"), vocabulary).collect()
    assert [r.candidate for r in rows] == ["бәәнт"]


def test_candidates_of_six_words(spark):
    vocabulary = spark.createDataFrame([("бәәдл", 50), ("бәәнт", 9), ("һалун", 20), ("күн", 90), ("көвүн", 70), ("дуһарна", 3)], "word string, n long")
    written = spark.createDataFrame([("бяядл",), ("галун",), ("кюн",), ("ковун",), ("дугарна",), ("бяянт",)], "word string")
    best = {r["word"]: r["candidate"] for r in lexicon.candidates(written, vocabulary).where("rank = 1").collect()}
    assert best == {"бяядл": "бәәдл", "галун": "һалун", "кюн": "күн", "ковун": "көвүн", "дугарна": "дуһарна", "бяянт": "бәәнт"}


def test_letters_candidates_reads_the_tables(spark, tmp_path):
    spark.createDataFrame([(1, "qlwn xalun"), (2, "qlwn")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "Xalun, qlwn."), (1, 1, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = catalogue.QUERIES["letters_candidates"](spark, str(tmp_path)).where("rank = 1").collect()
    assert {(r["word"], r["candidate"]) for r in rows} == {("халун", "халун"), ("алун", "әлүн")}


def test_event_log_and_word_list(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event":"request","id":1,"ok":1}\n\n{"event":"feedback","request_id":1,"rating":"up"}\n{"event":"other"}\n{bad\n[1]\n')
    rows = readers.read_event_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert sorted(r.route for r in rows) == ["broken", "broken", "broken", "feedback", "request"]
    (tmp_path / "v.tsv").write_text("a\t3\td\nb\t4\tk\nc\t9\tr\n")
    vocabulary, trusted, protected = readers.read_vocabulary(spark, str(tmp_path / "v.tsv"))
    assert ({r.word for r in vocabulary.collect()}, {r.word for r in trusted.collect()}, {r.word for r in protected.collect()}) == ({"a", "b"}, {"a"}, {"c"})
    (tmp_path / "gaps.json").write_text('{"f": {"ab": 2, "cd": 1}}')
    assert {(r.font, r.pair, r.n) for r in readers.read_gaps(spark, str(tmp_path / "gaps.json")).collect()} == {("f", "ab", 2), ("f", "cd", 1)}


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["down", "text", "text", "down", "command", "text", "down", "other", "down", "text"]
    log = spark.createDataFrame([(u, 10 * u + i, k, 100 * u + i) for u in (1, 2) for i, k in enumerate(kinds)], corrections.EVENT)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    found = corrections.pending_stream(spark.readStream.schema(corrections.EVENT).parquet(str(tmp_path / "log")))
    query = found.writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = {tuple(r) for r in corrections.pending(log, ["user_id"]).select("user_id", "seq", "request_id").collect()}
    assert {tuple(r) for r in spark.table("found").collect()} == batch
    assert len(batch) == 4
