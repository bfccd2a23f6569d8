"""Parsing, routing, replies, packing; the font rules, the recurrent models and the long-poll source."""

import itertools
import json

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sarnai.functions import font, recurrent
from sarnai.functions import messages as M
from sarnai.plans import catalogue, rules
from sarnai.sources import longpoll

PHOTO = {"type": "photo", "photo": {"id": 7, "owner_id": 5, "sizes": [{"url": "s", "width": 1, "height": 2}, {"url": "l", "width": 9, "height": 9}, {"url": "m", "width": 9, "height": 9}]}}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_parse_message(spark):
    obj = {"message": {"from_id": 5, "peer_id": 0, "text": None, "payload": '{"a":"fb","r":3}', "attachments": [{"type": "doc", "doc": {"ext": "PDF"}}, PHOTO]}, "client_info": {"button_actions": ["text", "callback"]}}
    row = value(spark, M.parse_message(F.lit(json.dumps(obj))))
    assert (row.peer_id, row.from_id, row.text, row.payload, row.callback, row.keyboard) == (5, 5, "", {"a": "fb", "r": "3"}, True, True)
    picked = value(spark, M.pick_attachment(M.parse_message(F.lit(json.dumps(obj)))["attachments"]))
    assert tuple(picked) == ("image", "l", "photo5_7")
    bare = value(spark, M.parse_message(F.lit('{"message":{"from_id":5,"payload":"[1]"}}')))
    assert (bare.payload, bare.button_actions, bare.attachments) == (None, ["text"], [])
    press = value(spark, M.parse_press(F.lit('{"user_id":1,"peer_id":2,"event_id":"e","payload":"{bad"}')))
    assert (press.user_id, press.payload) == (1, {})


CHAT = 2_000_000_001
ROUTES = [
    (-1, 5, "x", {}, None, False, True, False, "drop"), (5, 5, "x", {"a": "fb"}, None, True, True, True, "action"), (5, 5, "", {"cmd": "help"}, None, True, True, False, "command"),
    (5, CHAT, "x", {}, None, False, False, True, "drop"), (5, CHAT, "x", {}, "help", False, False, False, "command"), (5, CHAT, "x", {}, None, True, False, False, "correction"),
    (5, 5, " \n", {}, None, True, True, True, "ask_again"), (5, 5, "x", {}, None, False, True, True, "image"), (5, 5, "x", {}, None, False, True, False, "text"), (5, 5, "", {}, None, False, True, False, "hint"),
]


def test_routes(spark):
    rows = spark.createDataFrame([(*r[:4], (r[4], "") if r[4] else None, *r[5:]) for r in ROUTES], "f long, p long, t string, k map<string,string>, c struct<name:string,args:string>, pend boolean, addr boolean, file boolean, want string")
    got = rows.select(M.route_message(F.col("f"), F.col("p"), F.col("t"), F.col("k"), F.col("c"), F.col("pend"), F.col("addr"), F.col("file")).alias("r"), "want").collect()
    assert [r.r for r in got] == [r.want for r in got]
    names = spark.createDataFrame([("cancel",), ("todo",), ("stats",), ("x",), (None,)], "n string").select(M.run_command(F.col("n")).alias("r")).collect()
    assert [tuple(r.r) for r in names] == [("cancel", False), ("switch", True), ("stats", True), ("unknown", True), ("unknown", False)]


def test_settings(spark):
    rows = spark.createDataFrame([("todo", "off", "on"), ("x", None, None), (None, "", "off")], "m string, s string, f string")
    got = rows.select(M.valid_mode(F.col("m")), M.show_time(F.col("s")), M.fix_letters(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("todo", False, True), ("translit", True, False), ("translit", True, False)]
    assert [value(spark, M.photo_ok(F.lit(w), F.lit(h))) for w, h in ((1900, 100), (1901, 100), (0, 5), (7000, 7001))] == [True, False, True, False]
    assert value(spark, M.resolve_color(F.lit(" Красный "), {"красный": "red"}, F.lit("black"))) == "red"
    assert tuple(value(spark, M.text_and_ground(F.lit("red"), F.lit("red")))) == ("black", "white", True)
    assert value(spark, M.int_list(F.lit("1; 2,x,,3"))) == [1, 2, 3]
    assert value(spark, M.now(F.lit("2025-01-01 00:00:00").cast("timestamp"))) == "2025-01-01T00:00:00+00:00"
    assert value(spark, M.flatten(F.create_map(*map(F.lit, ["a", "true", "b", "[1,2]", "c", "null", "d", '"x"'])))) == {"a": "1", "b": "1,2", "d": "x"}


def test_source_text_and_log(spark):
    rows = [("fix", '{"text":"b"}', "b"), ("fix", "{bad", "a"), ("fix", '{"text":""}', "a"), ("todo", '{"text":"b"}', "a")]
    df = spark.createDataFrame(rows, "t string, j string, want string").select(M.source_text(F.col("t"), F.col("j"), F.lit("a")).alias("g"), "want")
    assert all(r.g == r.want for r in df.collect())
    none = F.array().cast("array<struct<before:string,after:string>>")
    assert value(spark, M.letters_log(F.lit("todo"), F.lit(True), F.lit(""), none, F.lit("x"))) is None
    assert json.loads(value(spark, M.letters_log(F.lit("fix"), F.lit(True), F.lit(""), none, F.lit("x")))) == {"enabled": True, "flag": "", "fixes": [], "text": "x"}


def reply(spark, target, script="cyrillic", translit="t", todo="d", cyrillic=None, fixed=None, fixes=(), flag="", ms=412.7, timed=True):
    pairs = F.array(*(F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in fixes)).cast("array<struct<before:string,after:string>>")
    s = lambda x: F.lit(x).cast("string")
    return value(spark, M.render(s(target), s(script), s(translit), s(todo), s(cyrillic), s(fixed), pairs, s(flag), F.lit(ms), F.lit(timed)))


def test_replies(spark):
    assert reply(spark, "translit") == "🔤 Транслитерация\n\nt\n\n⏱ 413 мс"
    assert reply(spark, "translit", "todo", cyrillic="к", timed=False) == "🔤 Транслитерация\n\nТранслитерация:\nt\n\nКириллица:\nк"
    assert reply(spark, "translit", "translit", cyrillic="к", timed=False) == "🔤 Транслитерация\n\nКириллица:\nк"
    assert reply(spark, "todo", flag="vocab", timed=False) == f"ᡐ Тодо бичик\n\nТранслитерация:\nt\n\nТодо бичик:\nd\n\n{M.LETTERS_HINT}"
    assert reply(spark, "fix", timed=False) == f"✏️ Исправление\n\n{M.FIX_NOTHING}"
    many = [(f"a{i}", f"b{i}") for i in range(14)]
    assert reply(spark, "fix", fixed="f", fixes=many, timed=False).endswith("a11 → b11 и ещё 2")


def brute_cut(text, limit):
    out = []
    while len(text) > limit:
        head = text[:limit]
        at = head.rfind("\n\n") if head.rfind("\n\n") > 0 else head.rfind("\n") if head.rfind("\n") > 0 else limit
        out.append(text[:at].rstrip())
        text = text[at:].lstrip("\n")
    return out + ([text] if text or not out else [])


def test_splitting_and_packing(spark):
    texts = ["".join(p) for n in range(8) for p in itertools.product("a\n", repeat=n)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", M.split_text(F.col("t"), 3).alias("s")).collect()
    assert all((r.s == brute_cut(r.t, 3)) if r.t is not None else (r.s in (None, [None])) for r in rows)
    words = F.array(F.lit("a"), F.lit("bb"), F.lit("c" * 8))
    assert value(spark, M.pack_blocks(words, 6)) == ["a\n\nbb", "c" * 8]
    assert value(spark, M.line_blocks("T", words, 6)) == ["T\na\nbb", "c" * 8]
    assert value(spark, M.line_blocks("T", F.array().cast("array<string>"), 6)) == ["T\n"]
    assert value(spark, M.chunks(F.array(*map(F.lit, range(5))), 2)) == [[0, 1], [2, 3], [4]]
    assert tuple(value(spark, M.palette_page(F.array(*map(F.lit, range(10))), F.lit(9)))) == (1, 2, [8, 9])
    assert [tuple(p) for p in value(spark, M.page_starts(F.array(*map(F.lit, [10, 10, 10])), F.array(F.lit(True), F.lit(False), F.lit(True)), 40, 2, 4, 5))] == [(0, 5), (0, 17), (1, 5)]
    assert value(spark, M.wrap_words(F.array(*map(F.lit, [5, 5, 30, 1])), 1, 12)) == [0, 0, 1, 2]
    assert value(spark, M.capitalize_sentences(F.lit("ab. cd! e\nf? g"))) == "Ab. Cd! E\nf? G"
    texts = M.render_ocr(F.array(F.lit("x")), F.array(F.lit("y")), F.array().cast("array<string>"), F.lit(2), F.lit(True), F.lit(5.0), F.lit(True))
    assert value(spark, texts)[0].startswith("📷 Текст с фото · столбцов: 1\n\nТранслитерация:\ny\n\nТодо бичик:\nx\n\n⚠️ Не разобрал 2 столбца")


def test_capitals_keep_every_character(spark):
    assert value(spark, M.capitalize_sentences(F.lit("ßa. ßb.\n"))) == "ẞa. ẞb.\n"
    assert [value(spark, M.capitalize_sentences(F.lit(t))) for t in ("a\n", "\n\n", "a.\r\n", "a.\u00a0b")] == ["A\n", "\n\n", "A.\r\n", "A.\u00a0B"]


def test_capitalized_texts_equal_sql(spark, tmp_path):
    letters = [chr(c) for c in range(1, 0x1F000) if not 0xD800 <= c < 0xE000 and (chr(c).lower() != chr(c).upper() or chr(c).isspace() or 0xA7C0 <= c < 0xA7E0 or 0x1C80 <= c < 0x1C90 or 0x10D40 <= c < 0x10D90)]
    texts = [p.replace("@", c) for c in letters for p in ("@", "a. @b", "A@", "ab.@cd", "x@\n", "Σ@Σ. Σ@")]
    texts += [None, "", "\n", "\n\n", "a.\r\n", "a. b\r\n", "..  .a", "a?! b"]
    at = str(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}'")
    want = dict(con.execute(catalogue.ORACLES["capitalized_texts"]).fetchall())
    got = {r.doc_id: r.digest for r in rules.capitalized_texts(spark, str(tmp_path)).collect()}
    assert [texts[i] for i in want if got[i] != want[i]] == [] and len(got) == len(texts)


RULES = font.Rules({"r_uni": {"a": {"A": 3}, "b": {"B": 2}, "aˉ": {"Ъ": 1}, "ˉ": {"~": 9}, "ab": {"X": 1}}, "r_pos": {"S|a": {"1": 1}}, "r_prev": {}, "r_next": {}, "r_tri": {"I|#|b|a": {"Y": 2}}}, {"a": 0.9, "b": 0.9, "ab": 0.85, "ˉ": 0.9, "aˉ": 0.001})


@pytest.mark.parametrize(("word", "want"), [("a", "1"), ("b", "B"), ("ab", "X"), ("ba", "BA"), ("taˉ", "taˉ"), ("", ""), ("aˉ", "Ъ"), ("baˉ", "BA~")])
def test_font_words(word, want):
    assert RULES.word(word) == want


def test_font_lines(spark):
    rows = spark.createDataFrame([(1, "Ab, ba-b 5\nb"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.record for r in font.translit_to_font(rows, "id", "t", RULES).collect()}
    assert got[1] == "X︐ BA B \nB" and (got[2] or "", got[3] or "") == ("", "")
    gaps = spark.createDataFrame([("AB", 2)], "pair string, n int")
    fitted = font.space_pairs(spark.createDataFrame([(1, "AB AB"), (2, "")], "id long, r string"), "id", "r", gaps).collect()
    assert {r.id: r.fitted or "" for r in fitted} == {1: "A__B  A__B", 2: ""}
    assert value(spark, font.fit_charset(F.lit("5€€/к «a»"), '5кa/"', {"«": '"'})) == '5 /к "a '


def brute_gru(x, w, backward=False):
    wi, wh, bi, bh = w
    n, h, out = len(wh[0]), np.zeros(len(wh[0])), [None] * len(x)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for t in range(len(x))[:: -1 if backward else 1]:
        i, r = wi @ x[t] + bi, wh @ h + bh
        a, z = sig(i[:n] + r[:n]), sig(i[n : 2 * n] + r[n : 2 * n])
        h = (1 - z) * np.tanh(i[2 * n :] + a * r[2 * n :]) + z * h
        out[t] = h
    return np.array(out)


def gru_weights(rng, n, h):
    return [rng.normal(size=s).astype(np.float32) for s in ((3 * h, n), (3 * h, h), (3 * h,), (3 * h,))]


@pytest.mark.parametrize("backward", [False, True])
def test_gru(backward):
    rng = np.random.default_rng(0)
    w, x = gru_weights(rng, 3, 4), rng.normal(size=(6, 2, 3)).astype(np.float32)
    got = recurrent.run_gru(x, tuple(w), backward)
    for k in range(2):
        assert np.allclose(got[:, k], brute_gru(x[:, k], w, backward), atol=1e-5)


def test_models_from_files(spark, tmp_path):
    rng, e, h = np.random.default_rng(1), 3, 4
    source, target = ["<pad>", "<s>", "</s>", "<unk>", "a", "b", " "], ["<pad>", "<s>", "</s>", "<unk>", "x", "y", "z"]
    named = lambda p, n, s="": dict(zip([f"{p}.{k}{s}" for k in recurrent.GRU], gru_weights(rng, n, h), strict=True))
    normal = lambda *s: rng.normal(size=s).astype(np.float32)
    w = {"encoder.emb.weight": normal(7, e), **named("encoder.gru", e, "_l0"), **named("encoder.gru", e, "_l0_reverse"), "encoder.fc.weight": normal(h, 2 * h), "encoder.fc.bias": normal(h), "decoder.emb.weight": normal(7, e),
         "decoder.attention.attn.weight": normal(h, 3 * h), "decoder.attention.attn.bias": normal(h), "decoder.attention.v.weight": normal(1, h), **named("decoder.gru", e + 2 * h), "decoder.out.weight": normal(7, 3 * h + e), "decoder.out.bias": normal(7)}
    save = lambda name, meta, w: np.savez(tmp_path / name, meta_json=np.frombuffer(json.dumps(meta).encode(), np.uint8), **w)
    save("m.npz", {"src_vocab": source, "tgt_vocab": target, "dictionary": {}, "max_len": 6}, w)
    save("s.npz", {"itos": ["<pad>", "<unk>", "a", "b", " "], "threshold": 0.5, "layers": 1}, {"emb.weight": normal(5, e), **named("gru", e, "_l0"), **named("gru", e, "_l0_reverse"), "out.weight": normal(1, 2 * h), "out.bias": normal(1)})
    model = recurrent.WordModel(str(tmp_path / "m.npz"))
    words = ["ab", "ba", "a", "abab", "", "q"]
    batched = model.translate(words)
    assert batched == {x: model.decode([x])[0] for x in words}
    lines = spark.createDataFrame([(1, "ab ba-A"), (2, ""), (3, "a")], "id long, t string")
    got = {r.id: r.cyrillic for r in recurrent.lines_to_cyrillic(lines, "id", "t", str(tmp_path / "s.npz"), str(tmp_path / "m.npz"), 2.0).collect()}
    assert got == {1: " ".join(filter(None, (model.decode([p])[0] for p in ("ab ba", "a")))), 2: "", 3: model.decode(["a"])[0]}
    missing = spark.createDataFrame([("a",)], "w string").select(recurrent.translate_word(spark, str(tmp_path / "none.npz"), optional=True)("w").alias("v"))
    assert missing.first().v is None


def test_groups_and_windows(spark):
    probs = F.array(*[F.lit(0.9 if i == 4 else 0.0) for i in range(13)])
    assert value(spark, recurrent.groups(F.lit("oron du takil"), probs, 0.5)) == [["oron", "du"], ["takil"]]
    assert value(spark, recurrent.windows(F.array(*[F.array(F.lit(s)) for s in ["oron", ",", "du", "takil", "!"]]))) == ["oron , du", "takil !"]
    assert value(spark, recurrent.normalize_line(F.lit(" Ab-cd ef "))) == "ab cd ef"


class Server:
    def __init__(self, answers):
        self.answers, self.asked, self.keys = list(answers), [], iter(range(1, 9))

    def server(self):
        k = next(self.keys)
        return {"server": "s", "key": f"k{k}", "ts": 100 * k}

    def check(self, server, key, ts, wait):
        self.asked.append((key, ts))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_long_poll():
    pauses = []
    client = Server([{"ts": 101, "updates": [{"type": "a"}]}, {"failed": 1, "ts": 150}, OSError(), OSError(), {"failed": 2}, {"failed": 3}, {"ts": 301, "updates": []}])
    source = longpoll.LongPoll(client, sleep=pauses.append)
    ts, seen = source.position(), []
    while client.answers:
        updates, ts = source.poll(ts)
        seen += updates
    assert seen == [{"type": "a"}] and pauses == [1.0, 2.0]
    assert client.asked == [("k1", 100), ("k1", 101), ("k1", 150), ("k1", 150), ("k1", 150), ("k2", 150), ("k3", 300)]


def test_long_poll_replays_a_batch_whole(monkeypatch):
    import sys
    import types

    one, two, late = ({"type": "t", "object": k} for k in (1, 2, 3))
    client = Server([{"ts": 102, "updates": [one, two]}, {"ts": 103, "updates": [late]}, {"ts": 103, "updates": [one, two, late]}])
    module = types.ModuleType("a_client")
    module.make = lambda: client
    monkeypatch.setitem(sys.modules, "a_client", module)
    reader = longpoll.Reader({"connect": "a_client:make"})
    start = reader.initialOffset()
    first, middle = reader.read(start)
    rows = list(first)
    later, end = reader.read(middle)
    assert len(rows) == 2 and list(reader.readBetweenOffsets(start, middle)) == rows
    assert list(reader.readBetweenOffsets(start, end)) == rows + list(later)
    reader.commit(middle)
    assert list(reader.answers) == [102]
    again = longpoll.Reader({"connect": "a_client:make"})  # after a restart the server's answer holds more than the batch did
    assert list(again.readBetweenOffsets({"ts": 100}, {"ts": 102})) == rows
