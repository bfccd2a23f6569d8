"""Conversion of requests, and the sinks."""

import csv
import glob
import json

import pytest

from sarnai.operators import convert, letters
from sarnai.sources import readers, writers

REQUESTS = [
    (1, "xalimaq", "todo"), (2, "ᡍᠠᠯᡅᡏᠠᡎ", "translit"), (3, "ᡍᠠ", "todo"), (4, "Хальмг көвүн-күүкн!", "translit"), (5, "хальмг", "todo"), (6, "xalimaq", "fix"), (7, " ", "todo"),
    (8, None, "todo"), (9, "12", "todo"), (10, "xalimaq", "x"), (11, "кюн", "fix"), (12, "ᡍᠠ", "image"), (13, "һазр-ән", "translit"), (14, "a" * 10_001, "todo"),
]


@pytest.fixture(scope="module")
def got(spark):
    requests = spark.createDataFrame(REQUESTS, "id long, text string, target string")
    dictionary = spark.createDataFrame([("хальмг", "xalimaq"), ("көвүн", "köböün"), ("күүкн", "")], "word string, translit string")
    known = letters.Lexicon(spark.createDataFrame([("күн", 90), ("хальмг", 9)], "word string, n long"), spark.createDataFrame([], "word string"), spark.createDataFrame([], "word string"))
    return {r.id: r for r in convert.convert(requests, "id", dictionary, known).collect()}


def test_scripts_and_targets(got):
    assert (got[1].script, got[1].translit, got[1].todo) == ("translit", "xalimaq", "ᡍᠠᠯᡅᡏᠠᡎ")
    assert (got[2].script, got[2].translit, got[2].todo) == ("todo", "xalimaq", None)
    assert got[4].translit == "xalimaq köböün күүкн!"
    assert (got[5].translit, got[5].todo) == ("xalimaq", "ᡍᠠᠯᡅᡏᠠᡎ")
    assert (got[11].fixed, got[11].translit, [tuple(f) for f in got[11].fixes]) == ("күн", None, [("кюн", "күн")])
    assert (got[12].todo, got[12].translit) == ("ᡍᠠ", None)
    assert got[13].translit == "һазр-ән"


def test_errors(got):
    errors = {i: r.error for i, r in got.items() if r.error}
    assert errors == {3: "already_todo", 6: "not_cyrillic", 7: "empty", 8: "empty", 9: "unknown_script", 10: "unknown_target", 14: "too_long"}
    assert all(got[i].todo is None and got[i].translit is None for i in errors)
    assert len(got) == len(REQUESTS)


def test_provenance_counts(spark):
    texts = spark.createDataFrame([(1, "хальмг көвүн-хальмг шин"), (2, ""), (3, None)], "id long, t string")
    dictionary = spark.createDataFrame([("хальмг", "xalimaq"), ("көвүн", "köböün")], "word string, translit string")
    rows = {r.id: r for r in convert.transliterate(texts, "id", "t", dictionary).collect()}
    assert (rows[1].translit, rows[1].n_dict, rows[1].n_split, rows[1].n_model) == ("xalimaq köböün xalimaq шин", 1, 1, 1)
    assert (rows[2].translit, rows[3].n_dict) == ("", 0)


def test_event_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "up", None), (2, "down", 'a "b"\n')], "request_id long, rating string, correction string")
    writers.append_events(rows, "feedback", str(tmp_path / "log"))
    writers.append_events(rows.limit(1), "feedback", str(tmp_path / "log"))
    back = readers.read_event_log(spark, str(tmp_path / "log")).collect()
    assert sorted((r.route, r.request_id, r.correction) for r in back if r.correction) == [("feedback", 2, 'a "b"\n')] and len(back) == 3
    assert list(json.loads(back[0].value))[0] == "event"


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'x, "{i}"\ny' if i % 2 else None) for i in range(50)], "feedback_id long, correction string").repartition(3)
    writers.write_export(rows, str(tmp_path / "out"))
    whole = ""
    for f in sorted(glob.glob(str(tmp_path / "out" / "part-*"))):
        with open(f, encoding="utf-8", newline="") as h:
            whole += h.read()
    assert whole.startswith("\ufefffeedback_id,correction\r\n") and whole.count("\ufeff") == 1
    read = list(csv.reader(whole.removeprefix("\ufeff").splitlines(keepends=True)))[1:]
    assert read == [[str(i), f'x, "{i}"\ny' if i % 2 else ""] for i in range(50)]
    writers.write_export(rows.limit(0), str(tmp_path / "none"))
    assert "".join(open(f, encoding="utf-8").read() for f in glob.glob(str(tmp_path / "none" / "part-*"))) == "﻿feedback_id\n"
