"""Joining broken words, one case for each rule; the model of symbols against the relational one; facing pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarnai.functions import text as T
from sarnai.operators import layout, lexicon, seams

N = seams.NARROW


def todo(spark, *words):
    row = spark.createDataFrame([(" ".join(words),)], "t string").select(T.translit_to_todo(F.col("t"))).first()
    return row[0].split(" ")


@pytest.fixture(scope="module")
def letters(spark):
    names = ["örgöǰi", "kü", "erdeni", "dü", "morid", "bi", "d", "uu"]
    return dict(zip(names, todo(spark, *names), strict=True))


def test_stretches_are_transliterated_as_lines_are(spark):
    words = "örgöǰi kü erdeni dü morid xān ukhān köüked bayixu teǰigēl šine čidal".split()
    made = todo(spark, *words)
    rows = spark.createDataFrame([(w,) for w in made], "w string").select("w", T.todo_to_translit(F.col("w")).alias("t")).collect()
    assert {r.w: r.t for r in rows} == {w: seams.transliterated(w) for w in made}


def test_known_words_are_joined_and_others_stay(letters):
    t = seams.transliterated
    a, b, c, d = (letters[k] for k in ("örgöǰi", "kü", "erdeni", "dü"))
    s = seams.Seams({t(a): 173, t(b): 2, t(a + b): 2, t(c): 183, t(d): 9057})
    assert s.joined(f"{a} {b} {c} {d}") == f"{a}{b} {c} {d}"
    assert s.joined(f"{a}  {b}") == a + b and s.joined("") == "" and s.joined(f" {a}") == f" {a}"
    assert s.joined(f"{a}︒ {b}") == f"{a}︒ {b}"  # a mark parts them


def test_the_long_mark_never_begins_a_word(letters):
    a = letters["erdeni"]
    assert seams.Seams({}).joined(f"{a} {seams.LONG}{a}") == f"{a}{seams.LONG}{a}"


def test_a_piece_may_belong_to_the_right(letters):
    t = seams.transliterated
    a, b, c = letters["erdeni"], letters["bi"], letters["d"]
    s = seams.Seams({t(a): 50, t(a + b): 1, t(b + c): 9})
    assert s.joined(f"{a} {b} {c}") == f"{a} {b}{c}"
    assert seams.Seams({t(a): 50, t(a + b): 9, t(b + c): 1}).joined(f"{a} {b} {c}") == f"{a}{b} {c}"


def test_a_join_makes_the_left_side_longer(letters):
    t = seams.transliterated
    a, b, c = letters["d"], letters["uu"], letters["morid"]
    s = seams.Seams({t(a + b): 4, t(a + b + c): 4})
    assert s.joined(f"{a} {b} {c}") == a + b + c


def test_pen_lifts_need_a_narrow_gap_and_flags(letters):
    t = seams.transliterated
    a, b = letters["d"], letters["uu"]
    words = {t(letters[k]): 9 for k in ("örgöǰi", "erdeni", "morid")}
    s = seams.Seams(words)
    gain = s.logp(t(a) + t(b)) - s.logp(t(a)) - s.logp(t(b))
    line = f"{a}{N}{b}"
    flags = [False] * len(a) + [True] + [False] * len(b)
    assert s.joined(line) == line and s.joined(f"{a} {b}", flags) == f"{a} {b}"
    assert (s.joined(line, flags) == a + b) == (gain > seams.PEN_LIFT_GAIN)
    assert (s.joined(line, [False] * len(line)) == a + b) == (gain > seams.PEN_LIFT_GAIN_LOOSE)


def test_model_of_symbols_is_the_relational_one(spark):
    types = ["morid", "mori", "erdeni", "dü", "xān"]
    asked = [*types, "dümori", "q"]
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = {r.word: r.logp for r in lexicon.witten_bell(frame(types), frame(asked)).collect()}
    s = seams.Seams(dict.fromkeys(types, 1))
    base_kinds = len({c for w in types for c in w})
    assert s.grams[3] == 1 / (base_kinds + 1)
    relational = 1 / (len({c for w in types for c in w + "$"}) + 1)
    s.__dict__["grams"] = (*s.grams[:3], relational)
    assert got == {w: pytest.approx(s.logp(w)) for w in asked}


def test_lines_as_a_table(spark, letters):
    t = seams.transliterated
    a, b = letters["örgöǰi"], letters["kü"]
    freq = spark.createDataFrame([(t(a), 5), (t(a + b), 5)], "word string, n long")
    lines = spark.createDataFrame([(1, f"{a} {b}", [False] * 9), (2, None, None), (3, "", [])], "id long, line string, flags array<boolean>")
    s = seams.seams_of(freq)
    assert {r.id: r.o for r in seams.join_broken_words(lines, "line", s, "o").collect()} == {1: a + b, 2: None, 3: ""}
    assert {r.id: r.o for r in seams.join_broken_words(lines, "line", s, "o", "flags").collect()} == {1: a + b, 2: None, 3: ""}


def test_folds_of_facing_pages(spark):
    def half(first, slope):
        return [(y, first + 30 * k + round(y * slope), first + 30 * k + round(y * slope) + 4) for k in range(5) for y in range(200)]

    tilt = np.tan(np.radians(2.0))
    rows = [(1, *r) for r in [*half(20, 0), *half(260, -tilt)]] + [(2, *r) for r in [*half(20, 0), *half(260, 0)]] + [(3, *r) for r in half(20, 0)]
    runs = spark.createDataFrame(rows, "page_id long, y long, x0 long, x1 long")
    s = spark.createDataFrame([(p, 4.0) for p in (1, 2, 3)], "page_id long, s double")
    widths = spark.createDataFrame([(p, 430) for p in (1, 2, 3)], "page_id long, width long")
    (found,) = layout.folds(runs, s, widths).collect()
    assert found.page_id == 1 and 144 <= found.x <= 260
