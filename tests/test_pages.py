"""Layout over run tables against plain numpy, reading rules on hand-made columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarnai.operators import layout, reading


def runs_of(pages):
    rows = []
    for page, ink in pages.items():
        for y, line in enumerate(ink):
            ends = np.flatnonzero(np.diff(np.array([0, *line, 0])))
            rows += [(page, y, int(a), int(b)) for a, b in zip(ends[::2], ends[1::2], strict=True)]
    return rows


RUNS = "page_id long, y long, x0 long, x1 long"


def page_of_columns(lengths, gap=30, width=12, height=200):
    ink = np.zeros((height, gap * (len(lengths) + 1)), int)
    for k, n in enumerate(lengths):
        x = gap * (k + 1)
        ink[5 : 5 + n, x - 1 : x + 2] = 1
        for y in range(5, 5 + n, 9):
            ink[y : y + 3, x - width // 2 : x] = 1
    return ink


@pytest.fixture(scope="module")
def random_pages():
    rng = np.random.default_rng(1)
    return {1: (rng.random((30, 40)) < 0.35).astype(int), 2: (rng.random((25, 25)) < 0.5).astype(int), 3: np.ones((1, 1), int)}


def flood(ink):
    left, count = {tuple(p) for p in np.argwhere(ink)}, []
    while left:
        todo, seen = [left.pop()], 1
        while todo:
            y, x = todo.pop()
            for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
                    seen += 1
        count.append(seen)
    return sorted(count)


def test_labels_equal_flood_fill(spark, random_pages):
    pieces = layout.pieces_of(layout.label_runs(spark.createDataFrame(runs_of(random_pages), RUNS))).collect()
    for page, ink in random_pages.items():
        assert sorted(r.ink for r in pieces if r.page_id == page) == flood(ink)


def test_labels_of_runs_that_meet_in_a_row(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 0, 4, 6), (1, 1, 1, 6), (1, 1, 6, 8), (1, 2, 20, 22)]  # 4 to 6 ends with one and meets the next
    rows += [(p, int(y), int(a), int(a + n)) for p in (2, 3, 4) for y, a, n in zip(rng.integers(0, 12, 60), rng.integers(0, 40, 60), rng.integers(0, 7, 60), strict=True)]
    want = []
    for page in (1, 2, 3, 4):
        left = [r for r in rows if r[0] == page]
        while left:
            found = todo = [left.pop()]
            while todo:
                todo = [r for r in left if any(abs(r[1] - o[1]) == 1 and r[2] <= o[3] and o[2] <= r[3] for o in todo)]
                left = [r for r in left if r not in todo]
                found = found + todo
            want.append((page, len(found), sum(r[3] - r[2] for r in found)))
    runs = spark.createDataFrame(rows, RUNS)
    got = layout.label_runs(runs).groupBy("page_id", "piece").agg(F.count("*").alias("n"), F.sum(F.col("x1") - F.col("x0")).alias("ink")).collect()
    assert sorted((r.page_id, r.n, r.ink) for r in got) == sorted(want)


def test_projection_and_vertical_runs(spark, random_pages):
    runs = spark.createDataFrame(runs_of(random_pages), RUNS)
    at = {(r.page_id, x): r.n for r in layout.projection(runs).collect() for x in range(r.x0, r.x1)}
    vertical = layout.vertical_runs(runs).collect()
    for page, ink in random_pages.items():
        assert {x: n for (p, x), n in at.items() if p == page} == {x: int(n) for x, n in enumerate(ink.sum(0)) if n}
        assert sorted((r.x, r.y0, r.y1) for r in vertical if r.page_id == page) == sorted((x, a, b) for _, x, a, b in runs_of({0: ink.T}))


def test_cuts_part_columns(spark):
    runs = spark.createDataFrame(runs_of({1: page_of_columns([150, 160, 40, 155]), 2: page_of_columns([100])}), RUNS)
    s = layout.stroke_width(runs)
    cuts = layout.find_cuts(runs, s)
    xs = sorted(r.x for r in cuts.collect())
    assert len(xs) == 3 and all(30 * (k + 1) < x < 30 * (k + 2) for k, x in enumerate(xs))
    pieces = layout.columns_of(layout.label_runs(runs), cuts)
    assert {(r.page_id, r.col) for r in pieces.collect()} == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    assert pieces.agg(F.sum("ink")).first()[0] == runs.agg(F.sum(F.col("x1") - F.col("x0"))).first()[0]


def test_touching_columns_are_parted(spark):
    ink = np.zeros((20, 20), int)
    ink[2:18, 3:6] = ink[2:18, 13:16] = 1
    ink[10, 3:16] = 1
    runs = spark.createDataFrame(runs_of({1: ink}), RUNS)
    parts = layout.columns_of(layout.label_runs(runs), spark.createDataFrame([(1, 10)], "page_id long, x long")).collect()
    assert sorted((r.col, r.x0, r.x1, r.ink) for r in parts) == [(0, 3, 10, 52), (1, 10, 16, 51)]


def test_strays_gaps_and_groups(spark):
    rows = [(1, 0, 0, 0, 100, 0, 20, 900), (1, 0, 1, 200, 205, 0, 5, 9), (1, 0, 2, 104, 108, 90, 92, 4), (1, 0, 3, 140, 240, 0, 20, 900)]
    pieces = spark.createDataFrame(rows, "page_id long, col int, piece long, y0 long, y1 long, x0 long, x1 long, ink long")
    s = spark.createDataFrame([(1, 3.0)], "page_id long, s double")
    assert {r.piece for r in layout.drop_strays(pieces, s).collect()} == {0, 1, 3}
    groups = {r.piece: r.group for r in layout.vertical_groups(pieces, F.lit(24)).collect()}
    assert groups == {0: 0, 2: 0, 3: 1, 1: 1}
    assert [(r.y0, r.y1) for r in layout.gaps(pieces, F.lit(10)).collect()] == [(108, 140)]


def test_margin_band(spark):
    ink = page_of_columns([150] * 5, height=220)
    ink[200:204, 40:120] = 1
    runs = spark.createDataFrame(runs_of({1: ink}), RUNS)
    widths = spark.createDataFrame([(1, 3.0, 12.0)], "page_id long, s double, w double")
    assert [(r.y0, r.y1) for r in layout.margin_bands(runs, widths).collect()] == [(200, 204)]


def test_skew(spark):
    def sheared(slope):
        runs = []
        for k in range(6):
            runs += [(y, 60 + 40 * k + round(y * slope), 64 + 40 * k + round(y * slope)) for y in range(300)]
        return runs

    rows = [(p, *r) for p, angle in ((1, 2.0), (2, 0.0)) for r in sheared(-np.tan(np.radians(angle)))]
    got = {r.page_id: r.angle for r in layout.estimate_skew(spark.createDataFrame(rows, RUNS)).collect()}
    assert got[1] == pytest.approx(2.0, abs=0.11) and got[2] == pytest.approx(0.0, abs=0.11)


def test_separability_and_stretch(spark):
    values = spark.createDataFrame([(1, v) for v in [10] * 50 + [200] * 50] + [(2, 7)] * 5, "p long, v int")
    got = {r.p: r.separability for r in layout.separability(values, ["p"], "v").collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0}
    assert {(r.p, r.v, r.stretched) for r in layout.stretch(values, ["p"], "v").collect()} == {(1, 10, 0), (1, 200, 255), (2, 7, 255)}


def test_empty_page_tables(spark):
    none = spark.createDataFrame([], RUNS)
    s = layout.stroke_width(none)
    pieces = layout.columns_of(layout.label_runs(none), layout.find_cuts(none, s))
    assert layout.drop_strays(pieces, s).count() == 0


def columns(spark, rows):
    return spark.createDataFrame(rows, "page_id long, col int, text string, probs array<double>, x0 long, y0 long, x1 long, y1 long")


def test_marked_columns(spark):
    good, word = [0.99] * 8, "ᠠᡋᠠᡋᠠᡋᠠᡋ"
    rows = [(1, k, word, good, 30 * k, 0, 30 * k + 10, 100) for k in range(3)]
    rows += [(1, 3, "ᠠᡋ", [0.99, 0.99], 100, 120, 110, 130), (1, 4, word, [0.5] * 8, 130, 0, 140, 100), (1, 5, "ᠠ", [0.99], 160, 0, 170, 100)]
    got = {r.col: (r.junk, r.margin, r.unreadable) for r in reading.mark_columns(columns(spark, rows)).collect()}
    assert got == {0: (False,) * 3, 1: (False,) * 3, 2: (False,) * 3, 3: (False, True, False), 4: (True, False, True), 5: (True, False, False)}


@pytest.mark.parametrize(
    ("text", "probs", "want"),
    [
        ("ᠠᡋ ᠠᠠ ᡋᡋ︕", [0.5, 0.5, 1, 1, 1, 1, 1, 1, 0.3], "ᠠᠠ ᡋᡋ"), ("ᠠ ︕", [1.0, 1, 0.3], "ᠠ"), ("ᠠ", [0.1], ""), ("", [], ""),
        ("ᠠ ︕", [1.0, 1, 0.95], "ᠠ ︕"), ("︕ ᠠ", [0.95, 1, 1], "ᠠ"),
    ],
)
def test_trim_unsure(spark, text, probs, want):
    row = spark.createDataFrame([(text, [float(p) for p in probs])], "t string, p array<double>")
    assert row.select(reading.words_text(reading.trim_unsure(F.col("t"), F.col("p")))).first()[0] == want


def test_tidy_and_tight(spark):
    row = spark.createDataFrame([("ᠠᡋ ᡋ  ᠠ︕",)], "t string").select(reading.tidy(F.col("t")).alias("t")).first()
    assert row.t == "ᠠᡋ ᠠ︕"
    flags = spark.createDataFrame([("ᠠ ᡋ", [0, 1, 2], [False] * 12), ("ᠠ ᡋ", [0, 1, 2], [False] * 5 + [True] + [False] * 6)], "t string, f array<int>, b array<boolean>")
    assert [r[0] for r in flags.select(reading.tight_gaps(F.col("t"), F.col("f"), F.col("b"))).collect()] == [[False, True, False], [False] * 3]


def test_turns(spark):
    rows = [(1, 0, 0.9, 100), (1, 180, 0.96, 400), (2, 0, 0.95, 100), (2, 90, 0.8, 900), (3, 0, 0.92, 50), (3, 180, 0.98, 50), (4, 180, 0.9, 3)]
    turns = spark.createDataFrame(rows, "page_id long, turn int, confidence double, letters int")
    assert {(r.page_id, r.turn) for r in reading.best_turn(turns).collect()} == {(1, 180), (2, 0), (3, 180)}
    best = reading.best_reading(turns.withColumnRenamed("turn", "candidate")).collect()
    assert {(r.page_id, r.candidate) for r in best} == {(1, 180), (2, 0), (3, 180), (4, 180)}
    flip = columns(spark, [(1, 0, "ᠠ", [0.5], 0, 0, 1, 9)]).select("*", F.array(F.lit(0.9)).alias("down"), F.col("probs").alias("up"))
    assert reading.flip_gain(flip).first().gain == pytest.approx(0.4)
