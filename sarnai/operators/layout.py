"""Page geometry over run-length tables.

Ink is a table of horizontal runs (page_id, y, x0, x1; x1 excluded), the compact relational form of a bilevel page;
``vertical_runs`` turns them. Pieces of columns are rows of page_id, col, piece, y0, y1, x0, x1, ink. s is the stroke
width of a page. Rules that add, compare or rank are aggregates and windows by page; only labelling, which follows
connections, and the cuts, which walk one profile, run as a task per page, bounded by a page's own size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarnai.operators.ordered import merged_spans, otsu
from sarnai.ship import ship

# Shares of the stroke or column width.
NO_STROKE, SPINE, BIG_PIECE = 3.0, 3, 4
DOT_LOW, DOT_HIGH, DOTS, DOT_SHARE, DUST_SHARE, DUST = 0.1, 1.5, 5, 0.35, 0.08, 3.0
STRAY_GAP, STRAY_SHARE, STRAY_INK, STRAY_SIDE = 1.2, 0.15, 60, 0.5
BLOCK_GAP, LINE_HEIGHT, LINE_WIDTH, LINE_GAP, MARGIN_COLUMNS = 2.5, 0.75, 1.5, 0.5, 4
SPLIT_SHARE, VALLEY = 0.25, 0.3
FOLD_MIDDLE, FOLD_STROKES, FOLD_SHARE, FOLD_INK, FOLD_SKEW = 0.2, 8, 0.015, 0.2, 1.0
PIECES = "page_id long, piece long, y0 long, y1 long, x0 long, x1 long, ink long"


def pixels(runs: DataFrame) -> DataFrame:
    return runs.select("page_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))


def islands(rows: DataFrame, by: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Maximal stretches of consecutive numbers: by, begin, end (excluded)."""
    group = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return rows.withColumn("_g", group).groupBy(*by, "_g").agg(F.min(at).alias(begin), (F.max(at) + 1).alias(end)).drop("_g")


def vertical_runs(runs: DataFrame) -> DataFrame:
    """page_id, x, y0, y1."""
    return islands(pixels(runs), ["page_id", "x"], "y", "y0", "y1")


def stroke_width(runs: DataFrame) -> DataFrame:
    """page_id and the median length of horizontal runs. A page without ink has no row; its width is ``NO_STROKE``."""
    return runs.groupBy("page_id").agg(F.percentile(F.col("x1") - F.col("x0"), 0.5).alias("s"))


def projection(runs: DataFrame) -> DataFrame:
    """page_id, x0, x1, n: the ink below each x, as stretches of equal counts; a sweep over the runs' ends alone."""
    ends = runs.select("page_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("page_id", "e.x").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("page_id").orderBy("x")
    swept = steps.select("page_id", F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), F.sum("d").over(w).alias("n"))
    return swept.where("n > 0")


def spine_profile(vertical: DataFrame, s: DataFrame) -> DataFrame:
    """page_id, x and the ink in vertical runs of at least three strokes."""
    long = vertical.join(s, "page_id").where(F.col("y1") - F.col("y0") >= SPINE * F.col("s"))
    return long.groupBy("page_id", "x").agg(F.sum(F.col("y1") - F.col("y0")).alias("spine"))


def has_spine(runs: DataFrame, points: DataFrame, s: DataFrame) -> DataFrame:
    """points (page_id, x) with a stretch of inked rows of three strokes within a stroke of x."""
    at = points.join(s, "page_id").withColumn("_r", F.greatest(F.round("s").cast("long"), F.lit(1)))
    near = at.join(runs, "page_id").where((F.col("x0") <= F.col("x") + F.col("_r")) & (F.col("x1") > F.col("x") - F.col("_r")))
    rows = near.select("page_id", "x", "s", "y").distinct()
    return islands(rows, ["page_id", "x", "s"], "y", "y0", "y1").groupBy("page_id", "x", "s").agg(F.max(F.col("y1") - F.col("y0")).alias("most")).where(F.col("most") >= SPINE * F.col("s")).select("page_id", "x")


def separability(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Between-class share of the variance at the Otsu threshold; zero for one class."""
    cut = otsu(values, by, value).select(*by, "threshold")
    low = F.col(value) <= F.col("threshold")
    v = F.col(value).cast("double")
    sums = values.join(cut, by).groupBy(*by).agg(
        F.avg(low.cast("double")).alias("w"), F.avg(F.when(low, v)).alias("a"), F.avg(F.when(~low, v)).alias("b"), F.var_pop(v).alias("var")
    )
    share = F.col("w") * (1 - F.col("w")) * (F.col("b") - F.col("a")) ** 2 / F.nullif(F.col("var"), F.lit(0.0))
    return sums.select(*by, F.coalesce(share, F.lit(0.0)).alias("separability"))


def stretch(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The rows with ``stretched``: 0 to 255 between the 0.5th and 99.5th percentile; flat: 255."""
    ends = values.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.005), F.lit(0.995))).alias("_p"))
    low, high = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    scaled = F.least(F.greatest((F.col(value) - low) * 255 / (high - low), F.lit(0.0)), F.lit(255.0)).cast("int")
    return values.join(ends, by).withColumn("stretched", F.when(high - low < 1, 255).otherwise(scaled)).drop("_p")


def text_is_light(dark_run: Column, light_run: Column, light: Column, total: Column) -> Column:
    """The class of shorter runs is the text; if they are about equal, the rarer one."""
    share = F.try_divide(dark_run, light_run)
    apart = (dark_run > 0) & (light_run > 0) & ~((share > 0.8) & (share < 1.25))
    return F.when(apart, light_run < dark_run).otherwise(light < 0.5 * total)


def label_runs(runs: DataFrame) -> DataFrame:
    """The runs with ``piece``: 8-connected components, numbered by page in reading order of their first run.

    Runs are joined from row to row only; those of one row may meet or overlap, and do not join each other."""
    ship(runs.sparkSession)

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x0", "x1"], ignore_index=True)
        y, x0, x1 = (rows[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
        tree = np.arange(len(rows))

        def root(i: int) -> int:
            while tree[i] != i:
                tree[i] = tree[tree[i]]
                i = tree[i]
            return i

        values, begin = np.unique(y, return_index=True)
        span = {int(v): (int(b), int(e)) for v, b, e in zip(values, begin, [*begin[1:], len(y)], strict=True)}
        for v in span:
            if v - 1 not in span:
                continue
            # both rows' runs by x0: each joins the live ones of the other row, and of these, now one piece, the longest stays
            live: tuple[list[int], list[int]] = ([], [])
            for _, side, i in sorted((x0[i], side, i) for side in (0, 1) for i in range(*span[v - side])):
                near = [j for j in live[1 - side] if x1[j] >= x0[i]]  # runs touch if they overlap when widened by one
                for j in near:
                    p, q = root(i), root(j)
                    tree[max(p, q)] = min(p, q)
                live[1 - side][:] = [max(near, key=x1.__getitem__)] if near else []
                live[side].append(i)
        rows["piece"] = np.unique([root(i) for i in range(len(rows))], return_inverse=True)[1]
        return rows[["page_id", "y", "x0", "x1", "piece"]]

    spans = runs.select(*(F.col(c).cast("long") for c in ("page_id", "y", "x0", "x1")))
    return spans.groupBy("page_id").applyInPandas(label, "page_id long, y long, x0 long, x1 long, piece long")


def pieces_of(labelled: DataFrame, *more: str) -> DataFrame:
    """The box and ink of each piece (and of each of ``more`` in it)."""
    return labelled.groupBy("page_id", *more, "piece").agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(F.col("x1") - F.col("x0")).alias("ink")
    )


def columns_of(labelled: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pieces with their column, by the x of the cuts: all to the column with most of the ink; one with a second
    column that holds a quarter of it is parted at the edges. Runs are cut at the edges and summed, not pixels."""
    w = Window.partitionBy("page_id").orderBy("x")
    inner = cuts.select("page_id", F.row_number().over(w).alias("col"), F.col("x").alias("lo"), F.lead("x").over(w).alias("hi"))
    first = cuts.groupBy("page_id").agg(F.min("x").alias("hi")).select("page_id", F.lit(0).alias("col"), F.lit(None).cast("long").alias("lo"), "hi")
    whole = labelled.select("page_id").distinct().join(cuts, "page_id", "left_anti").select("page_id", F.lit(0).alias("col"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    zones = inner.unionByName(first).unionByName(whole)
    over = (F.col("lo").isNull() | (F.col("x1") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x0") < F.col("hi")))
    parted = labelled.join(zones, "page_id").where(over).withColumns({"x0": F.greatest("x0", "lo"), "x1": F.least("x1", "hi")}).drop("lo", "hi")
    parts = pieces_of(parted, "col")
    of = Window.partitionBy("page_id", "piece")
    order = of.orderBy(F.desc("ink"), F.desc("col"))
    parts = parts.withColumn("_r", F.row_number().over(order))
    parts = parts.withColumns({"_second": F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("ink"))).over(of), F.lit(0)), "_all": F.sum("ink").over(of)})
    parted_ = (F.col("_second") > 0) & (F.col("_second") >= SPLIT_SHARE * F.col("_all"))
    split = parts.where(parted_).drop("_r", "_second", "_all")
    home = parts.where(~parted_ & (F.col("_r") == 1)).select("page_id", "piece", "col")
    kept = pieces_of(labelled.join(home, ["page_id", "piece"]), "col")
    return kept.unionByName(split)


def column_width(pieces: DataFrame, s: DataFrame) -> DataFrame:
    """page_id, s, w: the median width of columns by their big pieces."""
    big = pieces.join(s, "page_id").where(F.col("ink") > BIG_PIECE * F.col("s") * F.col("s"))
    widths = big.groupBy("page_id", "col", "s").agg((F.max("x1") - F.min("x0")).alias("w"))
    return widths.groupBy("page_id", "s").agg(F.percentile("w", 0.5).alias("w"))


def speck_area(pieces: DataFrame, s: DataFrame) -> DataFrame:
    """page_id and the area below which a piece is dust: a share of the page's usual dot if it has some."""
    stroke = F.col("s") * F.col("s")
    dot = F.col("ink").between(DOT_LOW * stroke, DOT_HIGH * stroke)
    found = pieces.join(s, "page_id").groupBy("page_id", "s").agg(F.count_if(dot).alias("n"), F.percentile(F.when(dot, F.col("ink")), 0.5).alias("dot"))
    area = F.when(F.col("n") >= DOTS, DOT_SHARE * F.col("dot")).otherwise(DUST_SHARE * stroke)
    return found.select("page_id", F.greatest(F.lit(DUST), area).alias("speck"))


def vertical_groups(pieces: DataFrame, gap: Column) -> DataFrame:
    """The pieces with ``group``: a new one where a piece begins more than gap below all before it in its column."""
    w = Window.partitionBy("page_id", "col").orderBy("y0", "y1", "piece")
    before = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return pieces.withColumn("_new", F.coalesce((F.col("y0") - before > gap).cast("int"), F.lit(0))).withColumn("group", F.sum("_new").over(w)).drop("_new")


def drop_strays(pieces: DataFrame, s: DataFrame) -> DataFrame:
    """A column keeps its main group, groups of some ink, and small pieces only beside its big ones."""
    widths = column_width(pieces, s)
    known, rest = pieces.join(widths, "page_id"), pieces.join(widths, "page_id", "left_anti")
    rows = vertical_groups(known, STRAY_GAP * F.col("w"))
    of, column = Window.partitionBy("page_id", "col", "group"), Window.partitionBy("page_id", "col")
    rows = rows.withColumn("_ink", F.sum("ink").over(of))
    rows = rows.withColumn("_most", F.max("_ink").over(column))
    rows = rows.where((F.col("_ink") >= STRAY_SHARE * F.col("_most")) | (F.col("_ink") > STRAY_INK * F.col("s") * F.col("s")))
    big = F.col("ink") > BIG_PIECE * F.col("s") * F.col("s")
    rows = rows.withColumns({"_x0": F.min(F.when(big, F.col("x0"))).over(column), "_x1": F.max(F.when(big, F.col("x1"))).over(column)})
    middle = (F.col("x0") + F.col("x1")) / 2
    beside = middle.between(F.col("_x0") - STRAY_SIDE * F.col("w"), F.col("_x1") + STRAY_SIDE * F.col("w"))
    return rows.where(big | F.col("_x0").isNull() | beside).select(*pieces.columns).unionByName(rest.select(*pieces.columns))


def gaps(pieces: DataFrame, least: Column) -> DataFrame:
    """page_id, col, y0, y1 of the empty stretches of at least that height inside a column."""
    spans = merged_spans(pieces, ["page_id", "col"], "y0", "y1", F.lit(0))
    below = F.lead("begin").over(Window.partitionBy("page_id", "col").orderBy("begin"))
    found = spans.select("page_id", "col", F.col("end").alias("y0"), below.alias("y1"))
    return found.where(F.col("y1") - F.col("y0") >= least)


def margin_bands(runs: DataFrame, widths: DataFrame) -> DataFrame:
    """page_id, y0, y1 of running heads and page numbers: low wide bands of inked rows outside the text block.

    The block is the tall bands and what is between; a stack of low bands close to it that is tall in sum belongs to
    it. widths: page_id, s, w."""
    rows = runs.groupBy("page_id", "y").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"), F.min("x0").alias("a"), F.max("x1").alias("b"))
    rows = rows.join(widths, "page_id").where(F.col("n") > F.col("s"))
    group = F.col("y") - F.row_number().over(Window.partitionBy("page_id").orderBy("y"))
    bands = rows.withColumn("_g", group).groupBy("page_id", "w", "_g").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), (F.max("b") - 1 - F.min("a")).alias("wide")).drop("_g")
    page = Window.partitionBy("page_id")
    down = page.orderBy("y0")
    tall = F.col("y1") - F.col("y0") >= LINE_HEIGHT * F.col("w")
    bands = bands.withColumns({"_top": F.min(F.when(tall, F.col("y0"))).over(page), "_bottom": F.max(F.when(tall, F.col("y1"))).over(page)}).where("_top IS NOT NULL")
    away = lambda g: F.coalesce(g >= LINE_GAP * F.col("w"), F.lit(False)).cast("int")
    bands = bands.withColumns({"_above": away(F.lead("y0").over(down) - F.col("y1")), "_below": away(F.col("y0") - F.lag("y1").over(down))})
    # bands that no wide gap parts from the block make its stack, above and below
    above, below = F.col("y1") <= F.col("_top"), F.col("y0") >= F.col("_bottom")
    bands = bands.withColumns({
        "_u": F.sum(F.when(above, F.col("_above")).otherwise(0)).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "_d": F.sum(F.when(below, F.col("_below")).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    up, under = above & (F.col("_u") == 0), below & (F.col("_d") == 0)
    span = lambda c: F.max(F.when(c, F.col("y1"))).over(page) - F.min(F.when(c, F.col("y0"))).over(page)
    bands = bands.withColumns({"_su": span(up), "_sd": span(under)})
    high = lambda c: F.coalesce(c >= LINE_HEIGHT * F.col("w"), F.lit(False))
    of_text = (up & high(F.col("_su"))) | (under & high(F.col("_sd")))
    low = (F.col("y1") - F.col("y0") < LINE_HEIGHT * F.col("w")) & (F.col("wide") >= LINE_WIDTH * F.col("w"))
    return bands.where((above | below) & ~of_text & low).select("page_id", "y0", "y1")


def drop_margins(pieces: DataFrame, runs: DataFrame, s: DataFrame) -> DataFrame:
    """Pages of four columns or more lose the pieces whose middle is in a margin band."""
    enough = pieces.groupBy("page_id").agg(F.countDistinct("col").alias("n")).where(F.col("n") >= MARGIN_COLUMNS).select("page_id")
    bands = margin_bands(runs, column_width(pieces, s)).join(enough, "page_id", "left_semi").select("page_id", F.col("y0").alias("_b0"), F.col("y1").alias("_b1"))
    middle = F.floor((F.col("y0") + F.col("y1")) / 2)
    return pieces.join(bands, (pieces["page_id"] == bands["page_id"]) & (middle >= F.col("_b0")) & (middle < F.col("_b1")), "left_anti")


def unrotate_box(x0: Column, y0: Column, x1: Column, y1: Column, degrees: Column, rotated: tuple[Column, Column], shape: tuple[Column, Column], dx: Column) -> Column:
    """The box, moved by dx, around a box's corners turned back about the middles of the pages (height, width each)."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    across, down = [x - rotated[1] / 2 for x in (x0, x1)], [y - rotated[0] / 2 for y in (y0, y1)]
    turned = lambda a, b, c, d: [a * u + b * v + c / 2 + d for u in across for v in down]
    xs, ys = turned(cos, -sin, shape[1], dx), turned(sin, cos, shape[0], F.lit(0))
    still = degrees == 0
    return F.struct(
        F.when(still, x0 + dx).otherwise(F.least(*xs)).alias("x0"), F.when(still, y0).otherwise(F.least(*ys)).alias("y0"),
        F.when(still, x1 + dx).otherwise(F.greatest(*xs)).alias("x1"), F.when(still, y1).otherwise(F.greatest(*ys)).alias("y1"),
    )


def _prominence(p: np.ndarray, at: int) -> float:
    """How far one must go down from a peak before reaching higher ground."""
    higher = np.flatnonzero(p > p[at])
    left, right = higher[higher < at], higher[higher > at]
    low = (p[left[-1] + 1 if len(left) else 0 : at + 1].min(), p[at : right[0] if len(right) else len(p)].min())
    return float(p[at] - max(low))


def _peaks(p: np.ndarray, least: float, apart: float) -> list[int]:
    """Middles of flat tops over ``least``; of two closer than ``apart`` the higher stays."""
    edges = np.flatnonzero(np.diff(p)) + 1
    flats = [f for f in zip([0, *edges], [*edges, len(p)], strict=True) if f[0] > 0 and f[1] < len(p)]
    tops = [(a + b - 1) // 2 for a, b in flats if p[a - 1] < p[a] > p[b] and p[a] >= least]
    kept: list[int] = []
    for x in sorted(tops, key=lambda x: (-p[x], -x)):
        if all(abs(x - k) >= apart for k in kept):
            kept.append(x)
    return sorted(kept)


def find_cuts(runs: DataFrame, s: DataFrame) -> DataFrame:
    """page_id, x of the borders between columns: valleys of the smoothed projection between peaks that are tall, or
    stand apart and have a spine; where the valley is shallow, the emptiest place of a wide stretch without spines."""
    ship(runs.sparkSession)

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        s_, page = float(rows["s"].iloc[0]), rows["page_id"].iloc[0]
        y, x0, x1 = (rows[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
        ink = np.zeros((int(y.max() - y.min()) + 3, int(x1.max()) + 1), bool)  # a blank row at either end
        for a, b, c in zip(y - y.min() + 1, x0, x1, strict=True):
            ink[a, b:c] = True
        size = max(3, round(s_))
        before = size // 2
        wide = np.pad(ink.sum(0).astype(float), (before, size - 1 - before), mode="symmetric")
        p = np.convolve(wide, np.ones(size) / size, "valid").round(9)
        high = np.percentile(p[p > 0], 95)

        def tallest(strip: np.ndarray) -> int:
            ends = np.flatnonzero(np.diff(strip.astype(np.int8)))
            return int((ends[1::2] - ends[::2]).max(initial=0))

        chosen = []
        for x in _peaks(p, 0.05 * high, max(2, int(3 * s_))):
            rise, r = _prominence(p, x), max(1, round(s_))
            if rise < 0.02 * high:
                continue
            tall = rise >= 0.3 * high and p[x] >= 0.25 * high
            if tall or (rise >= 0.5 * p[x] and tallest(ink[:, max(0, x - r) : x + r + 1].any(1)) >= SPINE * s_):
                chosen.append(x)
        found = []
        for a, b in zip(chosen, chosen[1:], strict=False):
            low = a + int(p[a:b].argmin())
            if p[low] > VALLEY * min(p[a], p[b]):
                bare = [tallest(ink[:, x]) < SPINE * s_ for x in range(a, b)]
                ends = np.flatnonzero(np.diff(np.array([0, *bare, 0], np.int8)))
                spans = [(int(d - c), -int(c), int(d)) for c, d in zip(ends[::2], ends[1::2], strict=True) if d - c >= SPINE * s_]
                if not spans:
                    continue
                _, c, d = max(spans)
                low = a - c + int(p[a - c : a + d].argmin())
            found.append(low)
        return pd.DataFrame({"page_id": np.full(len(found), page, np.int64), "x": np.array(found, np.int64)})

    spans = runs.join(s, "page_id").select(*(F.col(c).cast("long") for c in ("page_id", "y", "x0", "x1")), F.col("s").cast("double"))
    return spans.groupBy("page_id").applyInPandas(cut, "page_id long, x long")


def estimate_skew(runs: DataFrame, most: float = 5.0, step: float = 0.5) -> DataFrame:
    """page_id and the shear angle in degrees at which the columns' projection is sharpest, coarse then fine.

    A run is taken to where its row is moved by tan(angle); twenty-one angles, then eleven, each one aggregate."""

    def sharpest(rows: DataFrame, angles: Column) -> DataFrame:
        moved = rows.select("page_id", "y", "x0", "x1", F.explode(angles).alias("angle"))
        shift = F.round(F.col("y") * F.tan(F.radians("angle"))).cast("long")
        ends = moved.select("page_id", "angle", F.explode(F.array(F.struct((F.col("x0") + shift).alias("x"), F.lit(1).alias("d")), F.struct((F.col("x1") + shift).alias("x"), F.lit(-1).alias("d")))).alias("e"))
        steps = ends.groupBy("page_id", "angle", "e.x").agg(F.sum("e.d").alias("d"))
        sharp = steps.groupBy("page_id", "angle").agg(F.sum(F.col("d") * F.col("d")).alias("sharp"))
        return sharp.groupBy("page_id").agg(F.max_by("angle", F.struct("sharp", -F.abs("angle"), "angle")).alias("best"))

    n = int(round(most / step))
    coarse = sharpest(runs, F.array(*(F.lit(k * step) for k in range(-n, n + 1))))
    around = F.array(*(F.col("best") + F.lit(round(k * step / 5, 6)) for k in range(-5, 6)))
    return sharpest(runs.join(coarse, "page_id"), around).select("page_id", F.round("best", 3).alias("angle"))


def folds(runs: DataFrame, s: DataFrame, widths: DataFrame) -> DataFrame:
    """page_id, x of the fold of two facing pages that lie at different angles. widths: page_id, width.

    The fold is the widest stretch without ink (a stroke's worth below an x is none) in the middle of the page, with a share of the ink on
    either side; it counts if the angles of the sides differ."""
    inked = projection(runs).join(s, "page_id").where(F.col("n") > F.col("s")).select("page_id", "x0", "x1")
    edges = F.array(F.lit(0).cast("long"), F.col("width").cast("long"))
    ends = widths.select("page_id", F.explode(edges).alias("x0")).withColumn("x1", F.col("x0"))
    spans = merged_spans(inked.select("page_id", F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1")).union(ends), ["page_id"], "x0", "x1", F.lit(0))
    after = F.lead("begin").over(Window.partitionBy("page_id").orderBy("begin"))
    bare = spans.select("page_id", F.col("end").alias("a"), after.alias("b")).where("b > a").join(widths, "page_id").join(s, "page_id")
    middle, wide = (F.col("a") + F.col("b")) / 2, F.col("b") - F.col("a")
    able = (F.abs(middle - F.col("width") / 2) <= FOLD_MIDDLE * F.col("width")) & (wide >= F.greatest(FOLD_STROKES * F.col("s"), FOLD_SHARE * F.col("width")))
    best = bare.where(able).groupBy("page_id").agg(F.min_by(F.floor(middle), F.struct(-wide, "a")).alias("x"))

    # runs cut at the fold, so that each side has its own ink and angle
    cut = runs.join(best, "page_id")
    part = lambda side, x0, x1: F.struct(F.lit(side).alias("side"), x0.alias("x0"), x1.alias("x1"))
    parts = F.array(part("l", F.col("x0"), F.least("x1", "x")), part("r", F.greatest("x0", "x"), F.col("x1")))
    sides = cut.select("page_id", "y", F.explode(parts).alias("p")).select("page_id", "y", "p.side", "p.x0", "p.x1").where("x0 < x1")
    ink = sides.groupBy("page_id").agg(*(F.sum(F.when(F.col("side") == k, F.col("x1") - F.col("x0"))).alias(k) for k in "lr"))
    enough = ink.where(F.least(F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))) >= FOLD_INK * (F.coalesce("l", F.lit(0)) + F.coalesce("r", F.lit(0)))).select("page_id")
    of_side = sides.join(enough, "page_id", "left_semi").withColumn("page_id", F.concat_ws("/", "side", "page_id"))
    angles = estimate_skew(of_side).groupBy(F.substring("page_id", 3, 32).cast("long").alias("page_id")).agg((F.max("angle") - F.min("angle")).alias("apart"))
    return best.join(angles.where(F.col("apart") >= FOLD_SKEW), "page_id", "left_semi")


def disk(r: Column) -> Column:
    """Rows of flags of a disk of that radius, as array<array<boolean>>."""
    at = F.sequence(-r, r)
    return F.transform(at, lambda y: F.transform(at, lambda x: x * x + y * y <= r * r))
