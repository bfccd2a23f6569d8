"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most 3 bits, then
there is a segment from which every chain of l segments holds at most l * 3 / SEGMENTS differences: for eight
segments the first two hold none, the first five at most one, the first seven at most two. So a pair shares,
for some start, the two segments there and two of the following three. That is the blocking key: start, which
of the three is left out, and 32 bits. Within a key, the budgets of all chains from the start are checked
before the full Hamming distance.

Equal fingerprints are one node from the start. A key's group is compared in one task if it has at most
``MOST_GROUP`` nodes, and gives back links that connect it, not all pairs. Larger groups go on to
another round in which a key has one more segment: the remaining four hold at most three differences, so one
of them is equal. What shares that key too differs in ``3 * BITS`` = 24 bits only, so it has at most 2 ** 24 nodes, and the
neighbours of all of them are looked up in a table over these bits, one after the other for each of the 2,324 ways to differ in one to three.

Components come from alternating large and small stars over the links, each round written to the shared
folder and the one before removed. Nothing about all documents reaches the driver but counts.

A row without an id has a fingerprint and links like any other; its component is the smallest id reachable, null if no row with an
id is. Null and empty texts have fingerprint zero. Repeated rows are rows of their own here; the dedup keeps exactly one row of each
component, one of its smallest id (without any id, of its smallest fingerprint), so two components that hold the same id keep a row each.
Empty tables give empty ones; extra columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sarnai.llm.common import as_bytes, discard, map_columns, materialize, to_arrow, unused

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 8
BITS = 64 // SEGMENTS
BUDGET = [(n * DISTANCE) // SEGMENTS for n in range(1, SEGMENTS + 1)]  # of a chain of n segments
MOST_GROUP = 4096
CHUNK = 200_000


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) < size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit i is one if it is in over half the hashes. A-Z are lowered, other letters are not."""
    all_shingles = shingles(text, size)
    total = np.zeros(64, np.int64)
    for i in range(0, len(all_shingles), CHUNK):
        part = all_shingles[i : i + CHUNK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    ones = 2 * total > len(all_shingles)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def make():
        def step(ids, texts):
            made = np.array([fingerprint(t, size) for t in as_bytes(texts)], np.uint64)
            return {"doc_id": ids, "fp": made.view(np.int64)}

        return step

    return map_columns(documents, ["doc_id", "text"], make, "doc_id long, fp long")


def _segment(fp, i: int):
    """Segment i of a signed 64-bit column, as a small number."""
    return F.shiftrightunsigned(fp, (i % SEGMENTS) * BITS).bitwiseAND((1 << BITS) - 1)


def _keys(nodes: DataFrame) -> DataFrame:
    """fp and key (60 bits at most: start and choice over the segments) of each start and choice of two of three segments."""
    fp, out = F.col("fp"), []
    for start in range(SEGMENTS):
        s = [_segment(fp, start + k) for k in range(5)]
        base = s[0] + s[1] * (1 << BITS)
        for left_out, (a, b) in enumerate(((3, 4), (2, 4), (2, 3))):
            bits = base + s[a] * (1 << 2 * BITS) + s[b] * (1 << 3 * BITS)
            out.append(bits + F.lit((start * 3 + left_out) << 4 * BITS))
    return nodes.select("fp", F.explode(F.array(*out)).alias("key"))


def _near(differ: np.ndarray, start: int) -> np.ndarray:
    """Positions in a flat array of XORs whose chains all keep within budget and that differ in DISTANCE bits
    at most. The two segments at the start are equal by the key."""
    alive, total = np.arange(differ.size), np.zeros(differ.size, np.uint8)
    for n in range(2, SEGMENTS):
        part = (differ >> np.uint64((start + n) % SEGMENTS * BITS)) & np.uint64((1 << BITS) - 1)
        total = total + np.bitwise_count(part)
        ok = total <= BUDGET[n]
        alive, total, differ = alive[ok], total[ok], differ[ok]
    return alive[np.bitwise_count(differ) <= DISTANCE]


def forest(fp: np.ndarray, start: int, step: int = 256) -> list[tuple[int, int]]:
    """Links that connect the fingerprints within DISTANCE (pairs of positions), blocks of rows against all later ones."""
    tree, links = np.arange(len(fp)), []
    for begin in range(0, len(fp), step):
        wide = len(fp) - begin
        at = _near((fp[begin : begin + step, None] ^ fp[None, begin:]).ravel(), start)
        rows, columns = at // wide, at % wide
        rows, columns = rows[columns > rows] + begin, columns[columns > rows] + begin
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for i, js in zip(rows[np.concatenate([[0], cuts])] if len(rows) else (), np.split(columns, cuts), strict=False):
            for other, j in zip(*np.unique(tree[js], return_index=True), strict=True):
                if other != tree[i]:
                    links.append((int(i), int(js[j])))
                    tree[tree == other] = tree[i]
    return links


def cube_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As forest, of distinct fingerprints that differ in 3 * BITS bits only: neighbours by lookup, linear in their number."""
    differ = np.bitwise_or.reduce(fp ^ fp[0])
    free = [b for b in range(64) if int(differ) >> b & 1]
    if len(free) > 3 * BITS:
        raise ValueError("more than three segments differ")
    place = np.zeros(len(fp), np.int32)
    for k, b in enumerate(free):
        place |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int32) << k
    table = np.full(1 << len(free), -1, np.int32)
    table[place] = np.arange(len(fp), dtype=np.int32)
    tree, left, right = np.arange(len(fp), dtype=np.int32), [], []
    for n in range(1, DISTANCE + 1):
        for bits in combinations(range(len(free)), n):
            other = table[place ^ sum(1 << b for b in bits)]
            i = np.flatnonzero((other > np.arange(len(fp))))
            i = i[tree[i] != tree[other[i]]]
            if not len(i):
                continue
            j = other[i]
            low, high = np.minimum(tree[i], tree[j]), np.maximum(tree[i], tree[j])
            _, first = np.unique(low.astype(np.int64) << 32 | high, return_index=True)  # one link for each two trees that meet
            left.append(i[first])
            right.append(j[first])
            a, b = low[first], high[first]
            while len(a):  # the least of trees that meet, directly or through others
                np.minimum.at(tree, b, a)
                while not np.array_equal(up := tree[tree], tree):
                    tree = up
                a, b = np.minimum(tree[a], tree[b]), np.maximum(tree[a], tree[b])
                a, b = a[a != b], b[a != b]
    whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return whole(left), whole(right)


def _links(keyed: DataFrame, most: int, last: bool) -> DataFrame:
    """Groups in key order, one after the other: links (a, b) between fingerprints, and of groups over ``most`` the rows (fp as a,
    null b, key). In the last round none goes on."""
    ddl = "a long, b long, key long"
    arrow = to_arrow(keyed.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, key, over = 0, None, False
        links: list[np.ndarray] = []

        def rows_on(fp: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(np.full(len(fp), key))], schema=arrow)

        def links_out() -> pa.RecordBatch:
            x = np.concatenate(links)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.nulls(len(x), pa.int64())], schema=arrow)

        def close() -> Iterator[pa.RecordBatch]:
            if not over and size > 1:
                fp = np.concatenate(held)
                start = ((int(key) >> 4 * BITS) & 31) // 3
                if size > most:
                    i, j = cube_links(fp.view(np.uint64))
                else:
                    i, j = np.array(forest(fp.view(np.uint64), start), np.int64).reshape(-1, 2).T
                if len(i):
                    links.append(np.stack([fp[i], fp[j]], 1))
            if sum(map(len, links)) > 50_000:
                yield links_out()

        for b in batches:
            fps, keys = (b.column(n).to_numpy(zero_copy_only=False) for n in ("fp", "key"))
            ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
            begins = np.concatenate([[0], ends[:-1]])
            wanted = ends - begins > 1  # of the groups within a batch only those of two or more link anything
            wanted[0] = wanted[-1] = len(keys) > 0
            for begin, end in zip(begins[wanted].tolist(), ends[wanted].tolist(), strict=True):
                if keys[begin] != key:
                    yield from close()
                    held, size, key, over = [], 0, keys[begin], False
                held.append(fps[begin:end])
                size += end - begin
                if over or (size > most and not last):
                    over = True
                    yield rows_on(np.concatenate(held))
                    held = []
        yield from close()
        if links:
            yield links_out()

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, ddl)


def link_nodes(nodes: DataFrame, most: int = MOST_GROUP) -> DataFrame:
    """Links a, b between distinct fingerprints (fp) that connect all within DISTANCE; a table in the shared folder."""
    found = materialize(_links(_keys(nodes), most, last=False), "simhash-links")
    links, rest = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL")
    if not rest.isEmpty():
        # A group's key and one equal segment of the four that are not in it; key: bits 0..31 the segments,
        # 32..36 start and choice, from 40 which segment was added and its value.
        fp, choice = F.col("a"), F.shiftrightunsigned("key", 4 * BITS)
        start, out = F.floor(choice / 3).cast("int"), []
        left = choice % 3
        for k in range(4):
            away = F.when(left == 0, 2).when(left == 1, 3).otherwise(4) if k == 0 else F.lit(4 + k)
            at = ((start + away) % SEGMENTS) * BITS
            value = F.call_function("shiftrightunsigned", fp, at.cast("int")).bitwiseAND((1 << BITS) - 1)
            out.append(F.col("key") + value * (1 << 40) + F.lit(k << 48))
        keyed = rest.select(fp.alias("fp"), F.explode(F.array(*out)).alias("key"))
        links = links.unionByName(_links(keyed, most, last=True).select("a", "b"))
    edges = materialize(links.where("a <> b").distinct(), "simhash-edges")
    discard(found)
    return edges


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node in a link; links is a materialized table, used up."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        joined = both.join(least, both["u"] == least["w"])
        if large:  # neighbours above u go to the least of all
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w"), F.col("m")))
        return out.where("a <> b").distinct()

    edges = links
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(edges)
    while True:
        old, edges = edges, materialize(star(star(edges, True), False), "simhash-edges")
        discard(old)
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _named(made: DataFrame, most: int) -> DataFrame:
    """of (a fingerprint), the smallest id of its component, and a fingerprint of the row that has it (or the smallest); made: doc_id, fp."""
    nodes = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(link_nodes(nodes, most)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.when(F.col("least").isNotNull(), F.struct("least", "fp"))).alias("first")
    named = rooted.select(F.col("fp").alias("of"), "root").join(rooted.groupBy("root").agg(first), "root")
    return named.select("of", F.col("first.least").alias("component_id"), F.coalesce("first.fp", "root").alias("first_fp"))


def near_duplicates(documents: DataFrame, size: int = SHINGLE, most: int = MOST_GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    made = materialize(fingerprints(documents, size), "simhash-fp")
    rows = made.join(_named(made, most), F.col("fp") == F.col("of"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_fingerprint(documents: DataFrame, name: str, size: int = SHINGLE) -> DataFrame:
    """documents and the fingerprint of each row in a column of that name."""
    ddl = StructType([*documents.schema.fields, StructField(name, LongType())])
    at = documents.columns.index("text")
    arrow = to_arrow(documents.sparkSession, "fp long").field(0).with_name(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t, size) for t in as_bytes(b.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made)], schema=pa.schema([*b.schema, arrow]))

    return documents.mapInArrow(run, ddl)


def keep_one(documents: DataFrame, size: int = SHINGLE, most: int = MOST_GROUP) -> DataFrame:
    """One row of each component. Which is decided on ids and fingerprints; texts are shuffled once, on a number of the row."""
    fp, number = unused(documents.columns, "_fp"), unused(documents.columns, "_row")
    made = materialize(with_fingerprint(documents, fp, size).withColumn(number, F.monotonically_increasing_id()), "simhash-rows")
    slim = made.select("doc_id", F.col(f"`{fp}`").alias("fp"), F.col(f"`{number}`").alias("row"))
    found = _named(slim.select("doc_id", "fp"), most)
    chosen = slim.join(found.where("of = first_fp"), (F.col("fp") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = chosen.groupBy("of").agg(F.min("row").alias("_kept"))
    kept = made.join(rows, F.col(f"`{number}`") == F.col("_kept"), "left_semi")
    return kept.select(*(F.col(f"`{c}`") for c in documents.columns))
