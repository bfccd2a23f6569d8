"""Shared helpers: table access, the shared folder, Arrow batch maps, memo of words.

Words are maximal runs of bytes other than U+0020 and U+0009..U+000D. On UTF-8 bytes that is
what ``bytes.split()`` with no argument separates, so words are handled as bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sarnai.shared import discard, materialize, shared_folder, written  # noqa: F401 - used by the operators
from sarnai.ship import ship

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, with its file system's name: a path without one means the same to Spark and to others."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def unused(columns: Iterable[str], name: str) -> str:
    """The name, with more underscores where a column already has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text, modulo; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def crc_mod(doc_id: int | None, modulus: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def map_columns(
    df: DataFrame, columns: list[str], make: Callable[[], Callable[..., dict]], schema: str
) -> DataFrame:
    """Arrow batches through ``make()(*arrays) -> {name: list or array}``; make() runs once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            out = step(*(b.column(i) for i in range(b.num_columns)))
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    arrow = to_arrow(df.sparkSession, schema)
    return df.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[pa.Array], Iterable[bool]]]) -> DataFrame:
    """Rows whose mask is true, every column of df unchanged, whatever its name."""
    at = df.columns.index(column)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            yield b.filter(pa.array(step(b.column(at)), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def to_arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string, for a Python stage, whose workers must find this package."""
    ship(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


class Memo:
    """word -> value for words met so far; forgets all of them beyond ``most`` entries."""

    def __init__(self, compute: Callable[[list[bytes]], list], most: int = 300_000):
        self.compute, self.most, self.known = compute, most, {}

    def learn(self, words: Iterable[bytes]) -> dict:
        new = list(set(words) - self.known.keys())
        if new:
            if len(self.known) + len(new) > self.most:
                self.known = {}
                new = list(set(words))
            self.known.update(zip(new, self.compute(new), strict=True))
        return self.known


def blocks(rows: list, sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive rows of at most ``most`` bytes each, or of one row."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(rows):
        yield slice(begin, len(rows))
