"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(column: str) -> Column:
    """The column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def small(df: DataFrame, rows: int) -> DataFrame:
    """For a join: broadcast if there are at most ``rows`` rows, which are counted first and must be narrow; else left to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def key_text(column: str) -> Column:
    """A key as text that is never null, for joins in which null keys are equal."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def crc_remainder(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_hash(column: str) -> Column:
    """A hash of the text that is never negative, by which samples of distinct texts are drawn."""
    return F.shiftrightunsigned(F.xxhash64(column), 1)


def _by_key(values: dict, key: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(key))


def smallest_hashes(df: DataFrame, key: str, groups: int, wanted: Callable[[dict], dict]) -> tuple[dict, dict]:
    """(distinct, last) of the columns ``key`` and ``h`` of ``df``: per key the number of distinct hashes, and the largest one wanted.

    ``wanted`` gives per key how many of the smallest hashes are drawn, at least one and at most as many as there are. They
    are counted by their number of bits first, so only about twice as many as are wanted are put in order. More than
    ``groups`` keys are an error.
    """
    hashes = materialize(df.select(key, "h").distinct(), "hashes").withColumn("bits", F.length(F.bin("h")))
    counts = hashes.groupBy(key, "bits").agg(F.count("*").alias("n")).limit(64 * groups + 1).collect()
    distinct: Counter = Counter()
    for r in counts:
        distinct[r[key]] += r["n"]
    if len(distinct) > groups:
        raise ValueError(f"more than {groups} values of {key}")
    if not distinct:
        return {}, {}
    chosen = wanted(dict(distinct))
    enough, found = {}, Counter()
    for r in sorted(counts, key=lambda r: r["bits"]):
        if found[r[key]] < chosen[r[key]]:
            enough[r[key]] = r["bits"]
        found[r[key]] += r["n"]
    ranked = hashes.filter(F.col("bits") <= _by_key(enough, key)).withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("h")))
    return dict(distinct), {r[key]: r["h"] for r in ranked.filter(F.col("n") == _by_key(chosen, key)).collect()}


def up_to_hash(df: DataFrame, key: str, last: dict) -> DataFrame:
    """The rows of ``df`` whose ``h`` is among the smallest ones of their ``key``."""
    return df.filter(F.col("h") <= _by_key(last, key))


def byte_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``; a longer text is a batch of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start, sizes = 0, _sizes(batch.column(column))
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                held.append(batch.slice(start, i - start))
                yield _joined(held)
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if any(b.num_rows for b in held):
        yield _joined(held)


def _sizes(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
