"""Best-fit packing of token sequences by minimum bin slack.

Lengths lie between 1 and the capacity, so the whole corpus is a histogram of at most ``capacity`` lengths, however many
documents there are. On it the fullest combinations are found one after another; a combination is used as often as its
lengths last, which is what searching again for each bin would give. Pieces then take their places by their rank among the
pieces of their length, so no task holds a bin and no length, however frequent, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import byte_batches
from .tokens import encoder, filled

BROADCAST_ROWS = 200_000  # at most so many shifts, one per task and length, are broadcast; more are joined by shuffling the pieces


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Copies of lengths whose sum is the largest at most ``room``: subset sums as the bits of one number."""
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        before, left, step = reach, min(counts[length], room // length), 1
        stages.append((length, left, before))
        while left:
            take = min(step, left)
            reach |= reach << (take * length) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(stages):
        copies = next(n for n in range(most + 1) if total >= n * length and before >> (total - n * length) & 1)
        if copies:
            chosen[length] = copies
            total -= copies * length
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, copies of each length) of the bins. Each bin takes the longest piece left, and the fullest combination beside it."""
    left, bins = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if n > (k == longest)}
        chosen = fullest(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        bins.append((times, chosen))
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return bins


def token_pieces(df: DataFrame, path: str, *, key: str, text: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False, batch_bytes: int = 4 << 20) -> DataFrame:
    """The pieces of all documents: ``key``, piece, start, length, ids_crc32, and the task and the rank among its pieces of that length.

    A document is its ids and ``end_id``; null is the empty text. Only documents longer than ``capacity`` are cut, the first
    piece taking the remainder.
    """
    fields = [df.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, used = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in byte_batches(batches, text, batch_bytes):
            stream, bounds = encoder(path).batch(filled(batch.column(text)))
            rows, out, tokens = [], [], []
            for i in range(batch.num_rows):
                ids = np.append(stream[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate((0, *range(first, len(ids), capacity))):
                    part = ids[start : first if not start else start + capacity]
                    rows.append(i)
                    out.append((piece, start, len(part), zlib.crc32(part.tobytes()), task, used[len(part)]))
                    used[len(part)] += 1
                    if keep_ids:
                        tokens.append(part.astype(np.int32))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [batch.column(key).take(pa.array(rows, pa.int64()))] + [pa.array(list(map(int, x)), k) for x, k in zip(columns, kinds)]
            if keep_ids:
                arrays.append(pa.array(tokens, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return df.select(key, text).mapInArrow(cut, T.StructType(fields))


def pack(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """``key``, piece, start, length, ids_crc32, sequence_id, offset (and ids): the place of each piece in sequences of at most ``capacity`` tokens.

    Null and empty texts are one piece of length 1 (the end id). Rows with equal or null keys are packed as documents of
    their own. Other columns are dropped; an empty table gives an empty one. The driver holds the histogram of at most
    ``capacity`` lengths and the plan made of it, and up to ``BROADCAST_ROWS`` shifts of ranks.
    """
    pieces = materialize(token_pieces(df, path, key=key, text=text, capacity=capacity, end_id=end_id, keep_ids=keep_ids), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    found = counts.groupBy("length").agg(F.sum("n").alias("n"), F.count("*").alias("tasks")).collect()
    histogram = {r["length"]: r["n"] for r in found}
    # For each length, ranks from ``froms[i]`` on go to sequences from ``bases[i]`` on, ``copies[i]`` to each, from ``places[i]`` on.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = dict.fromkeys(histogram, 0)
    sequence = 0
    for times, chosen in minimum_bin_slack(histogram, capacity):
        place = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            slots.setdefault(length, []).append((ranks[length], sequence, copies, place))
            ranks[length] += times * copies
            place += length * copies
        sequence += times
    tables = {k: np.array(v, np.int64) for k, v in slots.items()}

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        ids, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k in np.unique(lengths):
            mine, slot = np.flatnonzero(lengths == k), tables[int(k)]
            at = slot[np.searchsorted(slot[:, 0], ranks[mine], side="right") - 1]
            turn, nth = np.divmod(ranks[mine] - at[:, 0], at[:, 2])
            ids[mine], offsets[mine] = at[:, 1] + turn, at[:, 3] + nth * k
        return pd.DataFrame({"sequence_id": ids, "offset": offsets})

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    # Beside broadcast shifts the pieces stay in the partitions they are read in.
    shifts = F.broadcast(shifts) if sum(r["tasks"] for r in found) <= BROADCAST_ROWS else shifts
    ranked = pieces.join(shifts, ["task", "length"]).withColumn("at", placed("length", F.col("rank") + F.col("shift")))
    return ranked.select(key, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if keep_ids else []))
