"""Distinct words of a corpus: each is handled once, however many rows hold it, and its result goes back by position.

Rows are read in blocks of bounded size. A block keeps a dictionary of its distinct words, and each row becomes the places of
its words in that dictionary, in order. So a word leaves a block once, however frequent it is, and only dictionaries are
shuffled: by word, where each word meets all blocks that hold it, and back by block. The rows stay where they were written,
bucketed by block.

``write_blocks`` gives the blocks, ``entries`` the words with their places, ``pack`` and ``unpack`` the results of words on
their way back, ``reassemble`` the rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bucketed

BLOCK_BYTES = 64 << 20  # a block ends at so many bytes of text
BLOCK_WORDS = 500_000  # or so many distinct words, whichever comes first; a longer text is a block of its own
REMEMBERED = 200_000  # segments a task remembers the words of
LINE = 10_000  # words in a row of a dictionary
OUT_BYTES = 4 << 20  # rows leave a task in batches of about so many bytes
OUT_WORDS = 1 << 18  # rows are put together for so many words at once
PACKED = 500_000  # results of words packed at once

_CUT = re.compile(r"(?<=\S) (?=\S)")


class Splitter:
    """Places of a text's words, by way of segments between single spaces that follow and precede a visible character.

    ``pieces(segment)`` gives the words of a segment, with the space before it. ``lead`` is put before every text, and
    ``odd(text)`` tells which texts are one word of their own, whole.
    """

    def __init__(self, pieces: Callable[[str], list[str]], lead: str = "", odd: Callable[[str], bool] = lambda text: False):
        self.pieces, self.lead, self.odd = pieces, lead, odd
        self.words: dict[str, int] = {}
        self.segments: dict[str, list[int] | None] = {}

    def start(self) -> None:
        self.words, self.segments = {}, {}

    def _places(self, segment: str) -> list[int]:
        words = self.words
        return [words.setdefault(w, len(words)) for w in self.pieces(segment)]

    def _inner(self, part: str) -> list[int] | None:
        safe = part and not part[0].isspace() and not part[-1].isspace()
        found = self._places(f" {part}") if safe else None
        if len(self.segments) < REMEMBERED and len(part) < 200:
            self.segments[part] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        """The places of the words of ``text``, in order; new words get the next places."""
        if not text:
            return np.zeros(0, "<i4")
        if self.odd(text):
            return np.array([self.words.setdefault(self.lead + text, len(self.words))], "<i4")
        parts = text.split(" ")
        first = parts[0]
        if first and not first[0].isspace() and not first[-1].isspace():
            known, inner = self.segments, self._inner
            found = [known[p] if p in known else inner(p) for p in parts[1:]]
            if None not in found:
                opening = self._places(self.lead + first)
                return np.fromiter(itertools.chain(opening, *found), "<i4")
        # White space stands beside some space: cut at the others only.
        cut = _CUT.split(text)
        return np.fromiter(itertools.chain(self._places(self.lead + cut[0]), *(self._places(f" {p}") for p in cut[1:])), "<i4")


def write_blocks(df: DataFrame, splitter: Callable[[], Splitter], *, key: str, text: str, name: str) -> DataFrame:
    """The rows of ``df`` as blocks, written bucketed by block.

    Rows of a text have ``key`` and ``places`` (little-endian 32-bit numbers); a null text has none. Rows of a dictionary
    have ``first``, the place of their first word, ``words`` and ``counts``, the occurrences of each in the block.
    """
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("key", df.schema[key].dataType),
            T.StructField("places", T.BinaryType()),
            T.StructField("first", T.IntegerType()),
            T.StructField("words", T.ArrayType(T.StringType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        split = splitter()
        block, size, counts = TaskContext.get().partitionId() << 33, 0, np.zeros(0, np.int64)
        kind = None
        kinds = lambda: (pa.int64(), kind, pa.binary(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds())], names=schema.names)

        def dictionary() -> Iterator[pa.RecordBatch]:
            words = list(split.words)
            for at in range(0, len(words), LINE):
                yield batch_of([(block, None, None, at, words[at : at + LINE], counts[at : min(at + LINE, len(words))].tolist())])

        for batch in batches:
            kind = batch.column(0).type
            rows, held = [], 0
            for k, t in zip(batch.column(0), batch.column(1)):
                places = split(t.as_py() or "")
                n = len(split.words)
                if n > len(counts):
                    counts = np.concatenate((counts, np.zeros(max(n - len(counts), len(counts)), np.int64)))
                np.add.at(counts, places, 1)
                rows.append((block, k, places.tobytes(), None, None, None))
                held += 4 * len(places)
                size += len(t.as_py() or "")
                if held > OUT_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
                if size > BLOCK_BYTES or n > BLOCK_WORDS:
                    if rows:
                        yield batch_of(rows)
                        rows, held = [], 0
                    yield from dictionary()
                    split.start()
                    block, size, counts = block + 1, 0, np.zeros(0, np.int64)
            if rows:
                yield batch_of(rows)
        if split.words:
            yield from dictionary()

    return bucketed(df.select(key, text).mapInArrow(run, schema), "block", name)


def entries(blocks: DataFrame) -> DataFrame:
    """``word``, ``block``, ``place`` and ``n``: each word of each block once, with its occurrences there; all rows of a word follow each other in one task.

    A word has at most as many rows as there are blocks.
    """
    lines = blocks.filter("words IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x"))
    each = lines.select(F.col("x.words").alias("word"), "block", (F.col("first") + F.col("i")).alias("place"), F.col("x.counts").alias("n"))
    return each.repartition("word").sortWithinPartitions("word")


def squeeze(values: np.ndarray, kind: str = "<i4") -> bytes:
    return zstandard.compress(values.astype(kind).tobytes(), 1)


def stretch(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def pack(blocks: np.ndarray, places: np.ndarray, *channels: tuple[np.ndarray, np.ndarray, str]) -> pa.RecordBatch:
    """A row per block with the places of its entries and, for each channel, their values, compressed.

    A channel is (sizes, values, kind): ``values`` has ``sizes`` items for each entry, one entry after another.
    """
    order = np.lexsort((places, blocks))
    blocks, places = blocks[order], places[order]
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    spans = [(a, b) for a, b in itertools.pairwise(cuts) if b > a]
    names, columns = ["block", "places"], [pa.array([int(blocks[a]) for a, _ in spans], pa.int64()), pa.array([squeeze(np.diff(places[a:b], prepend=0)) for a, b in spans], pa.binary())]
    for i, (sizes, values, kind) in enumerate(channels):
        begins, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
        reached = np.concatenate(([0], np.cumsum(lengths)))
        moved = values[np.repeat(begins - reached[:-1], lengths) + np.arange(reached[-1])]
        names += [f"sizes{i}", f"values{i}"]
        columns += [pa.array([squeeze(lengths[a:b]) for a, b in spans], pa.binary()), pa.array([squeeze(moved[reached[a] : reached[b]], kind) for a, b in spans], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def packed_schema(channels: int) -> str:
    return ", ".join(["block long, places binary", *(f"sizes{i} binary, values{i} binary" for i in range(channels))])


def unpack(rows: pa.Table, channel: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, values) of a channel: where the values of each place begin, how many they are, and all values."""
    parts = [(np.cumsum(stretch(p)), stretch(s), stretch(v, kind)) for p, s, v in zip(*(rows.column(c).to_pylist() for c in ("places", f"sizes{channel}", f"values{channel}")))]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
    places, sizes, values = (np.concatenate(x) for x in zip(*parts))
    begin, size = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    begin[places], size[places] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
    return begin, size, values


def gather(begin: np.ndarray, size: np.ndarray, values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values of ``places``, one after another."""
    sizes = size[places]
    ends = np.cumsum(sizes)
    return values[np.repeat(begin[places] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def slices(texts: pa.Table) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """The rows of a block and their places, for about :data:`OUT_WORDS` words at once; a longer row is a slice of its own."""
    sizes = np.array([len(x) // 4 for x in texts.column("places").to_pylist()], np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // OUT_WORDS)) + 1).tolist(), len(sizes)]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            part = texts.slice(a, b - a)
            yield part, [np.frombuffer(x, "<i4") for x in part.column("places").to_pylist()]


def lean() -> None:
    """Lets this worker give the memory of finished batches back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())


def reassemble(blocks: DataFrame, packed: DataFrame, rows: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """``rows(texts, results)`` per block: the rows of its texts (key, places) and the packed results of its words.

    Only the results are shuffled; the texts are read from their buckets.
    """
    texts = blocks.filter("words IS NULL").select("block", "key", "places")
    return texts.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(rows, schema)
