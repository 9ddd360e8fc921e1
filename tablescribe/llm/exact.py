"""Exact duplicates by Patricia tries over full byte strings.

Each scan task first inserts its own texts into a trie, so a text leaves a task at most once, however many rows hold it.
The distinct strings meet by length and content hash, and each such partition inserts them into one trie whose terminal
nodes hold the smallest identifier and the number of rows. A trie that outgrows its memory writes its largest subtrees to
the task's own temporary folder and finishes them one by one.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_text, text_of, unused

TRIE_BYTES = 96 << 20


class Trie:
    """A compressed radix trie from byte strings to (smallest identifier, rows). A node is [edge, children, terminal]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def add(self, key: bytes, ident, rows: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                self.bytes += len(key) - at + 400
                node, at = child, len(key)
                break
            edge = child[0]
            if not key.startswith(edge, at):
                same = _common(edge, key[at : at + len(edge)])
                child[0] = edge[same:]
                child = node[1][key[at]] = [edge[:same], {edge[same]: child}, None]
                self.bytes += 400
                edge = child[0]
            node, at = child, at + len(edge)
        if node[2] is None:
            node[2] = [ident, rows]
        else:
            if ident is not None and (node[2][0] is None or ident < node[2][0]):
                node[2][0] = ident
            node[2][1] += rows

    def items(self, prefix: bytes = b"", node: list | None = None) -> Iterator[tuple[bytes, object, int]]:
        """(string, smallest identifier, rows), below ``node`` whose edge begins after ``prefix``."""
        stack = [(prefix, node or self.root)]
        while stack:
            before, (edge, children, end) = stack.pop()
            key = before + edge
            if end is not None:
                yield key, end[0], end[1]
            stack.extend((key, x) for x in children.values())


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def merged(entries: Iterator[tuple[bytes, object, int]], limit: int = TRIE_BYTES, folder: str | None = None) -> Iterator[tuple[bytes, object, int]]:
    """Distinct strings with their smallest identifier and number of rows.

    Beyond ``limit`` bytes the heaviest subtrees below the first branching node are written to files, and so is whatever
    arrives for them later; each file is then merged on its own.
    """
    trie = Trie()
    spills: list[_Spill] = []
    try:
        for key, ident, rows in entries:
            if any(s.takes(key, ident, rows) for s in spills):
                continue
            trie.add(key, ident, rows)
            if trie.bytes > limit and _branches(trie) > 1:
                if spills:
                    spills[-1].shed(trie, limit // 2)
                if not spills or trie.bytes > limit:  # what arrived since then branches off earlier
                    spills.append(_Spill(trie, folder))
                    spills[-1].shed(trie, limit // 2)
        yield from trie.items()
        del trie
        for spill in spills:
            for path in spill.files():
                yield from merged(_read(path), limit, spill.folder.name)
                os.unlink(path)
    finally:
        for spill in spills:
            spill.folder.cleanup()


def _fork(trie: Trie) -> tuple[bytes, list]:
    """The first node with several ways on (or an end), and the bytes before them."""
    prefix, node = b"", trie.root
    while len(node[1]) == 1 and node[2] is None:
        node = next(iter(node[1].values()))
        prefix += node[0]
    return prefix, node


def _branches(trie: Trie) -> int:
    _, node = _fork(trie)
    return len(node[1]) + (node[2] is not None)


class _Spill:
    """Files of subtrees, by the bytes up to the first one after the fork."""

    def __init__(self, trie: Trie, folder: str | None):
        self.prefix, _ = _fork(trie)
        self.folder = tempfile.TemporaryDirectory(dir=folder)
        self.open: dict[int, object] = {}

    def takes(self, key: bytes, ident, rows: int) -> bool:
        n = len(self.prefix)
        if len(key) > n and key[n] in self.open and key.startswith(self.prefix):
            pickle.dump((key, ident, rows), self.open[key[n]])
            return True
        return False

    def shed(self, trie: Trie, keep: int) -> None:
        """Write subtrees out, largest first, until at most ``keep`` bytes are left."""
        node, at = trie.root, 0
        while at < len(self.prefix):
            node = node[1].get(self.prefix[at])
            if node is None:  # a later file has taken what was here
                return
            at += len(node[0])
        parts = {b: sum(len(k) - len(self.prefix) + 400 for k, _, _ in trie.items(self.prefix, x)) for b, x in node[1].items()}
        for b in sorted(parts, key=parts.get, reverse=True):
            if trie.bytes <= keep:
                break
            out = self.open.get(b) or open(os.path.join(self.folder.name, f"{b:03d}"), "wb")
            self.open[b] = out
            for entry in trie.items(self.prefix, node[1].pop(b)):
                pickle.dump(entry, out)
            trie.bytes -= min(parts[b], trie.bytes)

    def files(self) -> list[str]:
        for out in self.open.values():
            out.close()
        return [out.name for out in self.open.values()]


def _read(path: str) -> Iterator[tuple[bytes, object, int]]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def normalised(column: str) -> Column:
    """Null as empty; each run of space, tab, line feed, vertical tab, form feed and carriage return as one space."""
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]+", " ")


def _tries(df: DataFrame, ident: str, kind: T.DataType, limit: int, digest: bool) -> DataFrame:
    """Rows (norm, ident, rows) merged by a trie in each task; with ``digest`` the string's length and SHA-256 in its place."""
    first = [T.StructField("n_bytes", T.IntegerType()), T.StructField("text_sha256", T.StringType())]
    first = first if digest else [T.StructField("norm", T.BinaryType())]
    schema = T.StructType([*first, T.StructField(ident, kind), T.StructField("rows", T.LongType())])
    names = [f.name for f in schema]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, object, int]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), arrow)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for key, who, rows in merged(entries(batches), limit):
            held.append((len(key), hashlib.sha256(key).hexdigest(), who, rows) if digest else (key, who, rows))
            size += 100 if digest else len(key)
            if size > 8 << 20:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(schema))
    return df.mapInArrow(run, schema)


def text_owners(df: DataFrame, *, key: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: n_bytes, text_sha256, keep_id (smallest ``key``), group_size."""
    kind = df.schema[key].dataType
    rows = df.select(normalised(text).cast("binary").alias("norm"), F.col(key).alias("ident"), F.lit(1).cast("long").alias("rows"))
    local = _tries(rows, "ident", kind, trie_bytes, digest=False)
    met = local.repartition(F.octet_length("norm"), F.xxhash64("norm"))
    return _tries(met.select("norm", "ident", "rows"), "ident", kind, trie_bytes, digest=True).withColumnsRenamed({"ident": "keep_id", "rows": "group_size"})


def exact_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``key``, keep_id, group_size, kept and text_sha256 for every row of ``df``.

    Texts are equal if their bytes are after :func:`normalised`; null equals empty. Of a group the row with the smallest
    ``key`` is kept; null keys come after all others, and a group of null keys alone keeps one row. Of rows that repeat both
    key and text one counts as the kept one. Other columns are dropped; an empty table gives an empty one.
    Rows find their group by length and SHA-256; the groups themselves are of full strings.
    """
    owners = text_owners(df, key=key, text=text, trie_bytes=trie_bytes)
    norm = normalised(text)
    same = df.select(key, F.octet_length(norm).alias("n_bytes"), F.sha2(norm, 256).alias("text_sha256")).groupBy(key, "n_bytes", "text_sha256").agg(F.count("*").cast("int").alias("times"))
    rows = same.join(owners, ["n_bytes", "text_sha256"]).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(key, "keep_id", "group_size", (F.col(key).eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_duplicates` keeps, with all their columns; of rows that repeat key and text one."""
    own = [unused(df, "__key"), unused(df, "__sha")]
    kept = exact_duplicates(df, key=key, text=text).filter("kept").select(key_text(key).alias(own[0]), F.col("text_sha256").alias(own[1]))
    rows = df.withColumns({own[0]: key_text(key), own[1]: F.sha2(normalised(text), 256)})
    return rows.join(kept, own, "left_semi").dropDuplicates(own).drop(*own)
