"""SimHash near-duplicates found with BK-trees.

Two fingerprints that differ in at most r bits agree in whole blocks when 64 bits are cut into more than r blocks: with
``blocks`` blocks, at least ``blocks - r`` of them. Every choice of that many blocks deals the distinct fingerprints into
shards by their bits there, so linked fingerprints share a shard. A shard is a BK-tree: the children of a node are keyed by
their Hamming distance to it, and a search follows only the edges within the radius of the distance it has found. Trees are
built and searched level by level for all shards of a task at once. A shard of more than ``shard_rows`` fingerprints is cut
into trees of that size, and each pair of cuts is a task's unit of its own.
Every unit gives back a spanning star of what it linked, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ..session import materialize
from .common import key_text, text_of, unused
from .components import components

SEED = 42
_BLOCK = 1 << 16  # shingles hashed at once
_FRONTIER = 1 << 21  # (query, node) pairs held at once


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text as a signed number: words split at ASCII white space, A-Z lower-cased, shingles with repeats."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    if n <= words:
        value = xxh64_intdigest(joined, SEED)
        return value - (1 << 64) if value >> 63 else value
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    votes = np.zeros(64, np.int64)
    for at in range(0, n - words + 1, _BLOCK):
        to = min(at + _BLOCK, n - words + 1)
        hashes = [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(begins[at:to].tolist(), ends[at + words - 1 : to + words - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    ones = votes * 2 > n - words + 1
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(column: str, words: int = 4) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t, words)).astype("int64")

    return of(text_of(column))


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` blocks of nearly equal width."""
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shards(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """``fp``, and for each choice of blocks its number and the bits there."""
    if not radius < blocks <= 16:
        raise ValueError("blocks must be more than the radius, and at most 16")
    keys = []
    for i, chosen in enumerate(combinations(_blocks(blocks), blocks - radius)):
        mask = sum(((1 << width) - 1) << shift for shift, width in chosen)
        mask -= 1 << 64 if mask >> 63 else 0
        keys.append(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("s")).select("fp", "s.choice", "s.bits")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees of all groups at once. ``fps`` and ``groups`` are aligned; rows of a group are inserted in their order."""

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        self.fps = fps
        left = np.argsort(groups, kind="stable")
        sub = groups[left]
        self.root_of: dict[int, int] = {}
        parents, edges, nodes = [], [], []
        parent = np.full(len(left), -1)
        distance = np.zeros(len(left), np.int64)
        while len(left):
            head = np.concatenate(([True], sub[1:] != sub[:-1]))
            which = np.cumsum(head) - 1
            roots = left[head]
            nodes.append(roots)
            parents.append(parent[head])
            edges.append(distance[head])
            rest = ~head
            left, which = left[rest], which[rest]
            parent = roots[which]
            distance = _distance(fps[left], fps[parent])
            order = np.lexsort((distance, which))
            left, parent, distance = left[order], parent[order], distance[order]
            sub = which[order] * 65 + distance
        self.node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        up = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        tops = up < 0
        self.roots = self.node[tops]
        self.root_groups = groups[self.roots]
        # Children in order of (parent, edge), so the edges within a radius are one range.
        key = up * 65 + edge
        order = np.argsort(key[~tops], kind="stable")
        self.key, self.child = key[~tops][order], self.node[~tops][order]

    def search(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query position, node) pairs within the radius, in portions; each query searches the tree of its group."""
        by = np.argsort(self.root_groups, kind="stable")
        at = np.searchsorted(self.root_groups[by], groups)
        inside = at < len(by)
        inside[inside] = self.root_groups[by][at[inside]] == groups[inside]
        query = np.flatnonzero(inside)
        waiting = [(query, self.roots[by[at[query]]])] if len(query) else []
        while waiting:
            query, node = waiting.pop()
            if len(query) > _FRONTIER:
                waiting.append((query[_FRONTIER:], node[_FRONTIER:]))
                query, node = query[:_FRONTIER], node[:_FRONTIER]
            far = _distance(queries[query], self.fps[node])
            near = far <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(far - radius, 0), side="left")
            high = np.searchsorted(self.key, node * 65 + np.minimum(far + radius, 64), side="right")
            n = high - low
            if n.any():
                # Portions of bounded size, whatever the number of children.
                total = np.cumsum(n)
                for a in range(0, len(n), max(1, int(len(n) * _FRONTIER // (total[-1] + 1)) or 1)):
                    b = min(len(n), a + max(1, int(len(n) * _FRONTIER // (total[-1] + 1)) or 1))
                    m = n[a:b]
                    if not m.any():
                        continue
                    ends = np.cumsum(m)
                    spread = np.repeat(low[a:b] - (ends - m), m) + np.arange(ends[-1])
                    waiting.append((np.repeat(query[a:b], m), self.child[spread]))


class Union:
    """Union-find over positions, hooked and compressed for many pairs at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _stars(fps: np.ndarray, unit: np.ndarray, cut: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what each unit joins. Rows with ``tree`` build the unit's tree; rows of another cut search it, and those of one cut search their own."""
    forest = Forest(fps[tree], unit[tree])
    owner = np.flatnonzero(tree)
    union = Union(len(fps))
    asks = np.flatnonzero(cut)
    for query, node in forest.search(fps[asks], unit[asks], radius):
        union.join(asks[query], owner[node])
    member = np.flatnonzero(union.root != np.arange(len(fps)))
    return fps[member], fps[union.root[member]]


def links(fps: DataFrame, radius: int = 4, *, blocks: int = 6, shard_rows: int = 16_384) -> DataFrame:
    """``a``, ``b``: links between the distinct fingerprints ``fp`` whose components are those of all pairs within ``radius`` bits."""
    dealt = materialize(shards(fps, radius, blocks), "shards")
    sizes = dealt.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select("choice", "bits", F.ceil(F.col("n") / shard_rows).cast("int").alias("cuts"))
    met = dealt.join(sizes, ["choice", "bits"])
    # Cut c of a large shard is the tree of units (c, j), and searches the trees of units (i, c), for i <= c <= j.
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    met = met.withColumn("c", mine)
    roles = F.flatten(
        F.array(
            F.transform(F.sequence(F.col("c"), F.col("cuts") - 1), lambda j: F.struct(F.col("c").alias("i"), j.alias("j"), F.lit(True).alias("tree"), (j == F.col("c")).alias("asks"))),
            F.transform(F.filter(F.sequence(F.lit(0), F.col("c")), lambda i: i < F.col("c")), lambda i: F.struct(i.alias("i"), F.col("c").alias("j"), F.lit(False).alias("tree"), F.lit(True).alias("asks"))),
        )
    )
    units = met.withColumn("u", F.explode(roles)).select("fp", "u.tree", "u.asks", F.xxhash64("choice", "bits", "u.i", "u.j").alias("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            last = batch.column("unit")[-1].as_py()
            if rows >= 4 * shard_rows:
                all_rows = pa.Table.from_batches(held)
                open_unit = pc.equal(all_rows.column("unit"), last)
                done = all_rows.filter(pc.invert(open_unit))
                if done.num_rows:
                    yield star(done)
                    held = all_rows.filter(open_unit).to_batches()
                    rows = sum(b.num_rows for b in held)
        if held:
            yield star(pa.Table.from_batches(held))

    def star(t: pa.Table) -> pa.RecordBatch:
        fps, tree, asks = (t.column(c).to_numpy() for c in ("fp", "tree", "asks"))
        _, unit = np.unique(t.column("unit").to_numpy(), return_inverse=True)
        a, b = _stars(fps.view(np.uint64), unit, asks.astype(bool), tree.astype(bool), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, blocks: int = 6, shard_rows: int = 16_384) -> DataFrame:
    """``key``, fingerprint (16 hex digits) and component_id (the smallest ``key`` reachable over links) for every row of ``df``.

    Null and empty texts have no words and fingerprint zero, which links like any other. Rows with equal texts share a
    fingerprint and so a component; null keys count last. Other columns are dropped; an empty table gives an empty one.
    """
    rows = materialize(df.select(key, fingerprints(text, words).alias("fp")), "fingerprints")
    labels = classes(rows, key=key, radius=radius, blocks=blocks, shard_rows=shard_rows).select("fp", "component_id")
    return rows.join(labels, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classes(rows: DataFrame, *, key: str, radius: int, blocks: int, shard_rows: int) -> DataFrame:
    """``fp``, first (its smallest ``key``) and component_id (the smallest of its component) of each distinct fingerprint."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct-fingerprints")
    roots = materialize(components(links(distinct.select("fp"), radius, blocks=blocks, shard_rows=shard_rows)), "roots")
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    return linked.join(smallest, "root").select("fp", "first", "component_id")


def drop_near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4, blocks: int = 6, shard_rows: int = 16_384) -> DataFrame:
    """Of each component of :func:`near_duplicates` the row with the smallest ``key``, with all its columns; of rows that repeat key and fingerprint one."""
    own = [unused(df, "__fp"), unused(df, "__key")]
    rows = materialize(df.withColumns({own[0]: fingerprints(text, words), own[1]: key_text(key)}), "fingerprinted")
    found = classes(rows.select(F.col(key), F.col(own[0]).alias("fp")), key=key, radius=radius, blocks=blocks, shard_rows=shard_rows)
    stay = found.filter(F.col("first").eqNullSafe(F.col("component_id"))).select(F.col("fp").alias(own[0]), key_text("first").alias(own[1]))
    return rows.join(stay, own, "left_semi").dropDuplicates(own).drop(*own)
