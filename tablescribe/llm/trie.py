"""Prefix trie of conversations from the longest common prefixes of their sorted turn sequences.

Sequences of turn digests are sorted over the whole table, and a node of depth d is an interval of neighbours whose common
prefixes have at least d turns. Every candidate prefix (a conversation and a depth at which it departs from its neighbour)
finds its interval by itself: a sparse table of range minima answers how far, doubling steps search left and right. Sums over a
subtree are differences of prefix sums, because the nodes in order of (conversation, depth) have each subtree in one stretch.

Partitions are ranges of the sorted order, so a prefix that a third of all conversations share lies in many of them. Only
prefixes open at a partition's ends concern others. They are named by the partition in which they begin, found in the same
way in a sparse table of the partitions' minima (one number each), and what each partition holds of them is added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bucketed, materialize

WIDTH = 32  # bytes of a turn's digest
CHUNK = 100_000  # identifiers joined in one value
EMPTY = hashlib.sha256(b"").hexdigest()


class Minima:
    """Range minima by a sparse table, and how far around a place all values reach a bound."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [np.asarray(values)], 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value of each range, both ends included: two overlapping powers of two."""
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            mine = level == k
            out[mine] = np.minimum(self.levels[k][first[mine]], self.levels[k][last[mine] - (1 << k) + 1])
        return out

    def right(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place such that all values behind ``start`` up to it are at least ``bound``."""
        at, n = np.array(start, np.int64), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at + (1 << k) < n
            fits[fits] = self.levels[k][at[fits] + 1] >= bound[fits]
            at[fits] += 1 << k
        return at

    def left(self, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to ``start`` whose value is below ``bound``; -1 if there is none."""
        at = np.array(start, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at - (1 << k) + 1 >= 0
            fits[fits] = self.levels[k][at[fits] - (1 << k) + 1] >= bound[fits]
            at[fits] -= 1 << k
        return at


def common(a: bytes, b: bytes) -> int:
    """How many digests two sequences have in common from the beginning."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(s, np.uint64, n * WIDTH // 8).reshape(n, WIDTH // 8) for s in (a, b))
    differ = (x != y).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


class Interval:
    """The sorted sequences of one partition, with its neighbours' nearest ones (None at the ends of the table)."""

    def __init__(self, seqs: list[bytes], convs: np.ndarray, before: bytes | None, after: bytes | None):
        self.n, self.convs = len(seqs), convs
        self.lens = np.array([len(s) // WIDTH for s in seqs], np.int64)
        first = -1 if before is None else common(before, seqs[0])
        self.lcp = np.array([first, *(common(a, b) for a, b in zip(seqs, seqs[1:]))], np.int64)
        self.behind = -1 if after is None else common(seqs[-1], after)
        self.minima, self.ids = Minima(self.lcp), Minima(convs)

    def open_left(self) -> tuple[np.ndarray, np.ndarray]:
        """Depths of the prefixes that begin in an earlier partition, and the last place of each."""
        depths = np.arange(self.lcp[0] + 1)
        return depths, self.minima.right(np.zeros(len(depths), np.int64), depths)

    def open_right(self) -> tuple[np.ndarray, np.ndarray]:
        """Depths of the prefixes that begin here and go on in the next partition, and the first place of each."""
        depths = np.arange(self.lcp.min() + 1, self.behind + 1)
        return depths, self.minima.left(np.full(len(depths), self.n - 1), depths)

    def longer(self, first: np.ndarray, last: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """Whether sequences of an interval go beyond its depth: the last one then does, shorter ones come first."""
        return self.lens[last] > depths


_SIDES = "part long, depth long, own boolean, n_convs long, conv_id long, longer boolean, least long"
_NODES = "part long, owner long, depth long, own boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, chunk long, ends string"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _interval(rows: pa.Table, edges: pa.Table) -> tuple[Interval, pa.Table, int]:
    rows = rows.sort_by("pos")
    edge = next(r for r in edges.select(["part", "before", "after"]).slice(0, 1).to_pylist())
    return Interval(rows.column("seq").to_pylist(), rows.column("conv").to_numpy(), edge["before"], edge["after"]), rows, edge["part"]


def _sides(rows: pa.Table, edges: pa.Table) -> pa.Table:
    """What a partition holds of the prefixes that are open at its ends, and (depth null) the least common prefix in it."""
    x, _, part = _interval(rows, edges)
    out = [(part, None, False, x.n, None, None, int(x.lcp.min()))]
    for own, (depths, places) in ((False, x.open_left()), (True, x.open_right())):
        if len(depths):
            first, last = (places, np.full(len(depths), x.n - 1)) if own else (np.zeros(len(depths), np.int64), places)
            found = zip(depths.tolist(), (last - first + 1).tolist(), x.ids.least(first, last).tolist(), x.longer(first, last, depths).tolist())
            out += [(part, d, own, n, conv, longer, None) for d, n, conv, longer in found]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=_names(_SIDES))


def _nodes(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The nodes that begin in a partition, and its share of those that begin before.

    ``known`` has the edges in every row, and per open prefix its owner, members, smallest member and whether it has longer ones.
    """
    x, rows, part = _interval(rows, known)
    open_rows = [r for r in known.select(["depth", "own", "owner", "n_convs", "conv_id", "longer"]).to_pylist() if r["depth"] is not None]
    ours = {r["depth"]: r for r in open_rows if r["own"]}
    theirs = {r["depth"]: r for r in open_rows if not r["own"]}
    # All nodes that begin here, in order: the depths at which a conversation departs from the one before.
    counts = x.lens - x.lcp
    starts = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(np.arange(x.n), counts)
    depth = np.arange(starts[-1]) - starts[at] + x.lcp[at] + 1
    last = x.minima.right(at, depth)
    n_convs, conv, longer = last - at + 1, x.ids.least(at, last), x.longer(at, last, depth)
    spilled = np.flatnonzero((last == x.n - 1) & (depth <= x.behind))
    for i in spilled.tolist():
        r = ours[int(depth[i])]
        n_convs[i], conv[i], longer[i] = r["n_convs"], r["conv_id"], r["longer"]
    sizes = rows.column("sizes").combine_chunks()
    flat, begins = sizes.flatten().to_numpy(), np.concatenate(([0], np.cumsum(x.lens)))
    said = np.zeros(len(at), np.int64)
    said[depth > 0] = flat[begins[at[depth > 0]] + depth[depth > 0] - 1]
    saved = np.concatenate(([0], np.cumsum((n_convs - 1) * said)))
    leaves = np.concatenate(([0], np.cumsum((depth == x.lens[at]) & ~longer)))
    # Parents: the node before, unless the conversation departs here; then the one that holds the place at that depth.
    children, parent = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    parents_conv = np.zeros(len(at), np.int64)
    departs = np.flatnonzero((depth == x.lcp[at] + 1) & (depth > 0))
    inner = np.flatnonzero(depth > x.lcp[at] + 1)
    parent[inner] = inner - 1
    place = x.minima.left(at[departs], depth[departs] - 1)
    here = place >= 0
    parent[departs[here]] = starts[place[here]] + depth[departs[here]] - 2 - x.lcp[place[here]]
    has = parent >= 0
    np.add.at(children, parent[has], 1)
    parents_conv[has] = conv[parent[has]]
    abroad = departs[~here]
    parents_conv[abroad] = [theirs[int(d) - 1]["conv_id"] for d in depth[abroad]]
    children_abroad = np.bincount(depth[abroad] - 1, minlength=len(theirs))
    # Conversations that end at a node follow each other from its first place on.
    same = (x.lcp == x.lens) & (np.arange(x.n) > 0)
    run_end = Minima(same.astype(np.int8)).right(np.arange(x.n), np.ones(x.n, np.int8)) if x.n else np.zeros(0, np.int64)
    out, is_spilled = [], np.zeros(len(at), bool)
    is_spilled[spilled] = True

    def chunks(first: int, last: int) -> list[str]:
        return [",".join(map(str, x.convs[a : min(a + CHUNK, last + 1)].tolist())) for a in range(first, last + 1, CHUNK)]

    ends_at = np.where(is_spilled, starts[-1], starts[last + 1])
    n_leaves, total = leaves[ends_at] - leaves[np.arange(len(at))], saved[ends_at] - saved[np.arange(len(at))]
    for i, (j, d, c, up, n, kids, tips, worth, spills) in enumerate(zip(*(v.tolist() for v in (at, depth, conv, parents_conv, n_convs, children, n_leaves, total, is_spilled)))):
        ends = chunks(j, int(run_end[j])) if d == x.lens[j] else []
        up = up if d else None
        if spills:
            out.append((part, part, d, True, c, up, n, kids, tips, worth, None, None, None))
            out += [(part, part, d, False, None, None, None, 0, 0, 0, None, k, text) for k, text in enumerate(ends)]
        else:
            digest = hashlib.sha256(",".join(ends).encode()).hexdigest() if ends else EMPTY
            out.append((part, None, d, True, c, up, n, kids, tips, worth, digest, None, None))
    depths, places = x.open_left()
    for d, r in zip(depths.tolist(), places.tolist()):
        out.append((part, theirs[d]["owner"], d, False, None, None, None, int(children_abroad[d]), int(leaves[starts[r + 1]]), int(saved[starts[r + 1]]), None, None, None))
    if x.lcp[0] == x.lens[0] >= 0 and len(depths):
        out += [(part, theirs[int(x.lens[0])]["owner"], int(x.lens[0]), False, None, None, None, 0, 0, 0, None, k, text) for k, text in enumerate(chunks(0, int(run_end[0])))]
    kinds = [pa.bool_() if f.endswith("boolean") else pa.string() if f.endswith("string") else pa.int64() for f in _NODES.split(", ")]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=_names(_NODES))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """owner, depth and the digest of the joined ``ends``, whose parts follow each other."""
    node, digest, found = None, None, []
    for batch in batches:
        for owner, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ends"))):
            if (owner, depth) == node:
                digest.update(b",")
            else:
                if node:
                    found.append((*node, digest.hexdigest()))
                node, digest = (owner, depth), hashlib.sha256()
            digest.update(ends.encode())
    if node:
        found.append((*node, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 3, (pa.int64(), pa.int64(), pa.string()))], names=["owner", "depth", "sha"])


def rebuilt(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = 5, most: int = 9) -> DataFrame:
    """``conv``, ``turns`` (digest of role and text, UTF-8 bytes of the text): each conversation c with the beginning of another one.

    These are the first h turns of conversation c - c % ``family`` (all if fewer, none if absent; % keeps the sign of c) and
    c's own turns behind its first h, where h is crc32 of c's decimal text modulo ``most``. Turns are in order of turn (null
    first), role and text; null roles and texts are empty; rows without a conversation belong to none.
    """
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = df.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), said[0].alias("role"), said[1].alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    listed = rows.select("conv", nth.alias("i"), digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))
    own = listed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "digest", "size"))).alias("turns"))
    base = (F.col("conv") - F.col("conv") % family).alias("base")
    heads = own.filter(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    joined = own.select("conv", "turns", base, h.alias("h")).join(heads, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    begin = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv", F.concat(begin, rest).alias("turns"))


def prefix_trie(df: DataFrame, **columns) -> DataFrame:
    """A row per node of the trie of the :func:`rebuilt` conversations of ``df`` (arguments as there).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. Repeated rows are turns of their own; an empty table has no node, not even the root. Turns are equal if
    their role and text have the same SHA-256. A conversation's digests, 32 bytes a turn, are one row.
    """
    spark = df.sparkSession
    turns = rebuilt(df, **columns)
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    flat = turns.select("conv", seq.alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The conversation is part of the key, so equal sequences are spread too.
    ordered = flat.repartitionByRange(parts, "seq", "conv").sortWithinPartitions("seq", "conv").withColumn("id", F.monotonically_increasing_id())
    place = [F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("pos")]
    rows = bucketed(ordered.select(*place, "conv", "seq", "sizes"), "part", "sequences")
    # A row per partition from here on.
    order = Window.orderBy("part")
    ends = rows.groupBy("part").agg(F.min_by("seq", "pos").alias("first"), F.max_by("seq", "pos").alias("last"))
    edges = materialize(ends.select("part", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after")), "edges")
    sides = materialize(rows.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(_sides, _SIDES), "sides")
    minima = {r["part"]: r["least"] for r in sides.filter("depth IS NULL").select("part", "least").collect()}
    numbers = np.array(sorted(minima), np.int64)
    least = np.array([minima[p] for p in numbers.tolist()], np.int64)

    def with_owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Minima(least)
        for batch in batches:
            part, depth = (batch.column(c).to_numpy() for c in ("part", "depth"))
            own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
            before = np.searchsorted(numbers, part) - 1
            owner = np.where(own, part, 0)
            owner[~own] = numbers[table.left(before[~own], depth[~own])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(owner)], names=[*batch.schema.names, "owner"])

    fields = "part long, depth long, own boolean, n_convs long, conv_id long, longer boolean, owner long"
    open_sides = sides.filter("depth IS NOT NULL").drop("least").mapInArrow(with_owner, fields)
    whole = open_sides.groupBy("owner", "depth").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.bool_or("longer").alias("longer"))
    asked = open_sides.select("part", "depth", "own", "owner").join(whole, ["owner", "depth"])
    known = edges.join(asked, "part", "left").select("part", "before", "after", "depth", "own", "owner", "n_convs", "conv_id", "longer")
    nodes = materialize(rows.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_nodes, _NODES), "nodes")
    columns_out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # Nodes that go through several partitions.
    shared = nodes.filter("owner IS NOT NULL")
    sums = shared.groupBy("owner", "depth").agg(
        *(F.max(c).alias(c) for c in ("conv_id", "parent_conv_id", "n_convs")), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens"))
    )
    pieces = shared.filter("ends IS NOT NULL").select("owner", "depth", "part", "chunk", "ends").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part", "chunk")
    digests = pieces.select("owner", "depth", "ends").mapInArrow(_ends, "owner long, depth long, sha string")
    merged = sums.join(digests, ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY)))
    return nodes.filter("owner IS NULL").select(*columns_out).unionByName(merged.select(*columns_out))
