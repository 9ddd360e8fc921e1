"""Toxicity scores of a factorisation machine over hashed terms.

A text is the set of its words and word beginnings, hashed. Over all training rows the terms are counted by label. The
machine's features are those whose frequency differs between the labels on their own, and those that differ only beside
another term, as a group's name does beside an insult. It learns a weight for each and, by factors, for each pair of them, so
that words count differently together than apart. The machine is fitted on a bounded sample; counts and scores cover everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import byte_batches, smallest_hashes, text_hash, unused, up_to_hash

BEGINNINGS = (4, 5)  # lengths of word beginnings that are terms too
HASH_BITS = 40
LEAST_ROWS = 3  # rows a feature must occur in
LEAST_Z = 4.0  # how far, in standard errors, its frequencies must differ
FEATURES = 50_000  # the strongest ones at most
COMMON, STRONG = 400, 200  # commonest and strongest terms that are looked at in pairs
PAIR_Z = 6.0  # how far the frequency of a term beside another one must differ between the labels
PAIR_ROWS = 20  # sampled rows of either label that must hold the other one
PAIRED = 40  # terms that become features for their pairs, the strongest ones at most: they are common, and each costs time in the driver
SAMPLE_ROWS = 20_000  # rows the machine is fitted on
FACTORS = 4
EPOCHS = 300
RATE = 0.05
PENALTY = 1e-4

_NOT_WORD = r"[^\p{L}\p{N}]+"


def _hash(kind: str, term: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}{term}".encode("utf-8", "surrogatepass"), 1) >> (64 - HASH_BITS)


def terms_of(word: str) -> list[int]:
    return [_hash("w", word)] + [_hash("b", word[:n]) for n in BEGINNINGS if len(word) > n]


class Terms:
    """Hashed terms of batches of texts; ``known`` keeps only those."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = None if known is None else set(known.tolist())
        self.memory: dict[str, list[int]] = {}

    def of(self, word: str) -> list[int]:
        found = self.memory.get(word)
        if found is None:
            found = terms_of(word)
            if self.known is not None:
                found = [x for x in found if x in self.known]
            if len(self.memory) > 400_000:
                self.memory.clear()
            self.memory[word] = found
        return found

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) pairs, each once, by row."""
        words = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), _NOT_WORD, " "), " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = [self.of(w) if w else [] for w in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
        if self.known is not None:  # most words have no feature
            used = sizes[index] > 0
            rows, index = rows[used], index[used]
        pairs = np.unique(rows * (len(own) + 1) + index)
        rows, index = pairs // (len(own) + 1), pairs % (len(own) + 1)
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(own) else np.zeros(0, np.int64)
        pool = np.array([x for xs in own for x in xs], np.int64)
        n = sizes[index]
        ends = np.cumsum(n)
        spread = np.repeat(begins[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        rows, terms = np.repeat(rows, n), pool[spread]
        order = np.lexsort((terms, rows))
        rows, terms = rows[order], terms[order]
        first = np.concatenate(([True], (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1]))) if len(rows) else np.zeros(0, bool)
        return rows[first], terms[first]


def _filled(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def term_counts(df: DataFrame, *, text: str, label: str) -> DataFrame:
    """term, ones and zeros: rows of either label that hold it. Counts are added up per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in byte_batches(batches, text):
            rows, found = terms.batch(_filled(batch.column(text)))
            ones = batch.column(label).to_numpy(zero_copy_only=False)[rows] == 1
            unique, at = np.unique(found, return_inverse=True)
            one = np.bincount(at, ones, len(unique)).astype(np.int64)
            all_rows = np.bincount(at, minlength=len(unique)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(one), pa.array(all_rows - one)], names=["term", "ones", "zeros"])

    return df.select(text, label).mapInArrow(run, "term long, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


class Machine:
    """bias + sum of weights + sum over pairs of factor products, through the logistic function."""

    def __init__(self, features: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.features, self.bias, self.weights, self.factors = features, bias, weights, factors

    def sums(self, n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Log odds of ``n`` texts with the given (row, column) pairs."""
        total = np.full(n, self.bias) + np.bincount(rows, self.weights[columns], n)
        for f in self.factors.T:
            x = f[columns]
            total += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return total

    def scores(self, n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(n, rows, columns), -40, 40)))

    def centred(self, n: int, rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Machine:
        """The same order of texts, with 0.5 where the labels are told apart best (largest F1; the middle of equal places).

        Each text stands for ``weights`` texts.
        """
        order = np.argsort(self.sums(n, rows, columns), kind="stable")
        sums, ones, every = self.sums(n, rows, columns)[order], (labels * weights)[order], weights[order]
        found, above = (x[::-1].cumsum()[::-1] for x in (ones, every))  # ones, and all, at or above each place
        f1 = 2 * found / (above + ones.sum())
        f1[1:][sums[1:] == sums[:-1]] = -1  # equal sums cannot be told apart
        at = int(np.argmax(f1))
        if at:
            self.bias -= float(sums[at] + sums[at - 1]) / 2
        return self


def paired(n: int, rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, looked_at: np.ndarray) -> np.ndarray:
    """Those of the columns ``looked_at`` that belong to a pair: among the texts with one of them, the other's frequency differs between the labels."""
    place = np.full(int(max(columns.max(initial=-1), looked_at.max(initial=-1))) + 1, -1)
    place[looked_at] = np.arange(len(looked_at))
    own = place[columns] >= 0
    present = np.zeros((n, len(looked_at)), np.float32)
    present[rows[own], place[columns[own]]] = 1
    with_one, with_zero = present[labels == 1], present[labels == 0]
    ones, zeros = with_one.sum(0)[:, None], with_zero.sum(0)[:, None]
    p, q = (with_one.T @ with_one + 0.5) / (ones + 1), (with_zero.T @ with_zero + 0.5) / (zeros + 1)
    enough = (ones >= PAIR_ROWS) & (zeros >= PAIR_ROWS)
    z = np.abs(p - q) / np.sqrt(np.maximum(p * (1 - p), 1e-9) / np.maximum(ones, 1) + np.maximum(q * (1 - q), 1e-9) / np.maximum(zeros, 1))
    z[~np.broadcast_to(enough, z.shape)] = 0
    # A term that differs as much on its own needs no other one beside it.
    all_ones, all_zeros = max(int((labels == 1).sum()), 1), max(int((labels == 0).sum()), 1)
    a, b = (with_one.sum(0) + 0.5) / (all_ones + 1), (with_zero.sum(0) + 0.5) / (all_zeros + 1)
    alone = np.abs(a - b) / np.sqrt(a * (1 - a) / all_ones + b * (1 - b) / all_zeros)
    np.fill_diagonal(z, 0)
    z[(z < PAIR_Z) | (z <= 2 * alone[None, :])] = 0
    strength = np.maximum(z.max(0, initial=0), z.max(1, initial=0))
    best = np.argsort(-strength, kind="stable")[:PAIRED]
    return looked_at[best[strength[best] > 0]]


def fit(features: np.ndarray, n: int, rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY, seed: int = 7) -> Machine:
    """Full-batch Adam on the logistic loss with squared penalties. ``rows`` and ``columns`` are the features present."""
    rng = np.random.default_rng(seed)
    share = min(max(float(labels.mean()) if n else 0.0, 1e-3), 1 - 1e-3)
    machine = Machine(features, float(np.log(share / (1 - share))), np.zeros(len(features)), rng.normal(0, 0.01, (len(features), factors)))
    if not len(features) or not n:
        return machine
    steps = [np.zeros(1 + len(features) * (1 + factors)) for _ in range(2)]
    for epoch in range(1, epochs + 1):
        error = (machine.scores(n, rows, columns) - labels) / n
        at = error[rows]
        weight = np.bincount(columns, at, len(features)) + penalty * machine.weights
        pairs = np.empty_like(machine.factors)
        for k, f in enumerate(machine.factors.T):
            x = f[columns]
            sums = np.bincount(rows, x, n)
            pairs[:, k] = np.bincount(columns, at * (sums[rows] - x), len(features)) + 10 * penalty * f
        gradient = np.concatenate(([error.sum()], weight, pairs.ravel()))
        steps[0] = 0.9 * steps[0] + 0.1 * gradient
        steps[1] = 0.999 * steps[1] + 0.001 * gradient**2
        move = rate * (steps[0] / (1 - 0.9**epoch)) / (np.sqrt(steps[1] / (1 - 0.999**epoch)) + 1e-8)
        machine.bias -= float(move[0])
        machine.weights = machine.weights - move[1 : 1 + len(features)]
        machine.factors = machine.factors - move[1 + len(features) :].reshape(machine.factors.shape)
    return machine


def train(df: DataFrame, *, text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Machine:
    """A machine learned from the rows of ``df`` whose label is 0 or 1.

    All of them are counted; the machine is fitted on at most ``sample_rows`` distinct texts, those of either label with the
    smallest hashes, and at most ``features`` features. Each label has half of the sample, or what the other leaves; the bias
    is then set right for the labels' numbers of distinct texts. Copies of a text count once, so that a text with very many of
    them does not fill the sample. Without rows of both labels the machine gives the same score to every text.
    """
    rows = df.filter(F.col(label).isin(0, 1)).select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    rows = materialize(rows.withColumn("h", text_hash("text")), "labelled")  # read several times
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        return fit(np.zeros(0, np.int64), ones + zeros, np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(ones + zeros, float(ones > 0)))
    p, q = (F.col("ones") + 0.5) / (ones + 1.0), (F.col("zeros") + 0.5) / (zeros + 1.0)
    z = F.abs(p - q) / F.sqrt(p * (1 - p) / ones + q * (1 - q) / zeros)
    counts = materialize(term_counts(rows, text="text", label="label").filter(F.col("ones") + F.col("zeros") >= LEAST_ROWS).withColumn("z", z), "terms")
    strong = [r["term"] for r in counts.filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(features).collect()]
    common = [r["term"] for r in counts.orderBy(F.desc(F.col("ones") + F.col("zeros")), "term").limit(COMMON).collect()]
    known = np.array(sorted({*strong, *common}), np.int64)
    distinct, last = smallest_hashes(rows, "label", 2, lambda n: _shares(n, sample_rows))
    sample = up_to_hash(rows, "label", last).groupBy("label", "h").agg(F.min("text").alias("text")).select("text", "label")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(known)
        for batch in byte_batches(batches, "text"):
            at, found = terms.batch(_filled(batch.column("text")))
            cuts = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.searchsorted(known, found), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], names=["label", "terms"])

    found = sample.mapInArrow(present, "label int, terms array<int>").toArrow().combine_chunks()
    n = found.num_rows
    labels = found.column("label").to_numpy().astype(float)
    lists = found.column("terms").combine_chunks()
    at = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    columns = lists.flatten().to_numpy()
    looked_at = np.searchsorted(known, np.array(sorted({*strong[:STRONG], *common}), np.int64))
    beside = paired(n, at, columns, labels, looked_at)
    used = np.isin(known, np.array(strong, np.int64))
    used[beside] = True
    chosen = known[used]
    at, columns = at[used[columns]], (np.cumsum(used) - 1)[columns[used[columns]]]
    machine = fit(chosen, n, at, columns, labels)
    drawn = _shares(distinct, sample_rows)
    machine.bias += float(np.log(distinct[1] / distinct[0]) - np.log(drawn[1] / drawn[0]))
    weights = np.where(labels == 1, distinct[1] / drawn[1], distinct[0] / drawn[0])
    return machine.centred(n, at, columns, labels, weights)


def _shares(distinct: dict[int, int], rows: int) -> dict[int, int]:
    """How many of ``rows`` texts are of either label: half of them, and what the other label does not fill."""
    ones = min(distinct[1], max(rows // 2, rows - distinct[0]))
    return {1: ones, 0: min(distinct[0], rows - ones)}


def scored(column: str, machine: Machine) -> Column:
    """The score of a whole text, null as empty."""
    holder: list[Terms] = []

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if not holder:
            holder.append(Terms(machine.features))
        out = []
        # Portions, so that the words of few texts are held at once.
        for at in range(0, len(texts), 2_000):
            part = pa.array(texts.iloc[at : at + 2_000], pa.string())
            rows, terms = holder[0].batch(part)
            out.append(machine.scores(len(part), rows, np.searchsorted(machine.features, terms)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return of(F.coalesce(F.col(column), F.lit("")))


def score(df: DataFrame, machine: Machine, *, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from 0.5 on), which replace columns of those names.

    Null and empty texts get the bias's score; repeated rows are scored each; an empty table gives an empty one.
    """
    own = unused(df, "__score")
    found = df.withColumn(own, scored(text, machine)).drop("score", "predicted")
    return found.withColumnRenamed(own, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
