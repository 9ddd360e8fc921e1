"""Seeded samplers that choose rows to send for labelling.

Every sampler takes a DataFrame with a unique ``key`` and returns at most ``n`` of its rows. The random order is a hash
of seed and key, so the choice does not depend on how the data is partitioned or on retried tasks. Repeated calls with
one seed give the same rows; pass another seed for another draw. ``n <= 0`` gives no rows.

A sampler is any function ``(DataFrame, n) -> DataFrame``; combine several with :func:`combine`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import order_key
from ..session import materialize

Sampler = Callable[[DataFrame, int], DataFrame]


def _check_column(df: DataFrame, column: str, what: str) -> None:
    if column not in df.columns:
        raise KeyError(f"no column {column!r} for {what}; there are {', '.join(df.columns)}")


# Keys that may be ranked by one sort; the range with the cut is narrowed until it holds no more.
RANKED = 100_000
# Keys drawn for the borders of a histogram, and its borders.
DRAWN, BORDERS = 4_000, 24
# Rounds without progress after which a range of equal keys is ranked as it is.
PATIENCE = 4
# Keywords that are looked for one by one; the first bytes by which more of them are found; bytes of text looked at together.
FEW_KEYWORDS = 24
FIRST_BYTES = 4
CHUNK_BYTES = 4 << 20


def _literal(schema: StructType, values) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(schema.fields, values)])


def cut_key(df: DataFrame, n: int, *order: Column | str) -> Column | None:
    """The ``n``-th smallest key of ``df`` in ``order``, as a literal struct; None if there are no more than ``n`` rows.

    Each round counts the rows up to some borders in one aggregation, without a shuffle of rows: the borders lie around the
    wanted rank in a small random draw of the keys that are still in question. Only the order's columns are read. What is left
    in the end, at most ``RANKED`` keys, is sorted. The count is exact, so the draw only decides how many rounds it takes.
    """
    keys = df.select(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]).alias("k"))
    schema = keys.schema["k"].dataType
    wanted, total, stuck = n, keys.count(), 0
    if total <= n:
        return None
    while total > RANKED and stuck < PATIENCE:
        drawn = [r["k"] for r in keys.sample(min(1.0, DRAWN / total), seed=stuck).orderBy("k").limit(4 * DRAWN).collect()]
        middle, step = wanted / total * len(drawn), max(1.0, len(drawn) ** 0.5 / 4)
        places = {round(middle + step * (i - BORDERS / 2)) for i in range(BORDERS)} | {0, len(drawn) - 1}
        borders = [drawn[i] for i in sorted(places) if 0 <= i < len(drawn)]
        if not borders:
            stuck += 1
            continue
        counts = keys.agg(*[F.count_if(F.col("k") <= _literal(schema, x)).alias(f"c{i}") for i, x in enumerate(borders)]).first()
        before = [(c, x) for c, x in zip(counts, borders) if c < wanted]
        behind = [(c, x) for c, x in zip(counts, borders) if c >= wanted]
        low, high = before[-1] if before else (0, None), behind[0] if behind else (total, None)
        if low[1] is not None:
            keys = keys.where(F.col("k") > _literal(schema, low[1]))
        if high[1] is not None:
            keys = keys.where(F.col("k") <= _literal(schema, high[1]))
        stuck = stuck + 1 if high[0] - low[0] == total else 0
        wanted, total = wanted - low[0], high[0] - low[0]
    return _literal(schema, keys.orderBy("k").limit(wanted).agg(F.max("k").alias("k")).first()["k"])


def first_by(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in ``order``, in no particular order; the keys must tell all rows apart.

    A filter on :func:`cut_key`: no row is moved or written, whatever the sample's size.
    """
    n = max(n, 0)
    if n == 0:
        return df.limit(0)
    cut = cut_key(df, n, *order)
    if cut is None:
        return df
    return df.where(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]) <= cut)


def random_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniformly without replacement."""
    return first_by(df, n, order_key(seed, key), key)


def normalize_keywords(keywords: Iterable[str]) -> list[str]:
    """Trimmed, lower-cased keywords without blanks."""
    return [k.strip().lower() for k in keywords if k.strip()]


def _occurring(wanted: list[str]):
    """Per text: how many of ``wanted`` occur in it, however many they are, in one pass over the bytes of each batch.

    A keyword is looked up by its first bytes: the places where those of any keyword stand are found at once, and only there
    are the rest of the keywords compared.
    """
    repeats = Counter(k.encode() for k in wanted)
    sizes = sorted({min(len(k), FIRST_BYTES) for k in repeats})
    # Per number of first bytes: these, sorted, with the keywords that are no longer, and the longer ones by length.
    begins = {g: sorted({int.from_bytes(k[:g], "little") for k in repeats if min(len(k), FIRST_BYTES) == g}) for g in sizes}
    whole = {g: np.array([repeats.get(c.to_bytes(g, "little"), 0) for c in begins[g]]) for g in sizes}
    longer: dict[int, dict[int, set[bytes]]] = {}
    for k in repeats:
        if len(k) > FIRST_BYTES:
            longer.setdefault(int.from_bytes(k[:FIRST_BYTES], "little"), {}).setdefault(len(k), set()).add(k)
    tables = {}
    for g in sizes:
        begins[g] = np.array(begins[g], np.uint32)
        tables[g] = np.zeros(1 << 16, bool)
        tables[g][(begins[g] * np.uint32(2654435761)) >> np.uint32(16)] = True

    def count(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The counts for texts that lie one behind the other in ``data``, each up to its end."""
        score = np.zeros(len(ends), np.int64)
        raw = data.tobytes()
        for g in sizes:
            if len(data) < g:
                continue
            code = np.zeros(len(data) - g + 1, np.uint32)
            for i in range(g):
                code |= data[i : len(data) - g + 1 + i].astype(np.uint32) << np.uint32(8 * i)
            at = np.flatnonzero(tables[g][(code * np.uint32(2654435761)) >> np.uint32(16)])
            which = np.minimum(np.searchsorted(begins[g], code[at]), len(begins[g]) - 1)
            row = np.searchsorted(ends, at, "right")
            real = (begins[g][which] == code[at]) & (at + g <= ends[row])
            at, which, row = at[real], which[real], row[real]
            pairs = np.unique(row * len(begins[g]) + which)
            np.add.at(score, pairs // len(begins[g]), whole[g][pairs % len(begins[g])])
            if g == FIRST_BYTES and longer:
                rest = np.isin(begins[g][which], np.array(list(longer), np.uint32))
                found = set()
                for i, r, c in zip(at[rest].tolist(), row[rest].tolist(), begins[g][which[rest]].tolist()):
                    for n, some in longer[c].items():
                        word = raw[i : i + n]
                        if word in some and i + n <= ends[r]:
                            found.add((r, word))
                for r, word in found:
                    score[r] += repeats[word]
        return score

    def run(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        score, first = np.zeros(len(texts), np.int64), 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            score[first:last] = count(data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first])
            first = last
        return pa.array(score, pa.int32())

    return run


def keyword_score(text: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords occur in the text, ignoring case; 0 for a missing text. The list may be long.

    Up to ``FEW_KEYWORDS`` are looked for one by one; more of them cost one pass over the text together.
    """
    wanted = normalize_keywords(keywords)
    if not wanted:
        return F.lit(0)
    if len(wanted) > FEW_KEYWORDS:
        return F.arrow_udf(_occurring(wanted), "int")(F.lower(text))
    found = F.transform(F.array(F.lower(text)), lambda t: F.size(F.filter(F.lit(wanted), lambda k: F.contains(t, k))))
    return F.when(text.isNotNull(), found[0]).otherwise(0)


def keyword_sample(
    df: DataFrame,
    n: int,
    key: str,
    keywords: Iterable[str] = (),
    text_column: str = "text",
    add_score_column: bool = True,
    seed: int = 0,
) -> DataFrame:
    """Random rows among those with a keyword first, then random rows among the rest."""
    wanted = normalize_keywords(keywords)
    if not wanted:
        return random_sample(df, n, key, seed)
    n = max(n, 0)
    if n == 0:
        return df.limit(0)
    _check_column(df, text_column, "text_column")
    is_text = dict(df.dtypes)[text_column] == "string"
    score = keyword_score(F.col(text_column), wanted) if is_text else F.lit(0)
    scored = df.withColumn("keyword_score", score)
    tier = F.when(F.col("keyword_score") > 0, 0).otherwise(1)
    sample = first_by(scored, n, tier, order_key(seed, key), key)
    return sample if add_score_column else sample.drop("keyword_score")


def stratified_sample(
    df: DataFrame, n: int, key: str, label_column: str = "label", min_per_label: int = 1, seed: int = 0
) -> DataFrame:
    """Up to ``min_per_label`` random rows per label in label order, then random rows of any label up to ``n``.

    Rows without a label are never chosen. The second step draws from what is left in a random order of its own, so
    each label's share follows its number of left-over rows. What is written and ranked are keys and labels.
    """
    _check_column(df, label_column, "label_column")
    n = max(n, 0)
    if n == 0:
        return df.limit(0)
    least = max(min_per_label, 0)
    pool = df.where(F.col(label_column).isNotNull())
    within = Window.partitionBy(label_column).orderBy(order_key(seed, key), key)
    # Only the first keys of a label leave a task; no other column does.
    ranked = pool.select(F.col(key).alias("__key"), F.col(label_column).alias("__label"), F.row_number().over(within).alias("__rank"))
    base = first_by(materialize(ranked.where(F.col("__rank") <= least), "stratified"), n, "__label", "__rank")
    left = n - base.count()
    chosen = pool.join(base.select("__key"), F.col(key) == F.col("__key"), "left_semi")
    if not left:
        return chosen
    rest = pool.join(base.select("__key"), F.col(key) == F.col("__key"), "left_anti")
    draw = order_key(f"{seed}:fill", key)
    cut = cut_key(rest.select(key), left, draw, key)
    if cut is None:
        return pool
    drawn = F.struct(draw.alias("o0"), F.col(key).alias("o1")) <= cut
    # Rows of the first step that the second would draw too come by the filter alone.
    return pool.where(drawn).unionByName(chosen.where(~drawn))


def cluster_diverse_sample(
    df: DataFrame, n: int, key: str, cluster_column: str = "cluster_id", max_per_cluster: int = 10, seed: int = 0
) -> DataFrame:
    """Rounds over the clusters in random order, one random row per cluster and round.

    A cluster gives at most ``max(1, max_per_cluster)`` rows; rows without a cluster are never chosen. ``row_number()``
    below the cap turns into a group limit before the shuffle, so a huge cluster sends only its first keys.
    """
    _check_column(df, cluster_column, "cluster_column")
    within = Window.partitionBy(cluster_column).orderBy(order_key(seed, key), key)
    ranked = df.where(F.col(cluster_column).isNotNull()).select(F.col(key).alias("__key"), F.col(cluster_column).alias("__cluster"), F.row_number().over(within).alias("__round"))
    rounds = materialize(ranked.where(F.col("__round") <= max(1, max_per_cluster)), "clusters")
    chosen = first_by(rounds, n, "__round", order_key(seed, "__cluster"), "__cluster").select("__key")
    return df.join(chosen, F.col(key) == F.col("__key"), "left_semi")


def combine(df: DataFrame, key: str, *samples: DataFrame) -> DataFrame:
    """The rows of ``df`` that occur in any of the samples, each once."""
    chosen = reduce(DataFrame.unionByName, [s.select(key) for s in samples]).distinct()
    return df.join(chosen, key, "left_semi")
