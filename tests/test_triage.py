"""Samplers: sizes, membership, caps, order and independence from partitioning."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tablescribe.functions.keys import order_key
from tablescribe.operators import triage as T


@pytest.fixture(scope="module")
def pool(spark):
    rows = []
    for i in range(300):
        label = None if i % 17 == 0 else "abc"[min(2, i % 7 // 2)]
        rows.append((i, label, None if i % 31 == 0 else i % 5, f"Row {i} {'Oak tree' if i % 9 == 0 else 'stone'}" if i % 13 else None))
    return spark.createDataFrame(rows, "id bigint, label string, cluster_id int, text string").cache()


SAMPLERS = {
    "random": lambda df, n, seed=1: T.random_sample(df, n, "id", seed),
    "keyword": lambda df, n, seed=1: T.keyword_sample(df, n, "id", ["oak", " TREE "], seed=seed, add_score_column=False),
    "stratified": lambda df, n, seed=1: T.stratified_sample(df, n, "id", "label", 4, seed),
    "cluster": lambda df, n, seed=1: T.cluster_diverse_sample(df, n, "id", "cluster_id", 1000, seed),
}
ELIGIBLE = {
    "random": lambda r: True,
    "keyword": lambda r: True,
    "stratified": lambda r: r.label is not None,
    "cluster": lambda r: r.cluster_id is not None,
}


@pytest.mark.parametrize("name", SAMPLERS)
def test_contract(pool, name):
    sample, everything = SAMPLERS[name], {r.id for r in pool.collect() if ELIGIBLE[name](r)}
    for n in (-3, 0, 1, 40, 10_000):
        got = [r.id for r in sample(pool, n).collect()]
        assert len(got) == len(set(got)) == min(max(n, 0), len(everything))
        assert set(got) <= everything
    assert sample(pool, 5).columns == pool.columns
    assert sample(pool.limit(0), 5).count() == 0
    first = {r.id for r in sample(pool.repartition(1), 60).collect()}
    assert first == {r.id for r in sample(pool.repartition(17), 60).collect()}
    assert first != {r.id for r in sample(pool, 60, seed=2).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 320), st.integers(0, 5))
def test_ranges_equal_a_sort(pool, n, seed):
    hashed = order_key(seed, "id")
    want = {r.id for r in pool.orderBy(hashed, "id").limit(n).collect()}
    assert want == {r.id for r in T.first_by(pool, n, hashed, "id").collect()}


def test_many_keywords(pool):
    many = [f"absent{i}" for i in range(1000)] + ["oak"]
    got = pool.select(T.keyword_score(F.col("text"), many).alias("s")).groupBy("s").count().collect()
    assert {r.s for r in got} == {0, 1}


def test_keyword_rows_come_first(pool):
    matching = {r.id for r in pool.collect() if r.text and "oak" in r.text.lower()}
    few = T.keyword_sample(pool, 10, "id", ["oak"]).collect()
    assert {r.id for r in few} <= matching and all(r.keyword_score == 1 for r in few)
    many = T.keyword_sample(pool, 100, "id", ["oak", "tree"]).collect()
    assert matching <= {r.id for r in many}
    assert Counter(r.keyword_score for r in many) == {2: len(matching), 0: 100 - len(matching)}


def test_without_keywords_it_is_random(pool):
    got = T.keyword_sample(pool, 20, "id", ["  "], "no_such_column", seed=4)
    assert got.columns == pool.columns
    assert {r.id for r in got.collect()} == {r.id for r in T.random_sample(pool, 20, "id", 4).collect()}
    assert T.keyword_sample(pool, 0, "id", ["x"], "no_such_column").count() == 0


def test_a_column_that_is_no_text_scores_nothing(pool):
    got = T.keyword_sample(pool, 5, "id", ["1"], "cluster_id").collect()
    assert {r.keyword_score for r in got} == {0}


def test_unknown_columns_name_the_available_ones(pool):
    for call in (
        lambda: T.keyword_sample(pool, 5, "id", ["x"], "nope"),
        lambda: T.stratified_sample(pool, 5, "id", "nope"),
        lambda: T.cluster_diverse_sample(pool, 5, "id", "nope"),
    ):
        with pytest.raises(KeyError, match="nope.*label.*cluster_id"):
            call()


def test_strata_get_their_minimum_in_label_order(pool):
    counts = Counter(r.label for r in T.stratified_sample(pool, 30, "id", "label", 5).collect())
    assert sum(counts.values()) == 30 and min(counts[c] for c in "abc") >= 5
    short = Counter(r.label for r in T.stratified_sample(pool, 7, "id", "label", 5).collect())
    assert short == {"a": 5, "b": 2}


def test_fill_follows_the_label_shares(spark):
    pool = spark.range(2000).selectExpr("id", "CASE WHEN id < 1800 THEN 'big' ELSE 'small' END AS label")
    got = Counter(r.label for r in T.stratified_sample(pool, 500, "id", "label", 1, 3).collect())
    assert 420 <= got["big"] <= 475


def test_cluster_caps(spark):
    sizes = {1: 1, 2: 2, 3: 10}
    rows = [(100 * c + i, c) for c, size in sizes.items() for i in range(size)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id bigint, cluster_id int")
    assert Counter(r.cluster_id for r in T.cluster_diverse_sample(df, 100, "id", max_per_cluster=3).collect()) == {1: 1, 2: 2, 3: 3}
    assert T.cluster_diverse_sample(df, 100, "id", max_per_cluster=0).count() == 3
    assert T.cluster_diverse_sample(df.where("cluster_id IS NULL"), 5, "id").count() == 0
    assert len({r.cluster_id for r in T.cluster_diverse_sample(df, 3, "id").collect()}) == 3


def test_combine(pool):
    a, b = T.random_sample(pool, 30, "id", 1), T.random_sample(pool, 30, "id", 2)
    want = {r.id for r in a.collect()} | {r.id for r in b.collect()}
    got = [r.id for r in T.combine(pool, "id", a, b).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("n", [1, 7, 4_000, 9_990, 9_999, 10_000, 20_000])
def test_rounds_of_counts_equal_a_sort(spark, monkeypatch, n):
    monkeypatch.setattr(T, "RANKED", 50)
    monkeypatch.setattr(T, "DRAWN", 300)
    df = spark.range(10_000).select("id", (F.col("id") % 3).alias("tier"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("name"))
    order = ("tier", "name", order_key(3, "id"), "id")
    want = [r.id for r in df.orderBy(*order).limit(n).collect()]
    assert sorted(want) == sorted(r.id for r in T.first_by(df, n, *order).collect())


def test_equal_keys_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(T, "RANKED", 50)
    same = spark.range(500).select(F.lit(1).alias("k"), "id")
    assert T.first_by(same, 100, "k").count() == 500  # the keys do not tell rows apart
    assert T.first_by(same, 100, "k", "id").count() == 100


def _folder_bytes(path):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_what_is_written_does_not_depend_on_the_rows_width(spark):
    from tablescribe.session import run_dir

    folder = run_dir(spark).removeprefix("file:")
    df = spark.range(3_000).select("id", (F.col("id") % 7).cast("string").alias("label"), (F.col("id") % 11).alias("cluster_id"), F.lit("x").alias("text"))
    wide = df.withColumn("payload", F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.md5(F.concat_ws(":", "id", i)))))
    for name, sample in SAMPLERS.items():
        before = _folder_bytes(folder)
        sample(df, 100).count()
        narrow = _folder_bytes(folder) - before
        assert sample(wide, 100).count() == 100
        assert _folder_bytes(folder) - before - narrow <= narrow + 2_000, name
        assert narrow == 0 or name in ("stratified", "cluster")
