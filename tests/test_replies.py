"""Reply parsers, grades and the summary of methods."""

import pytest
from pyspark.sql import functions as F

from tablescribe.functions import parsing
from tablescribe.operators import grading, runlog, semantic

CLEAN = '{"columns": [{"name": "a", "semantic": {"is_temporal": true, "entity_type": "x"}}]}'


def replies(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "dataset_id string, reply string")


def test_semantic_replies(spark):
    df = replies(
        spark,
        clean=CLEAN,
        wrapped=f"Sure, here:\n```json\n{CLEAN}\n``` done",
        commas='{"columns": [{"name": "a", "semantic": {"is_temporal": true, "entity_type": "x",},},], }',
        prose="no braces at all",
        half='{"columns": [',
        twice='{"columns": [{"name": "a", "semantic": {"entity_type": "1"}}, {"name": "a", "semantic": {"entity_type": "2"}}]}',
        nameless='{"columns": [{"semantic": {"entity_type": "1"}}, {"name": "", "semantic": {}}]}',
        bare='{"columns": [{"name": "a"}]}',
        odd='{"columns": 7}',
        empty="",
        none=None,
    )
    got = {r.dataset_id: r for r in parsing.semantic_columns(df).collect()}
    assert set(got) == {"clean", "wrapped", "commas", "twice", "bare"}
    for name in ("clean", "wrapped", "commas"):
        assert (got[name].semantic.is_temporal, got[name].semantic.entity_type) == (True, "x")
    assert got["twice"].semantic.entity_type == "2"
    assert got["bare"].semantic.entity_type is None


def test_semantic_join(spark):
    profile = spark.createDataFrame(
        [("d", 0, "a", "text", ["x"]), ("d", 1, "b", "numeric", ["1"])],
        "dataset_id string, col_idx int, name string, coarse_type string, example_values array<string>",
    )
    rows = {r.name: r for r in semantic.semantic_profile(profile, replies(spark, d=CLEAN)).collect()}
    assert rows["a"].semantic_profiled and rows["a"].semantic.skipped_for_quota is None
    b = rows["b"].semantic
    assert not rows["b"].semantic_profiled and b.skipped_for_quota
    assert (b.is_temporal, b.entity_type, b.domain_specific_type) == (False, "unknown", "general")
    nested = semantic.nest_semantic(semantic.semantic_profile(profile, replies(spark, d=CLEAN))).first()
    assert [c.name for c in nested.columns] == ["a", "b"]


def test_grade_replies(spark):
    full = '{"readability": 4, "faithfulness": 5, "completeness": 2.5, "conciseness": "1"}'
    df = replies(
        spark, full=full, wrapped=f"ok {full} end", lacking='{"readability": 1}', empty="{}", garbage="good", number="5",
        null='{"readability": null, "faithfulness": 4, "completeness": 4, "conciseness": "high"}', nothing=None,
    )
    got = {r.dataset_id: r.g for r in df.select("dataset_id", parsing.grade_columns(F.col("reply")).alias("g")).collect()}
    assert tuple(got["full"]) == tuple(got["wrapped"]) == (4.0, 5.0, 2.5, 1.0)
    assert tuple(got["lacking"]) == (1.0, 3.0, 3.0, 3.0)
    assert tuple(got["null"]) == (None, 4.0, 4.0, None)
    assert [got[k] for k in ("empty", "garbage", "number", "nothing")] == [None] * 4
    long = grading.grades_long(df.withColumn("method", F.lit("ufd")))
    means = {(r.method, r.metric): r.score for r in grading.mean_grades(long, ["ufd", "sfd"]).collect()}
    assert means["ufd", "readability"] == 3.0 and means["ufd", "faithfulness"] == pytest.approx(17 / 4)
    assert means["sfd", "readability"] == 0.0 and len(means) == 8


def test_relevance_replies(spark):
    df = replies(spark, a="2", b="Score: 1", c="none", d="", e=None, f="x9 0 2")
    got = {r.dataset_id: r.rel for r in df.select("dataset_id", parsing.relevance_score(F.col("reply")).alias("rel")).collect()}
    assert got == {"a": 2, "b": 1, "c": 0, "d": 0, "e": 0, "f": 0}


# Published figures: NDCG at 10 and 20, four mean grades, and the resulting summary.
NDCG = {
    "hs": (0.3919, 0.4427), "ufd": (0.5096, 0.5330), "sfd": (0.6073, 0.6354),
    "ufd_nyc": (0.5599, 0.5921), "sfd_nyc": (0.5252, 0.5668), "original": (0.3971, 0.4260),
}
GRADES = {
    "original": (4.45, 4.85, 2.75, 4.20), "ufd": (4.65, 4.80, 2.95, 4.45), "sfd": (5.00, 4.80, 2.95, 4.95),
    "ufd_nyc": (5.00, 4.75, 2.95, 4.05), "sfd_nyc": (4.80, 4.80, 3.05, 4.50),
}
SUMMARY = {
    "original": (0.3971, 0.89, 0.97, 0.55, 0.84), "ufd": (0.5096, 0.93, 0.96, 0.59, 0.89), "sfd": (0.6073, 1.0, 0.96, 0.59, 0.99),
    "ufd_nyc": (0.5599, 1.0, 0.95, 0.59, 0.81), "sfd_nyc": (0.5252, 0.96, 0.96, 0.61, 0.90),
}


def tables(spark, ndcg, grades):
    search = spark.createDataFrame([(m, k, v) for m, pair in ndcg.items() for k, v in zip((10, 20), pair)], "method string, k int, ndcg double")
    rated = spark.createDataFrame([(m, k, v) for m, four in grades.items() for k, v in zip(parsing.METRICS, four)], "method string, metric string, score double")
    return search, rated


def test_summary_of_published_figures(spark):
    rows = grading.method_summary(*tables(spark, NDCG, GRADES)).orderBy("pos").collect()
    assert [r.method for r in rows] == list(SUMMARY)
    for r in rows:
        assert (r.ndcg, *[r[m] for m in parsing.METRICS]) == pytest.approx(SUMMARY[r.method], abs=1e-9)
        assert r.closing == r.ndcg


def test_summary_fallbacks(spark):
    ndcg = {"a": (0.0, 0.3), "b": (0.0, 0.0), "c": (0.0, 0.0), "hs": (0.2, 0.2)}
    search, rated = tables(spark, ndcg, {"c": (5.0, 5.0, 5.0, 5.0), "HandS": (4.0, 3.0, 2.0, 1.0), "d": (1.0, 1.0, 1.0, 1.0)})
    rows = {r.method: r for r in grading.method_summary(search, rated, ["a", "b", "c", "hs", "e"]).collect()}
    assert set(rows) == {"a", "c", "hs"}
    assert rows["a"].ndcg == 0.3 and rows["c"].readability == 1.0 and rows["hs"].readability == 0.8


def test_throughput_figures(spark):
    runs = spark.createDataFrame([(50, 264.0564239025116), (0, 5.0), (5, 0.0)], "n bigint, s double")
    rates = [r.x for r in runs.select(runlog.throughput_per_hour(F.col("n"), F.col("s")).alias("x")).collect()]
    assert rates == [pytest.approx(681.6724900677106), 0.0, 0.0]


def test_pairs(spark):
    datasets = spark.createDataFrame([(str(i), i) for i in range(40)], "id string, n int")
    queries = spark.createDataFrame([(f"query_{i}", f"text '{i}'") for i in range(25)], "query_id string, text string")
    pairs = [(r.id, r.query_id, r["query"]) for r in grading.judgement_pairs(datasets, queries).collect()]
    assert len(pairs) == len(set(pairs)) == 1000 and ("7", "query_3", "text '3'") in pairs
    assert grading.judgement_pairs(datasets, queries.limit(0)).count() == 0


def test_last_record_wins(spark):
    ids = spark.createDataFrame([("a",), ("a",), ("b",)], "dataset_id string")
    registry = spark.createDataFrame([("a", "old", ["x"], "d", 0), ("a", "new", ["y"], "e", 1)], "id string, name string, columns array<string>, description string, ord int")
    baseline = spark.createDataFrame([("a", "u1", "s1", 0), ("a", "u2", None, 3)], "dataset_id string, ufd string, sfd string, ord int")
    domain = spark.createDataFrame([("a", "n1", "m1", 5), ("a", "n0", "m0", 2)], "dataset_id string, ufd_nyc string, sfd_nyc string, ord int")
    rows = {r.dataset_id: r for r in grading.join_variants(ids, registry, baseline, domain).collect()}
    assert len(rows) == 2 and rows["b"].title is None
    assert (rows["a"].title, rows["a"].original, rows["a"].ufd, rows["a"].sfd, rows["a"].ufd_nyc) == ("new", "e", "u2", None, "n1")
