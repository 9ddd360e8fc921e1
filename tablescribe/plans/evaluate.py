"""How good are the descriptions: search quality, judged relevance, grades and the summary of methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, grading, ranking
from ..operators.generate import Backend, generate
from ..session import materialize
from ..sources.records import last_by_key
from . import prompts

# The ranked text variants and their record columns.
RANKED_METHODS = {
    "hs": "HandS",
    "ufd": "ufd",
    "sfd": "sfd",
    "ufd_nyc": "ufd_nyc",
    "sfd_nyc": "sfd_nyc",
    "original": "original",
}


def search_quality(
    descriptions: DataFrame,
    registry: DataFrame,
    queries: DataFrame,
    relevance: DataFrame,
    methods: dict[str, str] = RANKED_METHODS,
    ks: tuple[int, ...] = (10, 20),
) -> DataFrame:
    """``method, k, ndcg`` for every text variant of the description records (with ``dataset_id`` and ``ord``)."""
    latest = last_by_key(descriptions, "dataset_id", "ord")
    originals = registry.groupBy(F.col("id").alias("dataset_id")).agg(F.max_by("description", "ord").alias("original"))
    texts = ranking.method_texts(latest.join(originals, "dataset_id", "left"), methods)
    return ranking.mean_ndcg(texts, queries, relevance, list(methods), ks)


def search_results(quality: DataFrame) -> DataFrame:
    """NDCG rows as ``method, metric, value`` with metrics named ``bm25@k``."""
    return quality.select("method", F.concat(F.lit("bm25@"), F.col("k")).alias("metric"), F.col("ndcg").alias("value"))


def judge_relevance(
    registry: DataFrame,
    queries: DataFrame,
    make_backend: Callable[[], Backend],
    template: str,
    n_datasets: int = 50,
    seed: int = 42,
    concurrency: int = 5,
) -> DataFrame:
    """``query_id, dataset_id, rel`` for a reproducible choice of datasets and every query."""
    pairs = relevance_prompts(catalog.choose_datasets(registry, n_datasets, seed), queries, template)
    replies = materialize(generate(pairs, make_backend, ["dataset_id", "query_id"], 0.0, concurrency), "judgements")
    return grading.relevance_from_replies(replies)


def relevance_prompts(chosen: DataFrame, queries: DataFrame, template: str) -> DataFrame:
    """``dataset_id, query_id, prompt`` for every chosen registry entry and query."""
    pairs = grading.judgement_pairs(chosen, queries)
    prompt = prompts.relevance_prompt(*[F.col(c) for c in ("query", "name", "category", "agency", "columns", "description")], template)
    return pairs.select(F.col("id").alias("dataset_id"), "query_id", prompt.alias("prompt"))


def grade_texts(
    ids: DataFrame,
    registry: DataFrame,
    baseline: DataFrame,
    domain: DataFrame | None,
    make_backend: Callable[[], Backend],
    template: str,
    concurrency: int = 5,
    min_interval: float = 0.0,
) -> DataFrame:
    """``dataset_id, method, metric, score`` for all text variants of the given datasets."""
    joined = grading.join_variants(ids, registry, baseline, domain)
    variants = grading.description_variants(joined, {m: m for m in grading.GRADED_METHODS})
    asked = variants.withColumn("prompt", prompts.grade_prompt(F.col("title"), F.col("columns"), F.col("text"), template))
    replies = generate(asked, make_backend, ["dataset_id", "method"], 0.0, concurrency, min_interval)
    return grading.grades_long(materialize(replies, "grades"))
