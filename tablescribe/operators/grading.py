"""Grades of descriptions, relevance judgements, and the summary of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import METRICS, grade_columns, relevance_score
from ..sources.records import last_by_key

# Shortest text worth grading, the grading scale and the methods of the summary.
MIN_TEXT_CHARS = 5
SCALE = 5.0
GRADED_METHODS = ["original", "ufd", "sfd", "ufd_nyc", "sfd_nyc"]


def description_variants(records: DataFrame, methods: dict[str, str]) -> DataFrame:
    """``dataset_id, method, text`` for every text variant that is long enough to grade.

    ``methods`` maps a method to its text column; all other columns are kept.
    """
    texts = list(methods.values())
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("text")) for m, c in methods.items()])
    rest = [c for c in records.columns if c not in texts]
    long_form = records.select(*rest, F.explode(entries).alias("v")).select(*rest, "v.*")
    return long_form.where(F.length("text") >= MIN_TEXT_CHARS)


def _latest(df: DataFrame, key: str) -> DataFrame:
    return last_by_key(df, key, "ord") if "ord" in df.columns else df


def join_variants(ids: DataFrame, registry: DataFrame, baseline: DataFrame, domain: DataFrame | None = None) -> DataFrame:
    """All text variants per dataset: the original from the registry, the others from two description tables.

    Without a ``domain`` table its two methods are NULL and therefore skipped. Tables with an ``ord`` column may repeat
    an id; the last row counts.
    """
    registry = _latest(registry, "id")
    baseline = _latest(baseline, "dataset_id")
    domain = None if domain is None else _latest(domain, "dataset_id")
    ids = ids.dropDuplicates(["dataset_id"])
    original = registry.select(F.col("id").alias("dataset_id"), F.col("name").alias("title"), "columns", F.col("description").alias("original"))
    joined = ids.join(original, "dataset_id", "left").join(baseline.select("dataset_id", "ufd", "sfd"), "dataset_id", "left")
    if domain is None:
        return joined.withColumns({"ufd_nyc": F.lit(None).cast("string"), "sfd_nyc": F.lit(None).cast("string")})
    return joined.join(domain.select("dataset_id", "ufd_nyc", "sfd_nyc"), "dataset_id", "left")


def judgement_pairs(datasets: DataFrame, queries: DataFrame) -> DataFrame:
    """Every chosen dataset with every query: the input of a relevance judge.

    All pairs are what a judge is asked for, so this is a join without a condition on the chosen datasets; the optimizer
    sends the smaller side to all tasks if it is small enough.
    """
    asked = queries.select("query_id", F.col("text").alias("query"))
    return datasets.join(asked, how="cross")


def relevance_from_replies(replies: DataFrame) -> DataFrame:
    """``query_id, dataset_id, rel`` from judge replies."""
    return replies.select("query_id", "dataset_id", relevance_score(F.col("reply")).alias("rel"))


def grades_long(replies: DataFrame) -> DataFrame:
    """``dataset_id, method, metric, score`` from grade replies; unreadable replies and null scores give no rows."""
    graded = replies.select("dataset_id", "method", grade_columns(F.col("reply")).alias("g")).where(F.col("g").isNotNull())
    wide = graded.select("dataset_id", "method", "g.*")
    return wide.unpivot(["dataset_id", "method"], METRICS, "metric", "score").where(F.col("score").isNotNull())


def mean_grades(grades: DataFrame, methods: list[str] = GRADED_METHODS) -> DataFrame:
    """``method, metric, score``: mean per method and metric; a pair without any grade counts 0."""
    spark = grades.sparkSession
    wanted = spark.createDataFrame([(m, k) for m in methods for k in METRICS], "method string, metric string")
    means = grades.groupBy("method", "metric").agg(F.avg("score").alias("score"))
    return wanted.join(means, ["method", "metric"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def method_summary(ndcg: DataFrame, grades: DataFrame, methods: list[str] = GRADED_METHODS) -> DataFrame:
    """One row per method: search quality and the four grades on a 0..1 scale, the first value repeated at the end.

    ``ndcg``: ``method, k, ndcg`` (k = 10, or k = 20 where that is 0); ``grades``: ``method, metric, score``. Methods
    with neither search quality nor readability are left out.
    """
    wanted = grades.sparkSession.createDataFrame([(m, i) for i, m in enumerate(methods)], "method string, pos int")

    def at(k: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("k") == k, F.col("ndcg"))), F.lit(0.0))

    search = ndcg.groupBy("method").agg(at(10).alias("at10"), at(20).alias("at20"))
    search = search.select("method", F.when(F.col("at10") == 0, F.col("at20")).otherwise(F.col("at10")).alias("ndcg"))
    alias = F.when(F.col("method") == "HandS", "hs").otherwise(F.col("method"))
    rated = (
        grades.withColumn("direct", F.col("method") != "HandS")
        .withColumn("method", alias)
        .groupBy("method")
        .pivot("metric", METRICS)
        .agg(F.max_by("score", "direct"))
    )
    joined = wanted.join(search, "method", "left").join(rated, "method", "left")
    scaled = [(F.coalesce(m, F.lit(0.0)) / SCALE).alias(m) for m in METRICS]
    table = joined.select("pos", "method", F.coalesce("ndcg", F.lit(0.0)).alias("ndcg"), *scaled)
    kept = table.where(~((F.col("ndcg") == 0) & (F.col("readability") == 0)))
    return kept.withColumn("closing", F.col("ndcg"))
