"""Which datasets to work on: catalog selection, resume, topics and default metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import order_key
from ..sources.records import last_by_key
from .triage import first_by

# What stands in for missing metadata in each place.
UNKNOWN_TOPIC = "Unknown dataset"
UNKNOWN_TITLE = "Unknown"
DOMAIN_AGENCY = "NYC Agency"
DOMAIN_CATEGORY = "General"
ENTRY_CATEGORY = "Uncategorized"
ENTRY_AGENCY = "Unknown"
QUOTA_WORDS = "quota|429|exceeded"


def topic(category: Column, name: Column) -> Column:
    """The category, else the first three words of the name, else a fixed text."""
    words = F.array_remove(F.split(F.coalesce(name, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), "")
    short = F.array_join(F.slice(words, 1, 3), " ")
    return F.coalesce(F.nullif(category, F.lit("")), F.nullif(short, F.lit("")), F.lit(UNKNOWN_TOPIC))


def column_list(columns: Column) -> Column:
    """Column names joined by ``, ``; a column given as a JSON object counts by its ``name``."""

    def name(c: Column) -> Column:
        return F.when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.name"), c)).otherwise(c)

    return F.coalesce(F.array_join(F.transform(columns, name), ", "), F.lit(""))


def registry_entry(catalog: DataFrame) -> DataFrame:
    """Registry rows from catalog rows, with defaults; ``columns`` is an array of structs with a ``name``."""
    return catalog.select(
        "id",
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("category", F.lit(ENTRY_CATEGORY)).alias("category"),
        F.coalesce("agency", F.lit(ENTRY_AGENCY)).alias("agency"),
        F.transform("columns", lambda c: c["name"]).alias("columns"),
        "local_path",
        "sample_row_count",
        F.coalesce("page_views", F.lit(0)).cast("bigint").alias("page_views"),
    )


def select_candidates(catalog: DataFrame, registry: DataFrame, want: int) -> DataFrame:
    """The ``want`` most viewed catalog entries that are new, have columns and hold rows."""
    usable = catalog.where(F.col("columns").isNotNull() & (F.col("n_rows") > 0))
    return usable.join(registry.select("id"), "id", "left_anti").orderBy(F.desc("page_views"), "id").limit(max(want, 0))


def choose_datasets(registry: DataFrame, n: int = 50, seed: int = 42, key: str = "id") -> DataFrame:
    """A reproducible random choice of ``n`` datasets."""
    return first_by(registry, n, order_key(seed, key), key)


def restrict_to(registry: DataFrame, judged: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Only datasets that occur in the judged set."""
    return registry.join(judged.select(key), key, "left_semi")


def remaining(registry: DataFrame, done: DataFrame, key: str = "dataset_id", any_status: bool = False) -> DataFrame:
    """Datasets still to do: not yet recorded as ok (or not recorded at all with ``any_status``)."""
    finished = done if any_status else done.where(F.col("status") == "ok")
    return registry.join(finished.select(key), key, "left_anti")


def new_ids(before: DataFrame, after: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Distinct ids that are ok after a run and were not before."""
    return (
        after.where(F.col("status") == "ok")
        .join(before.where(F.col("status") == "ok").select(key), key, "left_anti")
        .select(key)
        .distinct()
    )


def missing_files(registry: DataFrame, listing: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Registry entries whose file is not there yet."""
    return registry.join(listing.select(key), key, "left_anti")


def ok_profiles(profiles: DataFrame, order: str, max_datasets: int | None = None) -> DataFrame:
    """Profiles with status ok, the first ``max_datasets`` in ``order``."""
    ok = profiles.where(F.col("status") == "ok")
    return ok if max_datasets is None else ok.orderBy(order).limit(max_datasets)


def with_metadata(profiles: DataFrame, registry: DataFrame) -> DataFrame:
    """Profiles with their registry metadata and derived topic; a profile without an entry gets the defaults.

    Of a repeated registry id the last entry in ``ord`` counts.
    """
    meta = last_by_key(registry, "id", "ord").select(
        F.col("id").alias("dataset_id"),
        F.col("name").alias("title"),
        F.col("description").alias("original"),
        "category",
        "agency",
        F.col("columns").alias("registry_columns"),
    )
    joined = profiles.join(meta, "dataset_id", "left")
    return joined.withColumn("topic", topic(F.col("category"), F.col("title"))).withColumns(
        {"title": F.coalesce("title", F.lit("")), "original": F.coalesce("original", F.lit(""))}
    )


def is_quota_error(error: Column) -> Column:
    """Whether an error message says that a quota or rate limit was hit."""
    return F.coalesce(F.lower(error).rlike(QUOTA_WORDS), F.lit(False))
