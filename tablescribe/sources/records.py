"""Registry, description records, queries, relevance matrix and result files: readers and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

REGISTRY_SCHEMA = (
    "id string, name string, description string, category string, agency string, columns array<string>, "
    "local_path string, sample_row_count int, page_views bigint"
)
RECORD_SCHEMA = (
    "dataset_id string, title string, topic string, HandS string, ufd string, sfd string, ufd_nyc string, "
    "sfd_nyc string, status string, error string"
)
RESULTS_SCHEMA = "method string, metric string, value double"

# ---------------------------------------------------------------- readers


def read_registry(spark: SparkSession, path: str, max_datasets: int | None = None) -> DataFrame:
    """A registry (one JSON array of objects) with its order as ``ord``; only the first ``max_datasets`` when given.

    The array may be one file, or a folder of files that make it up in the order of their names. It is read in splits, cut at
    closing braces; prefix sums of quotes and brackets over the splits tell where an entry ends, so no task needs more than a
    split and an entry. A text that is no such array is an error.
    """
    pieces = materialize(_pieces(spark, path), "registry")
    quoted = _running(pieces, "quotes", "before")
    # What stands outside of strings: the text up to here has an odd number of quotes inside one.
    inside = F.when(F.col("before") % 2 == 1, '"').otherwise("")
    bare = F.regexp_replace(F.concat(inside, "plain"), r'"[^"]*("|$)', "")
    opened = F.length(bare) - F.length(F.translate(bare, "{[", ""))
    closed = F.length(bare) - F.length(F.translate(bare, "}]", ""))
    told = quoted.select("path", "block", "at", "text", bare.alias("bare"), (opened - closed).cast("long").alias("step"))
    deep = _running(told, "step", "depth").withColumn("depth", F.col("depth") + F.col("step"))
    ends = (F.col("depth") == 1) & F.endswith("bare", F.lit("}"))
    numbered = materialize(_running(deep.withColumn("ends", F.when(ends, 1).otherwise(0).cast("long")), "ends", "entry"), "entries")
    parts = F.array_sort(F.collect_list(F.struct("path", "block", "at", "text")))
    entries = numbered.groupBy("entry").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"), F.max("ends").alias("whole"))
    first = F.when(F.col("entry") == 0, r"^\s*\[").otherwise(r"^\s*,")
    total = numbered.agg(F.sum("step").alias("depth"), F.count_if(F.col("depth") < 0).alias("low"), F.count(F.lit(1)).alias("n")).first()
    empty = entries.where((F.col("whole") == 0) & ~F.when(F.col("entry") == 0, F.col("text").rlike(r"^\s*\[\s*\]\s*$")).otherwise(F.col("text").rlike(r"^\s*\]\s*$")))
    odd = empty.unionByName(entries.where((F.col("whole") == 1) & ~F.regexp_like("text", first))).select(F.substring("text", 1, 80).alias("text")).first()
    if odd or not total["n"] or total["depth"] or total["low"]:
        raise ValueError(f"the registry is no JSON array: {odd['text'] if odd else path}")
    item = F.from_json(F.regexp_replace("text", first, F.lit("")), f"struct<{_as_struct(REGISTRY_SCHEMA)}>", {"mode": "FAILFAST"})
    registry = entries.where("whole = 1").select(F.col("entry").cast("int").alias("ord"), item.alias("item")).select("ord", "item.*")
    return registry if max_datasets is None else registry.where(F.col("ord") < max_datasets)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text of files up to each closing brace, with its place, and without escapes as ``plain`` with the number of its quotes."""
    rows = spark.read.option("lineSep", "}").text(path)
    placed = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # The reader takes the brace away; what follows a file's last one had none.
    placed = materialize(placed, "pieces")
    last = placed.groupBy("path").agg(F.max(F.struct("block", "at")).alias("last"))
    ends = placed.join(last, "path").withColumn("is_last", F.struct("block", "at") == F.col("last"))
    text = ends.select("path", "block", "at", F.when(F.col("is_last"), F.col("value")).otherwise(F.concat("value", F.lit("}"))).alias("text"))
    plain = text.withColumn("plain", F.regexp_replace("text", r"\\.", ""))
    return plain.withColumn("quotes", (F.length("plain") - F.length(F.translate("plain", '"', ""))).cast("long"))


def _running(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the sum of ``column`` over all rows before, by path, block and place: sums of blocks first, then within a block."""
    # One row per block.
    blocks = df.groupBy("path", "block").agg(F.sum(column).alias("sum"))
    over = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("start"))
    within = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, ["path", "block"]).withColumn(name, F.col("start") + F.coalesce(F.sum(column).over(within), F.lit(0))).drop("start")


def _parsed(column: str, schema: str, message: Column) -> Column:
    """A whole file's JSON; a file that cannot be read as ``schema`` fails the query."""
    value = F.from_json(column, schema, {"mode": "FAILFAST"})
    return F.coalesce(value, F.raise_error(F.concat(message, F.substring(column, 1, 80))).cast(schema))


def _as_struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ", 1) for f in ddl.split(", ")))


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in ``order``. The result's ``order`` is the position of the key's first row."""
    kept = [c for c in df.columns if c not in (key, order)]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("rec"), F.min(order).alias(order))
    return picked.select(key, order, "rec.*")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with ``ord``, the position in the file (files by age).

    Blank lines are skipped; unparsable lines are skipped too unless ``strict``, when they fail the query.
    """
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    position = F.struct(
        "_metadata.file_modification_time",
        "_metadata.file_path",
        "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.schema(schema).option("mode", mode).json(path).withColumn("ord", position)


def read_queries(spark: SparkSession, path: str, num_queries: int | None = None) -> DataFrame:
    """Non-blank lines of a query file as ``query_no, query_id, text``, numbered from 1."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), strip), lambda x: x != "")
    if num_queries is not None:
        lines = F.slice(lines, 1, num_queries)
    return whole.select(F.posexplode(lines).alias("pos", "text")).select(
        (F.col("pos") + 1).alias("query_no"), F.concat(F.lit("query_"), F.col("pos") + 1).alias("query_id"), "text"
    )


def strip(text: Column) -> Column:
    """``text`` without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def relevance_long(wide: DataFrame, key: str = "dataset_id") -> DataFrame:
    """A relevance matrix (one column per query) as ``query_id, dataset_id, rel``; the last row of an id wins."""
    queries = [c for c in wide.columns if c not in (key, "ord")]
    if "ord" in wide.columns:
        wide = last_by_key(wide, key, "ord")
    typed = wide.select(F.col(key).cast("string").alias("dataset_id"), *[F.col(q).cast("int").alias(q) for q in queries])
    return typed.unpivot("dataset_id", queries, "query_id", "rel").where(F.col("rel").isNotNull())


def read_relevance(spark: SparkSession, path: str) -> DataFrame:
    """A relevance matrix file in long form."""
    wide = spark.read.option("header", True).csv(path)
    return relevance_long(wide.withColumn("ord", F.monotonically_increasing_id()))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A ``{method: {metric: value}}`` file as ``method, metric, value``; a missing file reads as empty."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS_SCHEMA)
    results = _parsed("value", "map<string, map<string, double>>", F.lit("the results are no JSON object: "))
    methods = whole.select(F.explode(results).alias("method", "metrics"))
    return methods.select("method", F.explode("metrics").alias("metric", "value"))


# ---------------------------------------------------------------- writers


def append_jsonl(records: DataFrame, path: str) -> None:
    """Append records as JSON lines; every run adds files, so finished work is never rewritten."""
    records.write.mode("append").json(path)


def slim_records(records: DataFrame, texts: tuple[str, ...] = ("ufd_nyc", "sfd_nyc")) -> DataFrame:
    """Only id, title and the named texts, missing texts as empty."""
    return records.select("dataset_id", "title", *[F.coalesce(t, F.lit("")).alias(t) for t in texts])


def write_slim(records: DataFrame, path: str) -> None:
    slim_records(records).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def relevance_wide(relevance: DataFrame, query_ids: list[str]) -> DataFrame:
    """The relevance matrix with one column per query, in the order of ``query_ids``."""
    return relevance.groupBy("dataset_id").pivot("query_id", query_ids).agg(F.first("rel"))


def write_relevance(relevance: DataFrame, query_ids: list[str], path: str) -> None:
    relevance_wide(relevance, query_ids).write.mode("overwrite").option("header", True).csv(path)


def results_json(results: DataFrame) -> DataFrame:
    """One row with the nested ``{method: {metric: value}}`` text (a handful of methods and metrics)."""
    per_method = results.groupBy("method").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    )
    entries = F.array_sort(F.collect_list(F.struct("method", F.to_json("metrics").alias("metrics"))))
    body = F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["method"], F.lit('":'), e["metrics"])), ",")
    return per_method.agg(F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    results_json(results).coalesce(1).write.mode("overwrite").text(path)


def write_dataset_csv(df: DataFrame, path: str) -> None:
    """One dataset table as CSV with a header and no row numbers."""
    verbatim = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, **verbatim).csv(path)


def merge_registry(existing: DataFrame, accepted: DataFrame) -> DataFrame:
    """The registry with newly accepted entries added; ids already present keep their entry.

    An id accepted twice is taken from its most viewed entry, the one a catalog lists first.
    """
    rest = [c for c in accepted.columns if c != "id"]
    once = accepted.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("page_views", *rest)).alias("e")).select("id", "e.*")
    fresh = once.join(existing.select("id"), "id", "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)
