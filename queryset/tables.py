"""Inputs shared by the queries: the given tables, and a collection of small CSV files that Spark derives from them."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.session import materialize, new_path, qualified
from tablescribe.sources.collection import collection_cells, stage_collection

ROWS_PER_FILE = 100
DATASET_DIR = r"dataset_id=([^/]+)/"
# The folder name that Spark gives to rows without a value.
NO_ID = "__HIVE_DEFAULT_PARTITION__"
_written: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def csv_sources(spark: SparkSession, sf: str) -> list[tuple[DataFrame, str]]:
    """Three differently shaped kinds of dataset with missing values, booleans, quotes and line breaks."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("orders-"), F.floor(F.col("o_orderkey") / ROWS_PER_FILE)).alias("dataset_id"),
        "o_orderkey",
        "o_custkey",
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
        F.when(F.col("o_orderpriority") == "5-LOW", "NA").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.initcap((F.col("o_orderstatus") == "O").cast("string")).alias("is_open"),
    )
    customer = table(spark, sf, "customer").select(
        F.concat(F.lit("customer-"), F.floor(F.col("c_custkey") / ROWS_PER_FILE)).alias("dataset_id"),
        "c_custkey",
        "c_name",
        F.when(F.col("c_nationkey") != 7, F.col("c_nationkey")).alias("c_nationkey"),
        F.lit(None).cast("string").alias("c_phone"),
    )
    documents = table(spark, sf, "documents").select(
        F.concat(F.lit("documents-"), F.floor(F.col("doc_id") / ROWS_PER_FILE)).alias("dataset_id"),
        "doc_id",
        "lang",
        "source",
        "text",
        "n_chars",
    )
    return [(orders, "o_orderkey"), (customer, "c_custkey"), (documents, "doc_id")]


def _write_files(uri: str, header: list[str]):
    """Writes rows that come sorted by ``dataset_id`` to a CSV file per dataset, all values as text."""
    from tablescribe.functions import stores

    def text(v: str | None) -> str:
        # Quoted as Spark's writer does it: an empty text, or one with a separator, a quote, a comment sign first, or outer blanks.
        if v is None:
            return ""
        if v.isalnum():
            return v
        if v == "" or "," in v or '"' in v or "\n" in v or "\r" in v or v[0] <= " " or v[0] == "#" or v[-1] <= " ":
            return '"' + v.replace('"', '""') + '"'
        return v

    def write(batches):
        name, lines = None, []

        def close():
            if name is not None:
                folder = quote(name, safe=" -_.~()!&,;@+$")
                stores.write_bytes(f"{uri}/dataset_id={folder}/part.csv", "".join([",".join(header) + "\n", *lines]).encode())

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ["dataset_id", *header]]
            for dataset, *values in zip(*columns):
                if dataset != name:
                    close()
                    name, lines = dataset, []
                lines.append(",".join(map(text, values)) + "\n")
            yield batch.select(["dataset_id"]).slice(0, 0)
        close()

    return write


def csv_collection(spark: SparkSession, sf: str) -> str:
    """The folder with the CSV files, written once per session; a file holds at most 100 rows."""
    slot = (spark.sparkContext.applicationId, sf)
    if slot not in _written:
        path = new_path(spark, "csv-collection")
        for i, (df, key) in enumerate(csv_sources(spark, sf)):
            header = [c for c in df.columns if c != "dataset_id"]
            named = df.withColumn("dataset_id", F.coalesce(F.nullif("dataset_id", F.lit("")), F.lit(NO_ID)))
            rows = named.repartition("dataset_id").sortWithinPartitions("dataset_id", key).select("dataset_id", *[F.col(c).cast("string") for c in header])
            # Files are written by the tasks themselves: Spark's writer takes ten times as long for one of 100 rows.
            materialize(rows.mapInArrow(_write_files(qualified(spark, f"{path}/{i}"), header), "dataset_id string"), "written")
        _written[slot] = path
    return _written[slot]


def staged(spark: SparkSession, sf: str) -> DataFrame:
    return stage_collection(spark, csv_collection(spark, sf), dataset_pattern=DATASET_DIR)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(collection_cells(staged(spark, sf)), "cells")


# The cells of the same collection in SQL: ds, row, col, name, txt (as shown), num.
CELLS_SQL = """
cells AS (
  SELECT ds, row_no, c.col AS col, c.name AS name, c.txt AS txt, c.num AS num, c.kind AS kind, c.dtype AS dtype FROM (
    SELECT 'orders-' || (o_orderkey // 100) AS ds, o_orderkey AS row_no, unnest([
      {'col': 0, 'name': 'o_orderkey', 'txt': o_orderkey::VARCHAR, 'num': o_orderkey::DOUBLE, 'kind': 'numeric', 'dtype': 'bigint'},
      {'col': 1, 'name': 'o_custkey', 'txt': o_custkey::VARCHAR, 'num': o_custkey::DOUBLE, 'kind': 'numeric', 'dtype': 'bigint'},
      {'col': 2, 'name': 'o_totalprice', 'txt': o_totalprice::VARCHAR, 'num': o_totalprice, 'kind': 'numeric', 'dtype': 'double'},
      {'col': 3, 'name': 'o_orderdate', 'txt': strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'num': NULL::DOUBLE, 'kind': 'text', 'dtype': 'string'},
      {'col': 4, 'name': 'o_orderpriority', 'txt': nullif(o_orderpriority, '5-LOW'), 'num': NULL::DOUBLE, 'kind': 'text', 'dtype': 'string'},
      {'col': 5, 'name': 'is_open', 'txt': CASE WHEN o_orderstatus = 'O' THEN 'True' ELSE 'False' END, 'num': NULL::DOUBLE, 'kind': 'boolean', 'dtype': 'boolean'}
    ]) AS c FROM orders
    UNION ALL
    SELECT 'customer-' || (c_custkey // 100), c_custkey, unnest([
      {'col': 0, 'name': 'c_custkey', 'txt': c_custkey::VARCHAR, 'num': c_custkey::DOUBLE, 'kind': 'numeric', 'dtype': 'bigint'},
      {'col': 1, 'name': 'c_name', 'txt': c_name, 'num': NULL::DOUBLE, 'kind': 'text', 'dtype': 'string'},
      {'col': 2, 'name': 'c_nationkey', 'txt': CASE WHEN whole THEN c_nationkey::VARCHAR ELSE nullif(c_nationkey, 7)::DOUBLE::VARCHAR END,
       'num': nullif(c_nationkey, 7)::DOUBLE, 'kind': 'numeric', 'dtype': CASE WHEN whole THEN 'bigint' ELSE 'double' END},
      {'col': 3, 'name': 'c_phone', 'txt': NULL::VARCHAR, 'num': NULL::DOUBLE, 'kind': 'numeric', 'dtype': 'double'}
    ]) FROM (SELECT *, bool_and(c_nationkey <> 7) OVER (PARTITION BY c_custkey // 100) AS whole FROM customer)
    UNION ALL
    SELECT 'documents-' || (doc_id // 100), doc_id, unnest([
      {'col': 0, 'name': 'doc_id', 'txt': doc_id::VARCHAR, 'num': doc_id::DOUBLE, 'kind': 'numeric', 'dtype': 'bigint'},
      {'col': 1, 'name': 'lang', 'txt': lang, 'num': NULL::DOUBLE, 'kind': 'text', 'dtype': 'string'},
      {'col': 2, 'name': 'source', 'txt': source, 'num': NULL::DOUBLE, 'kind': 'text', 'dtype': 'string'},
      {'col': 3, 'name': 'text', 'txt': text, 'num': NULL::DOUBLE, 'kind': 'text', 'dtype': 'string'},
      {'col': 4, 'name': 'n_chars', 'txt': n_chars::VARCHAR, 'num': n_chars::DOUBLE, 'kind': 'numeric', 'dtype': 'bigint'}
    ]) FROM documents
  )
)
"""
