"""Profiles of typed tables and of the CSV collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.operators import profile as P
from tablescribe.operators import semantic as S

from .tables import CELLS_SQL, cells, staged, table

DIGITS = 5
STATS = ["min", "max", "mean", "std", "p25", "p50", "p75"]

# Table: unique order, and the columns with their kind in SQL terms.
TYPED = {
    "region": (["r_regionkey"], {"r_regionkey": "int", "r_name": "string"}),
    "nation": (["n_nationkey"], {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}),
    "supplier": (["s_suppkey"], {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}),
    "customer": (
        ["c_custkey"],
        {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    ),
    "part": (
        ["p_partkey"],
        {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    ),
    "orders": (
        ["o_orderkey"],
        {
            "o_orderkey": "bigint",
            "o_custkey": "bigint",
            "o_orderstatus": "string",
            "o_totalprice": "double",
            "o_orderdate": "timestamp_ntz",
            "o_orderpriority": "string",
        },
    ),
    "lineitem": (
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"],
        {
            "l_orderkey": "bigint",
            "l_partkey": "bigint",
            "l_suppkey": "bigint",
            "l_linenumber": "int",
            "l_quantity": "double",
            "l_extendedprice": "double",
            "l_discount": "double",
            "l_tax": "double",
            "l_returnflag": "string",
            "l_linestatus": "string",
            "l_shipdate": "timestamp_ntz",
        },
    ),
    "events": (
        ["event_id"],
        {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    ),
    "documents": (["doc_id"], {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}),
    "labels": (["doc_id"], {"doc_id": "bigint", "quality": "int", "toxic": "int"}),
    "pages": (["page_id"], {"page_id": "bigint", "url": "string", "html": "string"}),
    "benchmark": (["item_id"], {"item_id": "bigint", "text": "string"}),
    "conversations": (["conv_id", "turn"], {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}),
}


def flat(profile: DataFrame) -> DataFrame:
    """Profiles as plain columns; lists as md5 of their joined text."""
    top = F.array_join(F.transform("stats.top_values", lambda t: F.concat_ws("=", t["value"], t["count"].cast("string"))), "|")
    numbers = [F.round(F.col(f"stats.{s}"), DIGITS).alias(s) for s in STATS]
    return profile.select(
        "dataset_id",
        "col_idx",
        "name",
        "inferred_dtype",
        "coarse_type",
        "num_rows",
        "num_non_null",
        "num_unique",
        F.round("null_fraction", 6).alias("null_fraction"),
        *numbers,
        F.col("stats.min_str").alias("min_str"),
        F.col("stats.max_str").alias("max_str"),
        F.md5(top).alias("top_values"),
        F.md5(F.array_join("example_values", "|")).alias("example_values"),
    )


def typed(*names: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        parts = [P.profile_table(table(spark, sf, n), n, TYPED[n][0]) for n in names]
        return flat(reduce(DataFrame.unionByName, parts))

    return run


def _kind(dtype: str) -> str:
    return {"string": "text", "timestamp_ntz": "datetime"}.get(dtype, "numeric")


def _shown(column: str, dtype: str) -> str:
    if dtype != "timestamp_ntz":
        return f"{column}::VARCHAR"
    seconds = f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    return f"{seconds} || CASE WHEN microsecond({column}) % 1000000 = 0 THEN '' ELSE rtrim(strftime({column}, '.%f'), '0') END"


def column_sql(source: str, dataset: str, i: int, column: str, dtype: str, order: list[str]) -> str:
    kind = _kind(dtype)
    quoted = f'"{column}"'
    shown = _shown(quoted, dtype)
    if kind == "numeric":
        v = f"{quoted}::DOUBLE"
        numbers = [f"min({v})", f"max({v})", f"avg({v})", f"stddev_samp({v})"] + [f"quantile_cont({v}, {q})" for q in (0.25, 0.5, 0.75)]
        stats = ", ".join(f"round({n}, {DIGITS}) AS {s}" for n, s in zip(numbers, ("min", "max", "mean", "std", "p25", "p50", "p75")))
    else:
        stats = ", ".join(f"NULL::DOUBLE AS {s}" for s in STATS)
    low, high = (
        (f"min({shown})", f"max({shown})") if kind == "datetime" else ("NULL::VARCHAR", "NULL::VARCHAR")
    )
    top = "NULL::VARCHAR"
    if kind == "text":
        top = (
            f"(SELECT md5(coalesce(string_agg(v || '=' || n, '|' ORDER BY n DESC, v), '')) FROM (SELECT {quoted} AS v, count(*) AS n FROM {source} "
            f"WHERE {quoted} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 10))"
        )
    keys = ", ".join(order)
    examples = (
        f"(SELECT md5(coalesce(string_agg(v, '|' ORDER BY r), '')) FROM (SELECT {shown} AS v, row_number() OVER (ORDER BY {keys}) AS r FROM {source} "
        f"WHERE {quoted} IS NOT NULL ORDER BY r LIMIT 5))"
    )
    return (
        f"SELECT '{dataset}' AS dataset_id, {i} AS col_idx, '{column}' AS name, '{dtype}' AS inferred_dtype, '{kind}' AS coarse_type, "
        f"count(*) AS num_rows, count({quoted}) AS num_non_null, count(DISTINCT {quoted}) AS num_unique, "
        f"round(1 - count({quoted}) / count(*), 6) AS null_fraction, {stats}, {low} AS min_str, {high} AS max_str, "
        f"{top} AS top_values, {examples} AS example_values FROM {source}"
    )


def typed_sql(*names: str) -> str:
    return "\nUNION ALL\n".join(
        column_sql(n, n, i, c, d, TYPED[n][0]) for n in names for i, (c, d) in enumerate(TYPED[n][1].items())
    )


def with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with missing values in a text, an integer, a double and a timestamp column."""
    key = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("custkey"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("price"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("placed"),
        F.when(key < 0, key).alias("nothing"),
    )
    return flat(P.profile_table(df, "orders_with_nulls", ["o_orderkey"]))


NULLS = {"o_orderkey": "bigint", "priority": "string", "custkey": "bigint", "price": "double", "placed": "timestamp_ntz", "nothing": "bigint"}
WITH_NULLS_SQL = """WITH src AS (
  SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS custkey,
    CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS price, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS placed,
    CASE WHEN o_orderkey < 0 THEN o_orderkey END AS nothing
  FROM orders)
""" + "\nUNION ALL\n".join(
    column_sql("src", "orders_with_nulls", i, c, d, ["o_orderkey"]) for i, (c, d) in enumerate(NULLS.items())
)


def collection_minimal(spark: SparkSession, sf: str) -> DataFrame:
    return P.minimal_profile(staged(spark, sf)).select(
        "dataset_id", "status", "row_count", "column_count", F.array_join("columns", ",").alias("columns")
    )


COLLECTION_MINIMAL_SQL = f"""WITH {CELLS_SQL}
SELECT ds AS dataset_id, 'ok' AS status, count(DISTINCT row_no) AS row_count, (max(col) + 1)::INTEGER AS column_count,
  (SELECT string_agg(name, ',' ORDER BY col) FROM (SELECT DISTINCT c2.name, c2.col FROM cells c2 WHERE c2.ds = c1.ds)) AS columns
FROM cells c1 GROUP BY ds"""


def collection_profile(spark: SparkSession, sf: str) -> DataFrame:
    return flat(P.profile_cells(cells(spark, sf))).drop("min_str", "max_str")


COLLECTION_PROFILE_SQL = f"""WITH {CELLS_SQL},
basic AS (
  SELECT ds, col, any_value(name) AS name, any_value(dtype) AS dtype, any_value(kind) AS kind, count(*) AS num_rows, count(txt) AS num_non_null,
    count(DISTINCT txt) AS num_unique, round(1 - count(txt) / count(*), 6) AS null_fraction,
    round(min(num), {DIGITS}) AS min, round(max(num), {DIGITS}) AS max, round(avg(num), {DIGITS}) AS mean, round(stddev_samp(num), {DIGITS}) AS std,
    round(quantile_cont(num, 0.25), {DIGITS}) AS p25, round(quantile_cont(num, 0.5), {DIGITS}) AS p50, round(quantile_cont(num, 0.75), {DIGITS}) AS p75
  FROM cells GROUP BY ds, col),
counted AS (SELECT ds, col, txt, count(*) AS n FROM cells WHERE txt IS NOT NULL AND kind <> 'numeric' GROUP BY ds, col, txt),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ds, col ORDER BY n DESC, txt) AS r FROM counted),
top AS (SELECT ds, col, md5(string_agg(txt || '=' || n, '|' ORDER BY r)) AS top_values FROM ranked WHERE r <= 10 GROUP BY ds, col),
placed AS (SELECT ds, col, txt, row_number() OVER (PARTITION BY ds, col ORDER BY row_no) AS r FROM cells WHERE txt IS NOT NULL),
ex AS (SELECT ds, col, md5(string_agg(txt, '|' ORDER BY r)) AS example_values FROM placed WHERE r <= 5 GROUP BY ds, col)
SELECT ds AS dataset_id, col AS col_idx, name, dtype AS inferred_dtype, kind AS coarse_type, num_rows, num_non_null, num_unique, null_fraction,
  min, max, mean, std, p25, p50, p75,
  CASE WHEN kind = 'numeric' THEN NULL ELSE coalesce(top_values, md5('')) END AS top_values, coalesce(example_values, md5('')) AS example_values
FROM basic LEFT JOIN top USING (ds, col) LEFT JOIN ex USING (ds, col)"""


def nested_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The nested form of the CSV profiles: sizes and the columns in table order."""
    nested = P.nest_profile(P.profile_cells(cells(spark, sf)))
    names: Column = F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["num_unique"].cast("string"))), ",")
    return nested.select("dataset_id", "num_rows", "num_columns", names.alias("columns"))


NESTED_PROFILE_SQL = f"""WITH {CELLS_SQL},
basic AS (SELECT ds, col, any_value(name) AS name, count(*) AS num_rows, count(DISTINCT txt) AS num_unique FROM cells GROUP BY ds, col)
SELECT ds AS dataset_id, max(num_rows) AS num_rows, count(*)::INTEGER AS num_columns, string_agg(name || ':' || num_unique, ',' ORDER BY col) AS columns
FROM basic GROUP BY ds"""


def first_rows_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Row-capped profiles: the feature that profiles only the first 10 rows of each file."""
    capped = P.first_rows(cells(spark, sf), 10)
    return P.distinct_summary(P.cell_values(capped, P.cell_facts(capped)))


FIRST_ROWS_SQL = f"""WITH {CELLS_SQL},
placed AS (SELECT *, dense_rank() OVER (PARTITION BY ds ORDER BY row_no) AS r FROM cells)
SELECT ds AS dataset_id, col AS col_idx, count(txt) AS num_non_null, count(DISTINCT txt) AS num_unique
FROM placed WHERE r <= 10 GROUP BY ds, col HAVING count(txt) > 0"""


def column_choice(spark: SparkSession, sf: str) -> DataFrame:
    names = ["customer", "part", "orders", "events"]
    parts = [P.profile_table(table(spark, sf, n), n, TYPED[n][0]) for n in names]
    return S.choose_columns(reduce(DataFrame.unionByName, parts), 3).select("dataset_id", "col_idx", "name")


COLUMN_CHOICE_SQL = (
    "WITH p AS ("
    + typed_sql("customer", "part", "orders", "events")
    + """), c AS (SELECT dataset_id, col_idx, name, row_number() OVER (PARTITION BY dataset_id ORDER BY col_idx) AS r FROM p
WHERE NOT null_fraction >= 0.8 AND num_unique / greatest(num_rows, 1) <= 0.9)
SELECT dataset_id, col_idx, name FROM c WHERE r <= 3"""
)

def embeddings_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A table with an array column; lists of values as counts only, since texts of arrays are written in many ways."""
    profile = P.profile_table(table(spark, sf, "embeddings"), "embeddings", ["vec_id"])
    return profile.select("col_idx", "name", "coarse_type", "num_rows", "num_non_null", "num_unique", F.size("example_values").alias("examples"))


EMBEDDINGS_SQL = "\nUNION ALL\n".join(
    f"SELECT {i} AS col_idx, '{c}' AS name, '{k}' AS coarse_type, count(*) AS num_rows, count({c}) AS num_non_null, count(DISTINCT {c}) AS num_unique, 5 AS examples FROM embeddings"
    for i, (c, k) in enumerate((("vec_id", "numeric"), ("embedding", "text"), ("label", "numeric")))
)

QUERIES = {
    "profile_region_nation": typed("region", "nation"),
    "profile_supplier": typed("supplier"),
    "profile_customer": typed("customer"),
    "profile_part": typed("part"),
    "profile_labels": typed("labels"),
    "profile_orders": typed("orders"),
    "profile_lineitem": typed("lineitem"),
    "profile_events": typed("events"),
    "profile_documents": typed("documents"),
    "profile_pages": typed("pages"),
    "profile_conversations": typed("conversations"),
    "profile_benchmark": typed("benchmark"),
    "profile_embeddings": embeddings_profile,
    "profile_with_nulls": with_nulls,
    "collection_minimal_profile": collection_minimal,
    "collection_column_profile": collection_profile,
    "collection_nested_profile": nested_profile,
    "collection_first_rows": first_rows_profile,
    "semantic_column_choice": column_choice,
}
ORACLES = {
    "profile_region_nation": typed_sql("region", "nation"),
    "profile_supplier": typed_sql("supplier"),
    "profile_customer": typed_sql("customer"),
    "profile_part": typed_sql("part"),
    "profile_labels": typed_sql("labels"),
    "profile_orders": typed_sql("orders"),
    "profile_lineitem": typed_sql("lineitem"),
    "profile_events": typed_sql("events"),
    "profile_documents": typed_sql("documents"),
    "profile_pages": typed_sql("pages"),
    "profile_conversations": typed_sql("conversations"),
    "profile_benchmark": typed_sql("benchmark"),
    "profile_embeddings": EMBEDDINGS_SQL,
    "profile_with_nulls": WITH_NULLS_SQL,
    "collection_minimal_profile": COLLECTION_MINIMAL_SQL,
    "collection_column_profile": COLLECTION_PROFILE_SQL,
    "collection_nested_profile": NESTED_PROFILE_SQL,
    "collection_first_rows": FIRST_ROWS_SQL,
    "semantic_column_choice": COLUMN_CHOICE_SQL,
}
