"""Column profiles of one typed table or of a whole collection of CSV tables.

Both front ends reduce their input to two small shapes and share everything after that:

* *facts*: one row per column, from a single map-side-combined aggregation of the input, written out because several
  later steps read it;
* *values*: one row per distinct non-null value of a column with its count. Distinct counts, top values and exact
  quartiles all come from it, so the data is shuffled once however many columns there are. A long text is there by its
  SHA-256 and its beginning; the texts themselves are fetched for those that can be among the top values only.

A frequent value is one row of *values*, and quartiles are found in ranges of the sorted distinct values (see
:func:`exact_quartiles`), so no task needs a whole column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

KEYS = ["dataset_id", "col_idx"]
QUARTILES = [0.25, 0.5, 0.75]

_EXACT_LONG = 2**53
# Texts beyond so many characters are counted by their digest, and so many characters of every text are kept to rank by.
LONG, HEAD = 64, 32

# The spellings of a boolean in a CSV cell, and the type names a CSV column can get.
BOOLEAN_TOKENS = ["True", "TRUE", "true", "False", "FALSE", "false"]
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|Inf|INF|infinity|Infinity|INFINITY)\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


# ---------------------------------------------------------------- shared steps


def distinct_summary(values: DataFrame) -> DataFrame:
    """Non-null and distinct counts per column."""
    return values.groupBy(*KEYS).agg(
        F.sum("cnt").alias("num_non_null"),
        F.count(F.lit(1)).alias("num_unique"),
    )


def _identity(text: Column) -> list[Column]:
    """What a text is grouped by: itself where it is short, else its ``digest``; and its ``head``, which ranks it."""
    long = F.length(text) > LONG
    return [F.when(~long, text).alias("txt"), F.when(long, F.sha2(text, 256)).alias("digest"), F.substring(text, 1, HEAD).alias("head")]


def top_values(values: DataFrame, texts: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column, ties in value order.

    Values are ranked by count and beginning, and a ``rank() <= k`` becomes a group limit below the shuffle, so only the
    first ones of a column and task move. What ties with the last of them is kept; the long texts among these are looked up in
    ``texts`` (the keys, ``text``), which is scanned only if there are any.
    """
    order = Window.partitionBy(*KEYS).orderBy(F.desc("cnt"), "head")
    first = values.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= k).select(*KEYS, "txt", "digest", "cnt")
    if texts is not None:
        first = materialize(first, "top")
        long = first.where(F.col("digest").isNotNull())
        if not long.isEmpty():
            found = texts.where(F.length("text") > LONG).withColumn("digest", F.sha2("text", 256)).join(long.select(*KEYS, "digest"), [*KEYS, "digest"], "left_semi")
            whole = found.dropDuplicates([*KEYS, "digest"]).select(*KEYS, "digest", "text")
            first = first.join(whole, [*KEYS, "digest"], "left").withColumn("txt", F.coalesce("txt", "text"))
    exact = Window.partitionBy(*KEYS).orderBy(F.desc("cnt"), "txt")
    ranked = first.withColumn("rank", F.row_number().over(exact)).where(F.col("rank") <= k)
    entry = F.struct("rank", F.col("txt").alias("value"), F.col("cnt").alias("count"))
    return (
        ranked.groupBy(*KEYS)
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(*KEYS, F.transform("entries", lambda e: F.struct(e["value"], e["count"])).alias("top_values"))
    )


def exact_quartiles(values: DataFrame, counts: DataFrame) -> DataFrame:
    """p25, p50 and p75 with linear interpolation, exact.

    ``counts`` has one row per numeric column with ``n``, its number of values. The distinct values are dealt into ranges of
    (table, column, value) and written; the sums of the ranges' counts tell which range holds a wanted rank, and only
    within such ranges are values ranked. A long column has many ranges, short columns share one.
    """
    numbers = values.where(F.col("num").isNotNull()).select(*KEYS, "num", "cnt").join(counts.select(*KEYS), KEYS, "left_semi")
    same = numbers.groupBy(*KEYS, "num").agg(F.sum("cnt").alias("cnt"))
    ranged = materialize(same.repartitionByRange(*KEYS, "num").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*KEYS, "part").agg(F.sum("cnt").alias("size"))
    before = F.sum("size").over(Window.partitionBy(*KEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(i).alias("q"), ((F.col("n") - 1) * p).alias("h")) for i, p in enumerate(QUARTILES)])
    wanted = counts.select(*KEYS, F.explode(ranks).alias("w")).select(*KEYS, "w.*")
    ends = F.explode(F.array(F.struct(F.lit("a").alias("end"), F.floor("h").alias("rank")), F.struct(F.lit("b").alias("end"), F.ceil("h").alias("rank"))))
    wanted = wanted.withColumn("e", ends).select(*KEYS, "q", "h", "e.*")
    placed = wanted.join(sums, KEYS).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("size")))
    held = ranged.join(placed.select(*KEYS, "part", "before").distinct(), [*KEYS, "part"])
    running = Window.partitionBy(*KEYS, "part").orderBy("num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = held.withColumn("upto", F.col("before") + F.sum("cnt").over(running)).select(*KEYS, "part", "num", "cnt", "upto")
    hit = placed.join(upto, [*KEYS, "part"]).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("cnt") <= F.col("rank")))
    pair = hit.groupBy(*KEYS, "q", "h").agg(*[F.max(F.when(F.col("end") == e, F.col("num"))).alias(e) for e in "ab"])
    point = F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))
    return pair.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("q") == i, point)).alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    )


def _assemble(facts: DataFrame, values: DataFrame, long_texts: DataFrame | None, examples: DataFrame, top_k: int) -> DataFrame:
    """Join the per-column pieces (each one row per column) into the flat profile."""
    numeric = F.col("coarse_type") == "numeric"
    counts = facts.where(numeric & (F.col("n") > 0)).select(*KEYS, "n")
    texts = values.where(F.col("num").isNull())
    parts = [
        distinct_summary(values),
        exact_quartiles(values, counts),
        top_values(texts, long_texts, top_k),
        examples,
    ]
    joined = reduce(lambda left, right: left.join(right, KEYS, "left"), parts, facts)
    top = F.when(
        F.col("coarse_type").isin("text", "boolean"),
        F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")),
    )
    non_null = F.coalesce("num_non_null", F.lit(0))
    return joined.select(
        "dataset_id",
        "col_idx",
        "name",
        "inferred_dtype",
        "coarse_type",
        "num_rows",
        non_null.alias("num_non_null"),
        F.coalesce("num_unique", F.lit(0)).alias("num_unique"),
        F.when(F.col("num_rows") > 0, 1 - non_null / F.col("num_rows")).alias("null_fraction"),
        F.struct(
            *[F.col(c) for c in ("min", "max", "mean", "std", "p25", "p50", "p75", "min_str", "max_str")],
            top.alias("top_values"),
        ).alias("stats"),
        F.coalesce("example_values", F.array().cast("array<string>")).alias("example_values"),
    )


# ---------------------------------------------------------------- one typed table


def coarse_type(dtype: T.DataType) -> str:
    """numeric, datetime, boolean or text, from a column's declared type."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "text"


def _present(field: T.StructField) -> Column:
    """The column with NaN counted as missing."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def as_text(field: T.StructField) -> Column:
    """A column's value as text: nested values as JSON, booleans with a capital letter, the rest by cast."""
    c = _present(field)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(field.dataType, T.BinaryType):
        return F.base64(c)
    if isinstance(field.dataType, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


def _number_identity(field: T.StructField) -> Column:
    """Extra text identity for numbers that DOUBLE cannot hold exactly, else NULL."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.LongType):
        return F.when((c > _EXACT_LONG) | (c < -_EXACT_LONG), c.cast("string"))
    if isinstance(field.dataType, T.DecimalType):
        return c.cast("string")
    return F.lit(None).cast("string")


def _has_texts(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def table_texts(df: DataFrame, dataset_id: str) -> DataFrame | None:
    """The keys and ``text`` of all values of the columns that can hold long texts; None if there is no such column."""
    entries = [F.struct(F.lit(i).alias("col_idx"), as_text(f).alias("text")) for i, f in enumerate(df.schema.fields) if _has_texts(f)]
    if not entries:
        return None
    return df.select(F.lit(dataset_id).alias("dataset_id"), F.explode(F.array(*entries)).alias("x")).select("dataset_id", "x.col_idx", "x.text")


def table_values(df: DataFrame, dataset_id: str) -> DataFrame:
    """Distinct non-null values of every column with their counts, in one shuffle with map-side combine."""
    entries: list[Column] = []
    for i, field in enumerate(df.schema.fields):
        is_number = coarse_type(field.dataType) == "numeric"
        entries += [
            F.lit(i),
            _present(field).cast("double") if is_number else F.lit(None).cast("double"),
            _number_identity(field) if is_number else as_text(field),
        ]
    return (
        df.select(F.stack(F.lit(len(df.columns)), *entries).alias("col_idx", "num", "text"))
        .where(F.col("num").isNotNull() | F.col("text").isNotNull())
        .select("col_idx", "num", *_identity(F.col("text")))
        .groupBy(F.lit(dataset_id).alias("dataset_id"), "col_idx", "num", "txt", "digest", "head")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def table_facts(df: DataFrame, dataset_id: str) -> DataFrame:
    """Counts and moments of every column from one global aggregation, as one row per column."""
    none = {"double": F.lit(None).cast("double"), "string": F.lit(None).cast("string")}
    aggs = [F.count(F.lit(1)).alias("num_rows")]
    rows = []
    for i, field in enumerate(df.schema.fields):
        kind = coarse_type(field.dataType)
        fact = {"name": F.lit(field.name), "inferred_dtype": F.lit(field.dataType.simpleString()), "coarse_type": F.lit(kind)}
        fact |= {c: none["double"] for c in ("min", "max", "mean", "std")} | {c: none["string"] for c in ("min_str", "max_str")}
        fact |= {"n": F.lit(0).cast("bigint"), "filled": F.col(f"filled{i}")}
        aggs.append(F.count(_present(field)).alias(f"filled{i}"))
        if kind == "numeric":
            v = _present(field).cast("double")
            aggs += [
                F.min(v).alias(f"min{i}"),
                F.max(v).alias(f"max{i}"),
                F.avg(v).alias(f"mean{i}"),
                F.stddev_samp(v).alias(f"std{i}"),
                F.count(v).alias(f"n{i}"),
            ]
            fact |= {c: F.col(f"{c}{i}") for c in ("min", "max", "mean", "std", "n")}
        elif kind == "datetime":
            c = F.col(f"`{field.name}`")
            aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
            fact |= {"min_str": F.col(f"lo{i}"), "max_str": F.col(f"hi{i}")}
        rows.append(F.struct(F.lit(i).alias("col_idx"), *[c.alias(k) for k, c in fact.items()]))
    return df.agg(*aggs).select(
        F.lit(dataset_id).alias("dataset_id"), "num_rows", F.explode(F.array(*rows)).alias("fact")
    ).select("dataset_id", "num_rows", "fact.*")


def table_examples(df: DataFrame, dataset_id: str, order_by: list[str], facts: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` non-null values of every column in ``order_by`` order, as text.

    The columns without missing values share one top-k scan of the table, and all others one more, whose
    ``row_number() <= k`` becomes a limit per column in each task.
    """
    order = [F.col(c) for c in order_by]
    fields = list(enumerate(df.schema.fields))
    complete = {r.col_idx for r in facts.where(F.col("filled") == F.col("num_rows")).select("col_idx").collect()}

    def rows(head: DataFrame, some: list[tuple[int, T.StructField]]) -> DataFrame:
        values = F.array(*[F.struct(F.lit(i).alias("col_idx"), as_text(f).alias("text")) for i, f in some])
        cells = head.select(F.struct(*order).alias("at"), F.explode(values).alias("cell"))
        return cells.select("cell.col_idx", "at", "cell.text").where(F.col("text").isNotNull())

    pieces = []
    if shared := [(i, f) for i, f in fields if i in complete]:
        pieces.append(rows(df.orderBy(*order).limit(k), shared))
    if rest := [(i, f) for i, f in fields if i not in complete]:
        place = F.row_number().over(Window.partitionBy("col_idx").orderBy("at"))
        pieces.append(rows(df, rest).withColumn("place", place).where(F.col("place") <= k).drop("place"))
    entries = F.array_sort(F.collect_list(F.struct("at", "text")))
    return (
        reduce(DataFrame.unionByName, pieces)
        .groupBy(F.lit(dataset_id).alias("dataset_id"), "col_idx")
        .agg(F.transform(entries, lambda e: e["text"]).alias("example_values"))
    )


def profile_table(
    df: DataFrame,
    dataset_id: str,
    order_by: list[str],
    max_examples: int = 5,
    top_k: int = 10,
) -> DataFrame:
    """The flat profile of one typed table: one row per column.

    ``order_by`` must be a unique key; it decides which values are the first ones.
    """
    facts = materialize(table_facts(df, dataset_id), "facts")
    examples = table_examples(df, dataset_id, order_by, facts, max_examples)
    values = materialize(table_values(df, dataset_id), "values")
    return _assemble(facts, values, table_texts(df, dataset_id), examples, top_k)


# ---------------------------------------------------------------- a collection of CSV tables


def cell_facts(cells: DataFrame) -> DataFrame:
    """Counts, moments and the whole-column type of every CSV column, from one aggregation over the cells.

    ``cells`` holds text values with NULL for missing ones; ``row_idx`` NULL marks a column of a table without rows.
    """
    value = F.col("value")
    number = F.when(value.rlike(_NUMBER), F.expr("try_cast(trim(value) AS DOUBLE)"))
    integer = F.when(value.rlike(_INTEGER), F.expr("try_cast(trim(value) AS BIGINT)"))
    grouped = cells.groupBy(*KEYS).agg(
        F.max("col_name").alias("name"),
        F.count("row_idx").alias("num_rows"),
        F.count("value").alias("filled"),
        F.count(number).alias("n"),
        F.count(integer).alias("n_integer"),
        F.count_if(value.isin(BOOLEAN_TOKENS)).alias("n_boolean"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("std"),
    )
    rows, filled = F.col("num_rows"), F.col("filled")
    kind = (
        F.when(rows == 0, "text")
        .when((filled > 0) & (F.col("n_boolean") == filled), "boolean")
        .when(F.col("n") == filled, "numeric")
        .otherwise("text")
    )
    dtype = (
        F.when(F.col("coarse_type") == "boolean", "boolean")
        .when(F.col("coarse_type") == "text", "string")
        .when((F.col("n_integer") == rows), "bigint")
        .otherwise("double")
    )
    numeric = F.col("coarse_type") == "numeric"
    return (
        grouped.withColumn("coarse_type", kind)
        .withColumn("inferred_dtype", dtype)
        .select(
            *KEYS,
            "name",
            "inferred_dtype",
            "coarse_type",
            "num_rows",
            *[F.when(numeric, F.col(c)).alias(c) for c in ("min", "max", "mean", "std", "n")],
            F.lit(None).cast("string").alias("min_str"),
            F.lit(None).cast("string").alias("max_str"),
        )
    )


def cell_values(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct non-null values per column, equal after typing (``1`` = ``1.0`` = ``01`` in a numeric column).

    Cells are first combined by their text, long ones that are no number by digest; the distinct texts then meet the column
    types, of which there is one small row per column.
    """
    number = F.when(F.col("value").rlike(_NUMBER), F.expr("try_cast(trim(value) AS DOUBLE)"))
    long = (F.length("value") > LONG) & ~F.col("value").rlike(_NUMBER)
    identity = [F.when(~long, F.col("value")).alias("value"), F.when(long, F.sha2("value", 256)).alias("digest"), F.substring("value", 1, HEAD).alias("head")]
    raw = cells.where(F.col("value").isNotNull()).select(*KEYS, *identity).groupBy(*KEYS, "value", "digest", "head").agg(F.count(F.lit(1)).alias("cnt")).withColumn("number", number)
    whole = F.expr("try_cast(trim(value) AS BIGINT)")
    text = (
        F.when(F.col("coarse_type") == "boolean", F.initcap(F.lower("value")))
        .when(F.col("coarse_type") == "text", F.col("value"))
        .when((F.col("inferred_dtype") == "bigint") & ((whole > _EXACT_LONG) | (whole < -_EXACT_LONG)), whole.cast("string"))
    )
    return (
        raw.join(facts.select(*KEYS, "coarse_type", "inferred_dtype"), KEYS)
        .withColumn("num", F.when(F.col("coarse_type") == "numeric", F.col("number")))
        .withColumn("txt", text)
        .withColumn("head", F.when(F.col("coarse_type") != "numeric", F.coalesce(F.substring("txt", 1, HEAD), "head")))
        .groupBy(*KEYS, "num", "txt", "digest", "head")
        .agg(F.sum("cnt").alias("cnt"))
    )


def cell_examples(cells: DataFrame, facts: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` non-null values of every CSV column in row order, shown as typed values."""
    order = Window.partitionBy(*KEYS).orderBy("row_idx")
    head = (
        cells.where(F.col("value").isNotNull())
        .select(*KEYS, "row_idx", "value")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    entries = head.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("entries"))
    typed = entries.join(facts.select(*KEYS, "inferred_dtype"), KEYS)

    def shown(e: Column) -> Column:
        value = e["value"]
        return (
            F.when(F.col("inferred_dtype") == "bigint", F.trim(value).cast("bigint").cast("string"))
            .when(F.col("inferred_dtype") == "double", F.trim(value).cast("double").cast("string"))
            .when(F.col("inferred_dtype") == "boolean", F.initcap(F.lower(value)))
            .otherwise(value)
        )

    return typed.select(*KEYS, F.transform("entries", shown).alias("example_values"))


def profile_cells(cells: DataFrame, max_examples: int = 5, top_k: int = 10) -> DataFrame:
    """Flat profiles of all tables of a collection in one plan: one row per table and column.

    ``cells``: ``dataset_id, row_idx, col_idx, col_name, value`` as made by
    :func:`tablescribe.sources.collection.collection_cells`, best written out first since it is read three times.
    """
    facts = materialize(cell_facts(cells), "facts")
    # Written once: four readers would otherwise each repeat the join with the column types.
    values = materialize(cell_values(cells, facts), "values")
    texts = cells.where(F.col("value").isNotNull()).select(*KEYS, F.col("value").alias("text"))
    return _assemble(facts, values, texts, cell_examples(cells, facts, max_examples), top_k)


def first_rows(cells: DataFrame, n: int | None) -> DataFrame:
    """Only the first ``n`` rows of every table (``None``: all). Columns of tables without rows stay."""
    if n is None:
        return cells
    return cells.where(F.col("row_idx").isNull() | (F.col("row_idx") < n))


# ---------------------------------------------------------------- whole tables


def minimal_profile(staged: DataFrame) -> DataFrame:
    """Row count, column count, column names and status per table of a staged collection; files with a problem are errors."""
    per_file = staged.groupBy("dataset_id").agg(
        F.sum((F.col("row_idx") >= 0).cast("int")).cast("bigint").alias("row_count"),
        F.max(F.when(F.col("row_idx") == -1, F.col("fields"))).alias("columns"),
        F.max("n_fields").alias("widest"),
        F.max("problem").alias("problem"),
    )
    wide = F.when(F.col("widest") > F.size("columns"), F.format_string("expected %d fields, saw %d", F.size("columns"), F.col("widest")))
    found = per_file.withColumn("error", F.coalesce("problem", wide))
    ok = F.col("error").isNull()
    return found.select(
        "dataset_id",
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(ok, F.col("row_count")).alias("row_count"),
        F.when(ok, F.size("columns")).alias("column_count"),
        F.when(ok, F.col("columns")).alias("columns"),
        "error",
    )


def nest_profile(profile: DataFrame) -> DataFrame:
    """One row per table: ``dataset_id, num_rows, num_columns, columns`` with the columns in table order.

    The array holds one entry per column of the table, so its size is bounded by the table's width.
    """
    entry = F.struct(
        "col_idx",
        "name",
        "inferred_dtype",
        "coarse_type",
        "num_non_null",
        "num_unique",
        "null_fraction",
        "stats",
        "example_values",
    )
    nested = profile.groupBy("dataset_id").agg(
        F.max("num_rows").alias("num_rows"),
        F.count(F.lit(1)).cast("int").alias("num_columns"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    return nested.select(
        "dataset_id",
        "num_rows",
        "num_columns",
        F.transform("entries", lambda e: e.dropFields("col_idx")).alias("columns"),
    )
