"""Samples, prompts, reply parsing, generation and grading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescribe.functions import parsing
from tablescribe.functions.text import cap_block, cap_domain_block, cap_prompt
from tablescribe.operators import catalog, generate, grading
from tablescribe.operators import profile as P
from tablescribe.operators import semantic as S
from tablescribe.plans import describe, evaluate, prompts
from tablescribe.session import materialize, new_path
from tablescribe.sources import collection
from tablescribe.sources.collection import collection_cells
from tablescribe.sources.records import last_by_key

from .catalogs import registry
from .profiles import TYPED
from .search import benchmark_queries
from .tables import CELLS_SQL, DATASET_DIR, cells, csv_collection, csv_sources, staged, table


# Plain listings of the fields stand in for a wording.
TEMPLATES = {kind: "".join(f"{f}={{{f}}}\n" for f in fields) for kind, fields in prompts.FIELDS.items()}


def _sql(template: str, **fields: str) -> str:
    """A prompt template as a SQL expression."""
    from string import Formatter

    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if name is not None:
            parts.append(f"coalesce({fields[name]}, '')")
    return "(" + " || ".join(parts) + ")"


def _seen(df: DataFrame, *keys: str) -> DataFrame:
    """Prompts as length and md5."""
    return df.select(*keys, F.length("prompt").alias("chars"), F.md5("prompt").alias("prompt"))


def _seen_sql(prompt: str, keys: str, source: str) -> str:
    return f"SELECT {keys}, length(p)::INTEGER AS chars, md5(p) AS prompt FROM (SELECT *, {prompt} AS p FROM {source})"


_CAP = "CASE WHEN length({t}) <= {n} THEN {t} ELSE substring({t}, 1, {n}) || {note} END"


def _block_sql(t, n, label):
    return _CAP.format(t=t, n=n, note=f"chr(10) || '...[{label} truncated at {n} chars]...'")


# ---------------------------------------------------------------- samples


def sample_columns(spark, sf):
    """Which columns fit into a sample, for every file of the collection."""
    return prompts.sample_columns(cells(spark, sf)).drop("col_name")


SAMPLE_COLUMNS_SQL = f"""WITH {CELLS_SQL},
first AS (SELECT *, dense_rank() OVER (PARTITION BY ds ORDER BY row_no) AS r FROM cells),
w AS (SELECT ds, col, max(length(coalesce(CASE WHEN name = 'c_nationkey' THEN txt::DOUBLE::INT::VARCHAR ELSE txt END, 'nan')))::INTEGER AS widest FROM first WHERE r <= 5 GROUP BY ds, col)
SELECT ds AS dataset_id, col AS col_idx, widest, widest <= 2000 AND row_number() OVER (PARTITION BY ds, widest <= 2000 ORDER BY col) <= 10 AS kept FROM w"""


def sample_csv_text(spark, sf):
    # Rows are cut before they become cells.
    first = staged(spark, sf).where(F.col("row_idx") < prompts.SAMPLE_ROWS)
    head = materialize(collection_cells(first), "first-cells")
    return prompts.sample_csv(head).select("dataset_id", F.md5("sample").alias("sample"))


SAMPLE_CSV_SQL = f"""WITH {CELLS_SQL},
first AS (SELECT *, CASE WHEN name = 'c_nationkey' THEN txt::DOUBLE::INT::VARCHAR ELSE txt END AS v, dense_rank() OVER (PARTITION BY ds ORDER BY row_no) AS r FROM cells),
few AS (SELECT * FROM first WHERE r <= 5),
kept AS (SELECT ds, col, any_value(name) AS name FROM few GROUP BY ds, col HAVING max(length(coalesce(v, 'nan'))) <= 2000),
body AS (SELECT ds, r, string_agg(CASE WHEN v IS NULL THEN '' WHEN regexp_matches(v, '[,"\\r\\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END, ',' ORDER BY col) AS line
  FROM few SEMI JOIN kept USING (ds, col) GROUP BY ds, r),
head AS (SELECT ds, string_agg(name, ',' ORDER BY col) AS line FROM kept GROUP BY ds)
SELECT ds AS dataset_id, md5(any_value(head.line) || chr(10) || string_agg(body.line, chr(10) ORDER BY r) || chr(10)) AS sample FROM head JOIN body USING (ds) GROUP BY ds"""


def table_sample(spark, sf):
    """The sample of typed tables."""
    parts = [
        collection.table_cells(table(spark, sf, n), n, TYPED[n][0], prompts.SAMPLE_ROWS) for n in ("nation", "part", "customer")
    ]
    return prompts.sample_csv(reduce(DataFrame.unionByName, parts))


def _table_sample_sql(name):
    order, columns = TYPED[name]
    line = " || ',' || ".join(f"{c}::VARCHAR" for c in columns)
    return (
        f"SELECT '{name}' AS dataset_id, '{','.join(columns)}' || chr(10) || string_agg(line, chr(10) ORDER BY r) || chr(10) AS sample "
        f"FROM (SELECT {line} AS line, row_number() OVER (ORDER BY {', '.join(order)}) AS r FROM {name}) WHERE r <= 5"
    )


# ---------------------------------------------------------------- text limits and prompts


def json_blocks(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(cap_block(t, 8000, "content_profile")).alias("block"),
        F.md5(cap_block(t, 4000, "semantic_profile")).alias("small"),
        F.md5(cap_domain_block(t, 8000)).alias("domain"),
    )


def prompt_limit(spark, sf):
    """The prompt limit, at its default size and at one that many texts exceed."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(cap_prompt(F.col("text"))).alias("whole"), F.md5(cap_prompt(F.col("text"), 2500)).alias("cut"))


def prompt_header_sample(spark, sf):
    d = registry(spark, sf)
    headers = F.split("description", " ")
    return _seen(d.select("id", prompts.header_sample_prompt(headers, F.col("description"), TEMPLATES["hs"]).alias("prompt")), "id")


def prompt_semantic(spark, sf):
    names = ["customer", "part", "supplier"]
    parts = [P.profile_table(table(spark, sf, n), n, TYPED[n][0]) for n in names]
    chosen = S.choose_columns(reduce(DataFrame.unionByName, parts), 12)
    return _seen(prompts.semantic_prompt(chosen, TEMPLATES["semantic"], TEMPLATES["semantic_block"]), "dataset_id")


def _semantic_sql():
    cols = []
    for n in ("customer", "part", "supplier"):
        order, columns = TYPED[n]
        for i, (c, kind) in enumerate(columns.items()):
            ratio = f"(SELECT count(DISTINCT {c}) / count(*) FROM {n})"
            ex = f"(SELECT '[' || string_agg('\"' || {c}::VARCHAR || '\"', ',' ORDER BY r) || ']' FROM (SELECT {c}, row_number() OVER (ORDER BY {order[0]}) AS r FROM {n}) WHERE r <= 5)"
            coarse = "text" if kind == "string" else "numeric"
            cols.append(f"SELECT '{n}' AS dataset_id, {i} AS i, '{c}' AS name, '{coarse}' AS coarse, {ratio} AS ratio, {ex} AS ex")
    block = _sql(TEMPLATES["semantic_block"], name="name", coarse="coarse", examples="ex")
    return (
        "WITH cols AS (" + " UNION ALL ".join(cols) + f"), blocks AS (SELECT dataset_id, string_agg({block}, chr(10) ORDER BY i) AS b FROM cols WHERE ratio <= 0.9 GROUP BY 1) "
        + _seen_sql(_sql(TEMPLATES["semantic"], column_blocks="b"), "dataset_id", "blocks")
    )


def prompt_user_focused(spark, sf):
    """With a limit that makes use of all three sizes."""
    d = table(spark, sf, "documents")
    t = F.col("text")
    return _seen(d.select("doc_id", prompts.user_focused_prompt(F.col("source"), t, t, t, TEMPLATES["ufd"], limit=USER_LIMIT).alias("prompt")), "doc_id")


USER_LIMIT = 9000


def _user_sql():
    def prompt(sample, n):
        return _sql(
            TEMPLATES["ufd"],
            topic="source",
            sample=sample,
            content_profile=_block_sql("text", n, "content_profile"),
            semantic_profile=_block_sql("text", n, "semantic_profile"),
        )

    note = "'# Sample omitted due to size limits.' || chr(10)"
    full, bare, small = prompt("text", 8000), prompt(note, 8000), prompt(note, 4000)
    return _seen_sql(
        f"CASE WHEN length({full}) <= {USER_LIMIT} THEN {full} WHEN length({bare}) <= {USER_LIMIT} THEN {bare} ELSE {small} END", "doc_id", "documents"
    )


def prompt_search_focused(spark, sf):
    d = table(spark, sf, "documents")
    return _seen(d.select("doc_id", prompts.search_focused_prompt(F.col("source"), F.col("text"), TEMPLATES["sfd"]).alias("prompt")), "doc_id")


def _domain(spark, sf):
    return registry(spark, sf).withColumns({"topic": catalog.topic(F.col("category"), F.lit("a b c d")), "category": F.nullif("category", F.lit("fr"))})


def prompt_domain_user(spark, sf):
    t = F.col("description")
    return _seen(_domain(spark, sf).select("id", prompts.domain_user_prompt(t, t, t, TEMPLATES["ufd_nyc"]).alias("prompt")), "id")


def prompt_domain_search(spark, sf):
    return _seen(_domain(spark, sf).select("id", prompts.domain_search_prompt(F.col("description"), TEMPLATES["sfd_nyc"]).alias("prompt")), "id")


_DOMAIN_SQL = """(SELECT doc_id::VARCHAR AS id, text, coalesce(nullif(source, 'src3'), 'NYC Agency') AS agency,
  CASE WHEN lang = 'en' THEN '' WHEN lang = 'fr' THEN 'General' ELSE lang END AS category, CASE WHEN lang = 'en' THEN 'a b c' ELSE lang END AS topic FROM documents)"""
_DOMAIN_BLOCK = _CAP.format(t="text", n=8000, note="'...(truncated)'")


def prompt_grade(spark, sf):
    """Every text variant long enough to grade: name, description and source of each document."""
    r = registry(spark, sf).withColumn("title", F.nullif("category", F.lit("de")))
    variants = grading.description_variants(r.select("id", "title", "columns", "description", "name", "agency"), {"original": "description", "ufd": "name", "sfd": "agency"})
    return _seen(variants.select("id", "method", prompts.grade_prompt(F.col("title"), F.col("columns"), F.col("text"), TEMPLATES["grade"]).alias("prompt")), "id", "method")


GRADE_SQL = """WITH d AS (SELECT doc_id::VARCHAR AS id, text, source, lang, split_part(text, '.', 1) AS name, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, 'de'), 'Unknown') AS title,
  'doc_id, ' || source || ', ' || lang AS cols FROM documents),
v AS (SELECT id, 'original' AS method, title, cols, text AS t FROM d UNION ALL SELECT id, 'ufd', title, cols, name FROM d UNION ALL SELECT id, 'sfd', title, cols, nullif(source, 'src3') FROM d)
""" + _seen_sql(_sql(TEMPLATES["grade"], title="title", columns="cols", description="t"), "id, method", "v") + " WHERE length(t) >= 5"


def prompt_relevance(spark, sf):
    """The judged choice of 50 datasets with every query."""
    chosen = catalog.choose_datasets(registry(spark, sf), 50, 42)
    return _seen(evaluate.relevance_prompts(chosen, benchmark_queries(spark, sf), TEMPLATES["relevance"]), "dataset_id", "query_id")


RELEVANCE_SQL = """WITH d AS (SELECT doc_id::VARCHAR AS dataset_id, text, split_part(text, '.', 1) AS name, CASE WHEN lang = 'en' THEN '' ELSE lang END AS category, nullif(source, 'src3') AS agency,
  'doc_id, ' || source || ', ' || lang AS cols FROM documents ORDER BY md5('42:' || doc_id), doc_id::VARCHAR LIMIT 50),
pairs AS (SELECT d.*, 'query_' || (item_id + 1) AS query_id, b.text AS query FROM d, benchmark b)
""" + _seen_sql(
    _sql(TEMPLATES["relevance"], query="query", name="name", category="category", agency="agency", columns="cols", description="text"), "dataset_id, query_id", "pairs"
)


# ---------------------------------------------------------------- replies


def semantic_replies(spark, sf):
    """One semantic reply per document: clean, wrapped in prose, with trailing commas, or none at all."""
    d = table(spark, sf, "documents").where(F.col("source").isNotNull())
    one = F.concat(
        F.lit('{"name": "'), F.col("lang"), F.lit('", "semantic": {"is_temporal": true, "temporal_resolution": "day", "is_spatial": false, "entity_type": "'),
        F.col("source"), F.lit('"}}'),
    )
    two = F.concat(F.lit('{"name": "text", "semantic": {"entity_type": "'), F.col("n_chars").cast("string"), F.lit('"}}'))
    nameless = F.lit('{"semantic": {"entity_type": "lost"}}')
    again = F.lit('{"name": "text", "semantic": {"entity_type": "again", "is_spatial": true}}')
    kind = F.col("doc_id") % 5
    body = F.concat(F.lit('{"columns": ['), one, F.lit(", "), two, F.lit(", "), nameless, F.lit("]}"))
    reply = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit('{"columns": ['), one, F.lit(", "), two, F.lit(", "), again, F.lit(", ], }")))
        .when(kind == 3, F.lit("I cannot answer that."))
        .otherwise(F.concat(F.lit("{"), F.col("lang")))
    )
    return d.select(F.col("doc_id").cast("string").alias("dataset_id"), reply.alias("reply"))


def parse_semantic(spark, sf):
    parsed = parsing.semantic_columns(semantic_replies(spark, sf))
    return parsed.select("dataset_id", "name", "semantic.is_temporal", "semantic.temporal_resolution", "semantic.is_spatial", "semantic.entity_type", "semantic.function_or_usage")


PARSE_SEMANTIC_SQL = """SELECT doc_id::VARCHAR AS dataset_id, lang AS name, true AS is_temporal, 'day' AS temporal_resolution, false AS is_spatial, source AS entity_type, NULL::VARCHAR AS function_or_usage
FROM documents WHERE doc_id % 5 <= 2
UNION ALL SELECT doc_id::VARCHAR, 'text', NULL, NULL, CASE WHEN doc_id % 5 = 2 THEN true END, CASE WHEN doc_id % 5 = 2 THEN 'again' ELSE n_chars::VARCHAR END, NULL FROM documents WHERE doc_id % 5 <= 2"""


def semantic_join(spark, sf):
    """Columns of every document's table with their semantics, or the stub where the reply has none."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dataset_id"), "lang")
    names = F.posexplode(F.array(F.col("lang"), F.lit("text"), F.lit("other"))).alias("col_idx", "name")
    profile = d.select("dataset_id", names).withColumns({"coarse_type": F.lit("text"), "example_values": F.array(F.lit("x"))})
    out = S.semantic_profile(profile, semantic_replies(spark, sf))
    return out.select("dataset_id", "col_idx", "name", "semantic.entity_type", "semantic.skipped_for_quota", "semantic_profiled")


SEMANTIC_JOIN_SQL = """WITH c AS (SELECT doc_id, source, n_chars, unnest([{'i': 0, 'n': lang}, {'i': 1, 'n': 'text'}, {'i': 2, 'n': 'other'}]) AS x FROM documents),
p AS (SELECT *, doc_id % 5 <= 2 AND x.i < 2 AS found FROM c)
SELECT doc_id::VARCHAR AS dataset_id, x.i AS col_idx, x.n AS name,
CASE WHEN NOT found THEN 'unknown' WHEN x.i = 0 THEN source WHEN doc_id % 5 = 2 THEN 'again' ELSE n_chars::VARCHAR END AS entity_type,
CASE WHEN NOT found THEN true END AS skipped_for_quota, found AS semantic_profiled FROM p"""


def grade_replies(spark, sf):
    """One grade reply per labelled document and method: full, lacking a key, with a null, empty or no JSON."""
    labels = table(spark, sf, "labels")
    method = F.explode(F.array(*[F.lit(m) for m in ("original", "ufd", "sfd")])).alias("method")
    rows = labels.select("doc_id", "quality", "toxic", method)
    kind = (F.col("doc_id") + F.length("method")) % 6
    a, b = (F.col("quality") + 3).cast("string"), (F.lit(5) - F.col("toxic") * 2).cast("string")
    full = F.concat(F.lit('{"readability": '), a, F.lit(', "faithfulness": '), b, F.lit(', "completeness": 2, "conciseness": 4}'))
    reply = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("Sure!\n"), full, F.lit("\nThat is all.")))
        .when(kind == 2, F.concat(F.lit('{"readability": '), a, F.lit("}")))
        .when(kind == 3, F.concat(F.lit('{"readability": null, "faithfulness": '), b, F.lit(', "completeness": 1, "conciseness": 1}')))
        .when(kind == 4, F.lit("{}"))
        .otherwise(F.lit("no grades today"))
    )
    return rows.select(F.col("doc_id").cast("string").alias("dataset_id"), "method", reply.alias("reply"))


def parse_grades(spark, sf):
    return grading.grades_long(grade_replies(spark, sf))


def mean_grades(spark, sf):
    means = grading.mean_grades(grading.grades_long(grade_replies(spark, sf)))
    return means.select("method", "metric", F.round("score", 6).alias("score"))


_GRADES_SQL = """g AS (SELECT doc_id, method, (quality + 3)::DOUBLE AS a, (5 - toxic * 2)::DOUBLE AS b, (doc_id + length(method)) % 6 AS kind FROM labels, (SELECT unnest(['original', 'ufd', 'sfd']) AS method)),
grades AS (
  SELECT doc_id, method, 'readability' AS metric, a AS score FROM g WHERE kind IN (0, 1, 2)
  UNION ALL SELECT doc_id, method, 'faithfulness', CASE WHEN kind = 2 THEN 3.0 ELSE b END FROM g WHERE kind <= 3
  UNION ALL SELECT doc_id, method, 'completeness', CASE kind WHEN 2 THEN 3.0 WHEN 3 THEN 1.0 ELSE 2.0 END FROM g WHERE kind <= 3
  UNION ALL SELECT doc_id, method, 'conciseness', CASE kind WHEN 2 THEN 3.0 WHEN 3 THEN 1.0 ELSE 4.0 END FROM g WHERE kind <= 3)"""
_MEANS_SQL = """means AS (SELECT m AS method, k AS metric, coalesce(avg(score), 0.0) AS score
  FROM (SELECT unnest(['original', 'ufd', 'sfd', 'ufd_nyc', 'sfd_nyc']) AS m), (SELECT unnest(['readability', 'faithfulness', 'completeness', 'conciseness']) AS k)
  LEFT JOIN grades ON grades.method = m AND grades.metric = k GROUP BY m, k)"""


def _search_scores(spark, sf):
    """Search quality per method from the labels: the mean quality at 10, the mean toxicity at 20, none for two methods."""
    labels = table(spark, sf, "labels").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("method"), F.lit(k).alias("k"), v.cast("double").alias("ndcg"))
                for m, ten, twenty in (("original", F.col("q"), F.col("t")), ("ufd", F.lit(0.0), F.col("t")), ("ufd_nyc", F.col("t"), F.col("q")), ("sfd_nyc", F.lit(0.0), F.lit(0.0)))
                for k, v in ((10, ten), (20, twenty))
            ]
        )
    )
    return labels.select(rows.alias("r")).select("r.*")


def method_summary(spark, sf):
    means = grading.mean_grades(grading.grades_long(grade_replies(spark, sf)))
    out = grading.method_summary(_search_scores(spark, sf), means)
    return out.select("pos", "method", *[F.round(c, 6).alias(c) for c in ("ndcg", *parsing.METRICS, "closing")])


METHOD_SUMMARY_SQL = f"""WITH {_GRADES_SQL}, {_MEANS_SQL},
l AS (SELECT avg(quality) AS q, avg(toxic) AS t FROM labels),
s AS (SELECT 0 AS pos, 'original' AS method, q AS ndcg FROM l UNION ALL SELECT 1, 'ufd', t FROM l UNION ALL SELECT 2, 'sfd', 0.0 FROM l UNION ALL SELECT 3, 'ufd_nyc', t FROM l),
w AS (SELECT method, max(score) FILTER (metric = 'readability') / 5 AS r, max(score) FILTER (metric = 'faithfulness') / 5 AS f,
  max(score) FILTER (metric = 'completeness') / 5 AS cm, max(score) FILTER (metric = 'conciseness') / 5 AS cc FROM means GROUP BY method)
SELECT pos, method, round(ndcg, 6) AS ndcg, round(r, 6) AS readability, round(f, 6) AS faithfulness, round(cm, 6) AS completeness, round(cc, 6) AS conciseness, round(ndcg, 6) AS closing
FROM s JOIN w USING (method)"""


def parse_relevance(spark, sf):
    """The first 0, 1 or 2 of every document's text, read as a judge's reply."""
    return table(spark, sf, "documents").select("doc_id", parsing.relevance_score(F.col("text")).alias("rel"))


# ---------------------------------------------------------------- generation


def hashing_backend():
    """Stands in for a model: the reply is the start of the prompt's md5, spaced out; German prompts fail."""
    import hashlib

    def backend(batch, temperature):
        if any(p.startswith("de") for p in batch):
            raise ValueError("unsupported language")
        return [f"  {hashlib.md5(p.encode()).hexdigest()[:12]}\n" for p in batch]

    return backend


def generate_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "lang", "text").alias("prompt"))
    return generate.generate(d, hashing_backend, ["doc_id"], concurrency=4).drop("seconds", "truncated")


def fixed_backend():
    """Stands in for a model: one fixed text per kind of request."""

    def backend(batch, temperature):
        return ["asked" if temperature == 0.0 else "written" for _ in batch]

    return backend


def flaky_backend():
    """As the fixed one, but it fails for about half of the texts it is asked to write."""
    import hashlib

    def backend(batch, temperature):
        if temperature > 0 and any(hashlib.md5(p.encode()).hexdigest() < "8" for p in batch):
            raise ConnectionError("no answer")
        return ["asked" if temperature == 0.0 else "written" for _ in batch]

    return backend


def _described(spark, sf, first_backend, cap, **more):
    """The last record of every dataset after two runs, the first one with ``cap`` datasets; five ids have no file."""
    root = csv_collection(spark, sf)
    known = reduce(DataFrame.unionByName, [df.select("dataset_id").distinct() for df, _ in csv_sources(spark, sf)])
    absent = table(spark, sf, "region").select(F.concat(F.lit("absent-"), "r_regionkey").alias("dataset_id"))
    reg = known.unionByName(absent).select(
        F.col("dataset_id").alias("id"),
        # Datasets without a file lie among the first ones.
        F.when(F.startswith("dataset_id", F.lit("absent")), F.crc32("dataset_id") % 8).otherwise(F.crc32("dataset_id")).alias("ord"),
        F.concat(F.lit("Rows of "), "dataset_id", F.lit(" and more")).alias("name"),
        F.lit("").alias("description"),
        F.when(F.startswith("dataset_id", F.lit("orders")), F.lit("sales")).alias("category"),
        F.lit(None).cast("string").alias("agency"),
        F.array(F.lit("a")).alias("columns"),
    )
    out = new_path(spark, "descriptions")
    files = {"dataset_pattern": DATASET_DIR, "recursive": True, **more}
    first = describe.describe_collection(spark, reg, [root], out, first_backend, TEMPLATES, max_datasets=cap, **files)
    second = describe.describe_collection(spark, reg, [root], out, fixed_backend, TEMPLATES, **files)
    both = first.withColumn("ord", F.lit(0)).unionByName(second.withColumn("ord", F.lit(1)), allowMissingColumns=True)
    return last_by_key(both, "dataset_id", "ord").select("dataset_id", "status", "title", "topic", "ufd_nyc", "sfd_nyc")


def describe_collection(spark, sf):
    """The whole way from CSV files to records, in two runs; the second does what the first left over."""
    return _described(spark, sf, fixed_backend, 10)


def describe_resume_cap(spark, sf):
    """As before, but the first run's cap reaches past missing files and its backend fails midway."""
    return _described(spark, sf, flaky_backend, 4)


def describe_batches(spark, sf):
    """As before in batches of 50 datasets; all files are parsed once, and the second run asks what the first has no reply for."""
    return _described(spark, sf, flaky_backend, 120, batch_datasets=50)


DESCRIBE_SQL = """WITH ids AS (SELECT DISTINCT 'orders-' || (o_orderkey // 100) AS id FROM orders UNION ALL SELECT DISTINCT 'customer-' || (c_custkey // 100) FROM customer
  UNION ALL SELECT DISTINCT 'documents-' || (doc_id // 100) FROM documents)
SELECT id AS dataset_id, 'ok' AS status, 'Rows of ' || id || ' and more' AS title, CASE WHEN starts_with(id, 'orders') THEN 'sales' ELSE 'Rows of ' || id END AS topic,
  'written' AS ufd_nyc, 'written' AS sfd_nyc FROM ids
UNION ALL SELECT 'absent-' || r_regionkey, 'missing_csv', NULL, NULL, NULL, NULL FROM region"""


QUERIES = {
    "sample_columns_choice": sample_columns,
    "sample_csv_text": sample_csv_text,
    "sample_csv_typed": table_sample,
    "json_block_truncate": json_blocks,
    "prompt_truncate": prompt_limit,
    "prompt_header_sample": prompt_header_sample,
    "prompt_semantic": prompt_semantic,
    "prompt_user_focused": prompt_user_focused,
    "prompt_search_focused": prompt_search_focused,
    "prompt_domain_user": prompt_domain_user,
    "prompt_domain_search": prompt_domain_search,
    "prompt_grade": prompt_grade,
    "prompt_relevance": prompt_relevance,
    "parse_semantic_reply": parse_semantic,
    "semantic_profile_join": semantic_join,
    "parse_grade_reply": parse_grades,
    "grade_means": mean_grades,
    "method_summary": method_summary,
    "parse_relevance_reply": parse_relevance,
    "generate_stub": generate_rows,
    "describe_collection": describe_collection,
    "describe_resume_cap": describe_resume_cap,
    "describe_batches": describe_batches,
}
ORACLES = {
    "sample_columns_choice": SAMPLE_COLUMNS_SQL,
    "sample_csv_text": SAMPLE_CSV_SQL,
    "sample_csv_typed": " UNION ALL ".join(_table_sample_sql(n) for n in ("nation", "part", "customer")),
    "json_block_truncate": f"""SELECT doc_id, md5({_block_sql('text', 8000, 'content_profile')}) AS block, md5({_block_sql('text', 4000, 'semantic_profile')}) AS small,
md5({_DOMAIN_BLOCK}) AS domain FROM documents""",
    "prompt_truncate": """SELECT doc_id, md5(CASE WHEN length(text) <= 120000 THEN text END) AS whole, md5(CASE WHEN length(text) <= 2500 THEN text
ELSE substring(text, 1, 2500) || chr(10) || chr(10) || '...[prompt truncated from ' || length(text) || ' to 2500 chars]...' END) AS cut FROM documents""",
    "prompt_header_sample": _seen_sql(_sql(TEMPLATES["hs"], headers="replace(text, ' ', ', ')", sample="text"), "doc_id::VARCHAR AS id", "documents"),
    "prompt_semantic": _semantic_sql(),
    "prompt_user_focused": _user_sql(),
    "prompt_search_focused": _seen_sql(_sql(TEMPLATES["sfd"], topic="source", ufd="text"), "doc_id", "documents"),
    "prompt_domain_user": _seen_sql(
        _sql(TEMPLATES["ufd_nyc"], agency="agency", category="category", topic="topic", sample="text", content_profile=_DOMAIN_BLOCK, semantic_profile=_DOMAIN_BLOCK), "id", _DOMAIN_SQL
    ),
    "prompt_domain_search": _seen_sql(_sql(TEMPLATES["sfd_nyc"], agency="agency", category="category", ufd_nyc="text"), "id", _DOMAIN_SQL),
    "prompt_grade": GRADE_SQL,
    "prompt_relevance": RELEVANCE_SQL,
    "parse_semantic_reply": PARSE_SEMANTIC_SQL,
    "semantic_profile_join": SEMANTIC_JOIN_SQL,
    "parse_grade_reply": f"WITH {_GRADES_SQL} SELECT doc_id::VARCHAR AS dataset_id, method, metric, score FROM grades",
    "grade_means": f"WITH {_GRADES_SQL}, {_MEANS_SQL} SELECT method, metric, round(score, 6) AS score FROM means",
    "method_summary": METHOD_SUMMARY_SQL,
    "parse_relevance_reply": "SELECT doc_id, coalesce(nullif(regexp_extract(text, '[012]', 0), '')::INTEGER, 0) AS rel FROM documents",
    "generate_stub": """SELECT doc_id, CASE WHEN lang <> 'de' THEN substring(md5(lang || ' ' || text), 1, 12) END AS reply, CASE WHEN lang <> 'de' THEN 'ok' ELSE 'error' END AS status,
CASE WHEN lang = 'de' THEN 'ValueError: unsupported language' END AS error FROM documents""",
    "describe_collection": DESCRIBE_SQL,
    "describe_resume_cap": DESCRIBE_SQL,
    "describe_batches": DESCRIBE_SQL,
}
