"""Files of the registry, queries, results and logs, broken collections, repeated ids, and chains of generation and judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescribe.operators import catalog as C
from tablescribe.operators import generate, grading, runlog
from tablescribe.operators import profile as P
from tablescribe.operators import triage as T
from tablescribe.plans import evaluate
from tablescribe.session import materialize, new_path
from tablescribe.sources import collection, records

from .catalogs import _REG, _TOPIC, ids, registry
from .prompting import TEMPLATES, _sql
from .search import benchmark_queries
from .tables import table


def registry_read(spark, sf):
    """A registry file with one entry per customer, read with its positions."""
    path = new_path(spark, "registry")
    c = table(spark, sf, "customer")
    entry = F.to_json(F.struct(F.col("c_name").alias("id"), F.col("c_mktsegment").alias("category"), F.array("c_mktsegment", F.lit('a "b"')).alias("columns"), F.col("c_custkey").alias("page_views")))
    # One JSON array in several files, in the order of their names.
    keys = c.agg(F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))
    line = F.concat(F.when(F.col("c_custkey") == F.col("first"), "[\n").otherwise(""), "json", F.when(F.col("c_custkey") == F.col("last"), "\n]").otherwise(","))
    lines = c.select("c_custkey", entry.alias("json")).join(F.broadcast(keys), F.col("c_custkey").between(F.col("first"), F.col("last")))
    lines.orderBy("c_custkey").select(line.alias("value")).write.text(path)
    return records.read_registry(spark, path).select("ord", "id", "category", F.array_join("columns", "|").alias("columns"), "page_views")


def results_read(spark, sf):
    """Results per language and source, written as one nested JSON object and read back."""
    path = new_path(spark, "results")
    r = table(spark, sf, "documents").groupBy(F.col("lang").alias("method"), F.col("source").alias("metric")).agg(F.sum("n_chars").cast("double").alias("value"))
    records.write_results(r, path)
    return records.read_results(spark, path)


def queries_read(spark, sf):
    """A query file with an item per line, blank lines between them."""
    path = new_path(spark, "queries")
    items = table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", r"\s+", " ").alias("line"))
    items.orderBy("item_id").coalesce(1).select(F.concat(F.lit("  \n "), "line", F.lit(" ")).alias("value")).write.text(path)
    return records.read_queries(spark, path).select("query_no", "query_id", "text")


def jsonl_strict(spark, sf):
    path = new_path(spark, "jsonl")
    records.append_jsonl(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("dataset_id"), F.col("o_orderstatus").alias("status")), path)
    return records.read_jsonl(spark, path, "dataset_id string, status string, error string", strict=True).drop("ord")


def runtime_log(spark, sf):
    """Runtimes appended to the log, rounded to milliseconds."""
    path = new_path(spark, "runtimes")
    runlog.append_runtimes(table(spark, sf, "events").select(F.col("event_id").cast("string").alias("dataset_id"), F.round("value", 2).alias("runtime_sec")), path)
    return spark.read.schema("dataset_id string, runtime_sec double").json(path)


def sample_all(spark, sf):
    """More rows wanted than there are, and less than none."""
    c = table(spark, sf, "customer").select("c_custkey")
    return T.random_sample(c, 10**9, "c_custkey").unionByName(T.random_sample(c, -5, "c_custkey"))


def collection_error_rows(spark, sf):
    """One CSV file per nation with its customers: some have a row that is too long, some an id twice, some no file, some are wide."""
    base = new_path(spark, "broken")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.concat_ws(",", "c_custkey", "c_name", "c_acctbal").alias("value"))
    kind = F.col("c_nationkey") % 5
    long = F.when(kind == 1, F.concat("value", F.lit(",more,fields"))).when(kind == 4, F.concat("value", F.lit(",x" * 97))).otherwise(F.col("value"))
    head = F.when(kind == 4, F.lit("a,b,c" + "".join(f",c{i}" for i in range(97)))).otherwise(F.lit("a,b,c"))
    # The header is a row of its own, first by its place; rows go to the files in order, without being collected.
    heads = c.select("c_nationkey").distinct().select("c_nationkey", F.lit(-1).cast("long").alias("place"), head.alias("value"))
    rows = heads.unionByName(c.select("c_nationkey", F.col("c_custkey").alias("place"), long.alias("value"))).where(kind != 3)
    lines = rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "place").select("c_nationkey", "value")
    lines.write.partitionBy("c_nationkey").text(f"{base}/a")
    lines.where(kind == 2).write.partitionBy("c_nationkey").text(f"{base}/b")
    staged = collection.stage_collection(spark, [f"{base}/a", f"{base}/b"], r"c_nationkey=(\d+)/")
    listing = staged.select("dataset_id", F.lit(0).alias("root_priority"), "path").distinct()
    wanted = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("dataset_id")).distinct()
    out = collection.collection_status(wanted, listing, P.minimal_profile(staged))
    return out.select("dataset_id", "status", "row_count", "column_count", "error")


COLLECTION_ERRORS_SQL = """SELECT c_nationkey::VARCHAR AS dataset_id, CASE c_nationkey % 5 WHEN 3 THEN 'missing_csv' WHEN 1 THEN 'error' WHEN 2 THEN 'error' ELSE 'ok' END AS status,
CASE WHEN c_nationkey % 5 IN (0, 4) THEN count(*) END AS row_count, CASE c_nationkey % 5 WHEN 0 THEN 3 WHEN 4 THEN 100 END::INTEGER AS column_count,
CASE c_nationkey % 5 WHEN 3 THEN 'no CSV file for ' || c_nationkey WHEN 1 THEN 'expected 3 fields, saw 5' WHEN 2 THEN 'several files have this dataset id' END AS error
FROM customer GROUP BY c_nationkey"""


def _write_gzip(base):
    """Writes ``value`` lines, in order of nation and place, to a compressed file per nation; some are then damaged."""
    import gzip

    from pyarrow import fs

    def write(batches):
        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        nation, lines = None, []

        def close():
            half = len(lines) // 2
            whole = gzip.compress("".join(lines).encode())
            if nation % 5 == 1:  # cut short
                whole = whole[:-20]
            elif nation % 5 == 2:  # a bit changed
                whole = whole[: len(whole) // 2] + bytes([whole[len(whole) // 2] ^ 4]) + whole[len(whole) // 2 + 1 :]
            elif nation % 5 == 3:  # two members, one behind the other
                whole = gzip.compress("".join(lines[:half]).encode()) + gzip.compress("".join(lines[half:]).encode())
            plain = nation % 5 == 4
            with store.open_output_stream(f"{folder}/{nation}.csv" + ("" if plain else ".gz"), compression=None) as f:
                f.write("".join(lines).encode() if plain else whole)

        for batch in batches:
            for n, line in zip(batch["c_nationkey"], batch["value"]):
                if n != nation and nation is not None:
                    close()
                    lines = []
                nation = n
                lines.append(line + "\n")
            yield batch[["c_nationkey"]]
        if nation is not None:
            close()

    return write


def collection_damaged_files(spark, sf):
    """A compressed CSV file per nation with its customers: some are cut short, some have a bit changed, some are of two members."""
    base = new_path(spark, "damaged")
    c = table(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").alias("place"), F.concat_ws(",", "c_custkey", "c_name", "c_acctbal").alias("value"))
    heads = c.select("c_nationkey").distinct().select("c_nationkey", F.lit(-1).cast("long").alias("place"), F.lit("a,b,c").alias("value"))
    lines = heads.unionByName(c).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "place").select("c_nationkey", "value")
    uri = base if ":" in base else f"file:{base}"
    materialize(lines.mapInPandas(_write_gzip(uri), "c_nationkey long"), "written")
    staged = collection.stage_collection(spark, base, r"(\d+)\.csv(?:\.gz)?$")
    return P.minimal_profile(staged).select("dataset_id", "status", "row_count", "column_count", "error")


DAMAGED_SQL = """SELECT c_nationkey::VARCHAR AS dataset_id, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, CASE WHEN NOT bad THEN n END AS row_count,
CASE WHEN NOT bad THEN 3 END::INTEGER AS column_count, CASE WHEN bad THEN 'the compressed file is damaged' END AS error
FROM (SELECT c_nationkey, c_nationkey % 5 IN (1, 2) AS bad, count(*) AS n FROM customer GROUP BY c_nationkey)"""


def metadata_join_repeated(spark, sf):
    """A registry in which older entries of the same ids precede the current ones."""
    reg = registry(spark, sf)
    older = reg.withColumns({"ord": F.col("ord") - 10**9, "name": F.lit("older"), "category": F.lit("older")})
    joined = C.with_metadata(ids(spark, sf), older.unionByName(reg))
    return joined.select("dataset_id", F.md5("title").alias("title"), "topic", "agency", F.md5("original").alias("original"))


METADATA_REPEATED_SQL = f"""WITH {_REG} SELECT id AS dataset_id, md5(coalesce(name, '')) AS title, {_TOPIC.format(category='category', name='name')} AS topic, agency, md5(coalesce(description, '')) AS original FROM reg"""


def description_variants_join(spark, sf):
    """Registry and descriptions that repeat ids: every turn of a conversation is a record of it."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("dataset_id"), F.col("turn").alias("ord"), "role", "text")
    reg = c.select(F.col("dataset_id").alias("id"), F.col("role").alias("name"), F.array("role").alias("columns"), F.col("text").alias("description"), "ord")
    baseline = c.select("dataset_id", F.col("text").alias("ufd"), F.col("role").alias("sfd"), "ord")
    domain = c.select("dataset_id", F.col("role").alias("ufd_nyc"), F.reverse("text").alias("sfd_nyc"), (-F.col("ord")).alias("ord"))
    out = grading.join_variants(c.select("dataset_id"), reg, baseline, domain)
    return out.select("dataset_id", "title", *[F.md5(x).alias(x) for x in ("original", "ufd", "sfd", "ufd_nyc", "sfd_nyc")])


VARIANTS_SQL = """WITH v AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, arg_min(role, turn) AS role0, arg_min(text, turn) AS text0 FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS dataset_id, role AS title, md5(text) AS original, md5(text) AS ufd, md5(role) AS sfd, md5(role0) AS ufd_nyc, md5(reverse(text0)) AS sfd_nyc FROM v"""


def generate_quota(spark, sf):
    """A backend without quota asked by four tasks: after the first error no task begins another call, so each has at most one."""

    def make():
        def backend(batch, temperature):
            raise RuntimeError("HTTP 429")

        return backend

    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    out = generate.generate(d, make, ["doc_id"], concurrency=4, min_interval=0.01)
    counts = out.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("rows"))
    asked = F.sum(F.when(F.col("error") == "RuntimeError: HTTP 429", F.col("rows")))
    return counts.agg(asked.between(1, 4).alias("few_asked"), F.sum("rows").alias("rows"), F.count_if(~F.col("error").isin("none", "RuntimeError: HTTP 429")).alias("other_errors"))


def digest_judge():
    """Stands in for a judge: relevance and grades from the digest of the prompt."""
    import hashlib

    def backend(batch, temperature):
        marks = [int(hashlib.md5(p.encode()).hexdigest()[0], 16) for p in batch]
        return [f"relevance {m % 3}" if p.startswith("query=") else f'{{"readability": {m % 5 + 1}, "completeness": {m % 4 + 1}}}' for p, m in zip(batch, marks)]

    return backend


def judge_chain(spark, sf):
    """Prompts, judge and parser for the choice of 50 datasets and all queries; calls of several threads."""
    return evaluate.judge_relevance(registry(spark, sf), benchmark_queries(spark, sf), digest_judge, TEMPLATES["relevance"])


JUDGE_SQL = """WITH d AS (SELECT doc_id::VARCHAR AS dataset_id, text, split_part(text, '.', 1) AS name, CASE WHEN lang = 'en' THEN '' ELSE lang END AS category, nullif(source, 'src3') AS agency,
  'doc_id, ' || source || ', ' || lang AS cols FROM documents ORDER BY md5('42:' || doc_id), doc_id::VARCHAR LIMIT 50),
pairs AS (SELECT d.*, 'query_' || (item_id + 1) AS query_id, b.text AS query FROM d, benchmark b)
SELECT query_id, dataset_id, (('0x' || substr(md5({p}), 1, 1))::INTEGER % 3)::INTEGER AS rel FROM pairs""".format(
    p=_sql(TEMPLATES["relevance"], query="query", name="name", category="category", agency="agency", columns="cols", description="text")
)


def grade_chain(spark, sf):
    """Prompts, grader and parser for the text variants of all conversations."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("dataset_id"), F.col("turn").alias("ord"), "role", "text")
    reg = c.select(F.col("dataset_id").alias("id"), F.col("role").alias("name"), F.array("role").alias("columns"), F.col("text").alias("description"), "ord")
    baseline = c.select("dataset_id", F.col("text").alias("ufd"), F.lit("tiny").alias("sfd"), (-F.col("ord")).alias("ord"))
    return evaluate.grade_texts(c.select("dataset_id"), reg, baseline, None, digest_judge, TEMPLATES["grade"])


_GRADE = _sql(TEMPLATES["grade"], title="role", columns="role", description="t")
GRADE_CHAIN_SQL = f"""WITH v AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, arg_min(text, turn) AS text0 FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, role, 'original' AS method, text AS t FROM v UNION ALL SELECT conv_id, role, 'ufd', text0 FROM v),
m AS (SELECT conv_id, method, ('0x' || substr(md5({_GRADE}), 1, 1))::INTEGER AS m FROM t WHERE length(t) >= 5)
SELECT conv_id::VARCHAR AS dataset_id, method, 'readability' AS metric, (m % 5 + 1)::DOUBLE AS score FROM m UNION ALL SELECT conv_id::VARCHAR, method, 'completeness', (m % 4 + 1)::DOUBLE FROM m
UNION ALL SELECT conv_id::VARCHAR, method, unnest(['faithfulness', 'conciseness']), 3.0 FROM m"""


def keyword_score_many(spark, sf):
    """A thousand keywords: the names of customers, numbered, and three words that occur."""
    many = [f"customer {i}" for i in range(997)] + ["the", "tion", "http"]
    return table(spark, sf, "documents").select("doc_id", T.keyword_score(F.col("text"), many).alias("keyword_score"))


def sample_stratified_large(spark, sf):
    return T.stratified_sample(table(spark, sf, "orders"), 2_000, "o_orderkey", "o_orderpriority", 50, seed=5).select("o_orderkey", "o_orderpriority")


def sample_cluster_large(spark, sf):
    return T.cluster_diverse_sample(table(spark, sf, "orders"), 2_000, "o_orderkey", "o_custkey", 3, seed=5).select("o_orderkey", "o_custkey")


QUERIES = {
    "registry_read": registry_read,
    "results_read": results_read,
    "queries_read": queries_read,
    "jsonl_strict": jsonl_strict,
    "runtime_log": runtime_log,
    "sample_all_and_none": sample_all,
    "collection_error_rows": collection_error_rows,
    "collection_damaged_files": collection_damaged_files,
    "metadata_join_repeated": metadata_join_repeated,
    "description_variants_join": description_variants_join,
    "generate_quota": generate_quota,
    "judge_chain": judge_chain,
    "grade_chain": grade_chain,
    "keyword_score_many": keyword_score_many,
    "sample_stratified_large": sample_stratified_large,
    "sample_cluster_large": sample_cluster_large,
}
ORACLES = {
    "registry_read": """SELECT (row_number() OVER (ORDER BY c_custkey) - 1)::INTEGER AS ord, c_name AS id, c_mktsegment AS category, c_mktsegment || '|a "b"' AS columns, c_custkey AS page_views FROM customer""",
    "results_read": "SELECT lang AS method, source AS metric, sum(n_chars)::DOUBLE AS value FROM documents GROUP BY 1, 2",
    "queries_read": """SELECT row_number() OVER (ORDER BY item_id)::INTEGER AS query_no, 'query_' || row_number() OVER (ORDER BY item_id) AS query_id,
trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark""",
    "jsonl_strict": "SELECT o_orderkey::VARCHAR AS dataset_id, o_orderstatus AS status, NULL::VARCHAR AS error FROM orders",
    "runtime_log": "SELECT event_id::VARCHAR AS dataset_id, round(value, 2) AS runtime_sec FROM events",
    "sample_all_and_none": "SELECT c_custkey FROM customer",
    "collection_error_rows": COLLECTION_ERRORS_SQL,
    "collection_damaged_files": DAMAGED_SQL,
    "metadata_join_repeated": METADATA_REPEATED_SQL,
    "description_variants_join": VARIANTS_SQL,
    "generate_quota": "SELECT true AS few_asked, count(*) AS rows, 0::BIGINT AS other_errors FROM documents",
    "judge_chain": JUDGE_SQL,
    "grade_chain": GRADE_CHAIN_SQL,
    "keyword_score_many": "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'http')::INT)::INTEGER AS keyword_score FROM documents",
    "sample_stratified_large": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('5:' || o_orderkey), o_orderkey) AS r FROM orders),
o AS (SELECT *, row_number() OVER (ORDER BY (r > 50), CASE WHEN r <= 50 THEN o_orderpriority END, CASE WHEN r <= 50 THEN r END, md5('5:fill:' || o_orderkey), o_orderkey) AS n FROM r)
SELECT o_orderkey, o_orderpriority FROM o WHERE n <= 2000""",
    "sample_cluster_large": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('5:' || o_orderkey), o_orderkey) AS r FROM orders),
o AS (SELECT *, row_number() OVER (ORDER BY r, md5('5:' || o_custkey), o_custkey) AS n FROM r WHERE r <= 3)
SELECT o_orderkey, o_custkey FROM o WHERE n <= 2000""",
}
