"""Catalog selection, resume, records and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescribe.operators import catalog as C
from tablescribe.operators import runlog as L
from tablescribe.session import new_path
from tablescribe.sources import collection, records

from .tables import table


def registry(spark, sf):
    """Documents as a registry: id, name, description, category (blank for some), agency, views."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("ord"),
        F.substring_index("text", ".", 1).alias("name"),
        F.col("text").alias("description"),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")).alias("category"),
        F.nullif("source", F.lit("src3")).alias("agency"),
        F.array(F.lit("doc_id"), F.to_json(F.struct(F.col("source").alias("name"))), F.col("lang")).alias("columns"),
        F.col("n_chars").alias("page_views"),
    )


def done(spark, sf):
    """Labelled documents as finished work: ok where the quality is 1."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("dataset_id"), F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status")
    )


def ids(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dataset_id"))


def resume_remaining(spark, sf):
    return C.remaining(ids(spark, sf), done(spark, sf))


def resume_any_status(spark, sf):
    return C.remaining(ids(spark, sf), done(spark, sf), any_status=True)


def run_new_ids(spark, sf):
    """Ids that are ok after a run (all documents in English) and were not before (the labels)."""
    docs = table(spark, sf, "documents")
    after = docs.select(F.col("doc_id").cast("string").alias("dataset_id"), F.when(F.col("lang") == "en", "ok").otherwise("error").alias("status"))
    return C.new_ids(done(spark, sf), after)


def select_top(spark, sf):
    """The 40 most viewed pages that are not in the registry yet."""
    pages = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("id"),
        "url",
        F.length("html").alias("page_views"),
        F.when(F.contains("html", F.lit("<nav")), F.array(F.lit("url"))).alias("columns"),
        F.size(F.split("html", "<p")).alias("n_rows"),
    )
    known = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return C.select_candidates(pages, known, 40).select("id", "url", "page_views")


def registry_merge(spark, sf):
    """Finished documents as the registry, all documents (some twice) as newly accepted."""
    reg = registry(spark, sf).select("id", "name", "page_views")
    known = reg.join(done(spark, sf).select(F.col("dataset_id").alias("id")), "id", "left_semi")
    again = reg.withColumns({"name": F.concat("name", F.lit("!")), "page_views": F.col("page_views") + 1})
    merged = records.merge_registry(known, reg.unionByName(again))
    return merged.select("id", F.md5("name").alias("name"), "page_views")


def registry_defaults(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("name"),
        F.when(F.col("n_chars") > 500, F.col("text")).alias("description"),
        F.nullif("lang", F.lit("fr")).alias("category"),
        F.nullif("source", F.lit("src1")).alias("agency"),
        F.array(F.struct(F.lit("a").alias("name"), F.lit("text").alias("type")), F.struct(F.col("source").alias("name"), F.lit("text").alias("type"))).alias("columns"),
        F.lit(None).cast("string").alias("local_path"),
        F.lit(100).alias("sample_row_count"),
        F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("page_views"),
    )
    out = C.registry_entry(raw)
    return out.select("id", F.md5("description").alias("description"), "category", "agency", F.array_join("columns", ",").alias("columns"), "page_views")


def topics(spark, sf):
    p = table(spark, sf, "part")
    category = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 0, F.lit(""))
    name = F.when(F.col("p_size") % 5 != 0, F.concat_ws("  ", "p_name", "p_brand", "p_type"))
    return p.select("p_partkey", C.topic(category, name).alias("topic"))


def metadata_join(spark, sf):
    """Datasets named by customers' numbers looked up in the registry, with defaults for those without an entry; each side lacks some."""
    profiles = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("dataset_id"))
    joined = C.with_metadata(profiles, registry(spark, sf))
    return joined.select("dataset_id", F.md5("title").alias("title"), "topic", "agency", F.md5("original").alias("original"))


def column_lists(spark, sf):
    return registry(spark, sf).select("id", C.column_list(F.col("columns")).alias("columns"))


def restrict_to_judged(spark, sf):
    return C.restrict_to(ids(spark, sf), done(spark, sf))


def ok_profiles(spark, sf):
    """The first 100 profiles with status ok."""
    d = done(spark, sf).withColumn("ord", F.col("dataset_id").cast("bigint"))
    return C.ok_profiles(d, "ord", 100)


def _listing(spark, sf):
    """Files for documents in three roots: by source, language and length."""
    d = table(spark, sf, "documents")
    at = [F.col("source") < "src15", F.col("lang") == "en", F.col("n_chars") > 1000]
    entries = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(at)]))
    return d.select(F.col("doc_id").cast("string").alias("dataset_id"), F.explode(entries).alias("root_priority")).withColumn(
        "path", F.concat(F.lit("root"), F.col("root_priority"), F.lit("/"), F.col("dataset_id"), F.lit(".csv"))
    )


def path_priority(spark, sf):
    return collection.resolve_csv_paths(ids(spark, sf), _listing(spark, sf))


def missing_files(spark, sf):
    return C.missing_files(ids(spark, sf), _listing(spark, sf))


def quota_errors(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.is_quota_error(F.col("text")).alias("is_quota"))


def last_records(spark, sf):
    """Conversations as records by id: the last turn wins, the first one's position stays."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), "role", F.md5("text").alias("text"))
    return records.last_by_key(c, "conv_id", "ord")


def slim_export(spark, sf):
    c = table(spark, sf, "conversations")
    wide = c.groupBy(F.col("conv_id").cast("string").alias("dataset_id")).agg(
        F.min("role").alias("title"),
        F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("ufd_nyc"),
        F.max_by("text", F.when(F.col("turn") > 3, F.col("turn"))).alias("sfd_nyc"),
        F.count(F.lit(1)).alias("turns"),
    )
    slim = records.slim_records(wide)
    return slim.select("dataset_id", "title", F.md5("ufd_nyc").alias("ufd_nyc"), F.md5("sfd_nyc").alias("sfd_nyc"))


def jsonl_round_trip(spark, sf):
    """Records appended in two runs, with blank and broken lines among them, read back tolerantly."""
    path = new_path(spark, "jsonl")
    rec = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dataset_id"), F.col("lang").alias("title"), F.col("text").alias("ufd"))
    records.append_jsonl(rec.where(F.col("title") == "en"), path)
    records.append_jsonl(rec.where(F.col("title") != "en"), path)
    rec.select(F.when(F.col("title") == "fr", "").otherwise(F.concat(F.lit('{"dataset_id": '), "title"))).write.mode("append").text(path)
    back = records.read_jsonl(spark, path, "dataset_id string, title string, ufd string")
    return back.select("dataset_id", "title", F.md5("ufd").alias("ufd"))


def csv_round_trip(spark, sf):
    """A dataset written as CSV with a header and read back with all its line breaks and quotes."""
    path = new_path(spark, "csv")
    records.write_dataset_csv(table(spark, sf, "conversations"), path)
    back = spark.read.options(header=True, multiLine=True, escape='"').schema("conv_id bigint, turn bigint, role string, text string").csv(path)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text"))


def events_as_runs(spark, sf):
    """Events as run logs: the type as status, the value as seconds, the user as concurrency."""
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 20).cast("int").alias("concurrency"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("bigint").alias("new_ok_datasets"),
        F.col("value").alias("total_runtime_seconds"),
        F.when(F.col("event_type").isin("click", "view"), "ok").when(F.col("event_type") == "error", "missing_csv").otherwise(F.col("event_type")).alias("status"),
        "event_id",
    )


def status_counts(spark, sf):
    return L.status_counts(events_as_runs(spark, sf))


def run_throughput(spark, sf):
    runs = events_as_runs(spark, sf)
    rate = L.throughput_per_hour(F.col("new_ok_datasets"), F.col("total_runtime_seconds"))
    return runs.select("event_id", F.round(rate, 6).alias("per_hour"))


def runtime_summary(spark, sf):
    s = L.runtime_summary(events_as_runs(spark, sf))
    return s.select("concurrency", "runs", "datasets", *[F.round(c, 4).alias(c) for c in ("seconds", "mean_seconds", "per_hour")])


_REG = """reg AS (SELECT doc_id::VARCHAR AS id, split_part(text, '.', 1) AS name, text AS description, CASE WHEN lang = 'en' THEN '' ELSE lang END AS category,
  nullif(source, 'src3') AS agency, source, lang, n_chars AS page_views FROM documents)"""
_DONE = "done AS (SELECT doc_id::VARCHAR AS dataset_id, CASE WHEN quality = 1 THEN 'ok' ELSE 'error' END AS status FROM labels)"
_TOPIC = "coalesce(nullif({category}, ''), nullif(array_to_string(list_filter(string_split_regex(coalesce({name}, ''), '\\s+'), lambda x: x <> '')[1:3], ' '), ''), 'Unknown dataset')"
_LIST = """listing AS (SELECT doc_id::VARCHAR AS dataset_id, 0 AS p FROM documents WHERE source < 'src15' UNION ALL SELECT doc_id::VARCHAR, 1 FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id::VARCHAR, 2 FROM documents WHERE n_chars > 1000)"""
_RUNS = """runs AS (SELECT (user_id % 20)::INTEGER AS concurrency, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS ok, value AS secs, event_id FROM events)"""

QUERIES = {
    "resume_remaining": resume_remaining,
    "resume_any_status": resume_any_status,
    "run_new_ids": run_new_ids,
    "catalog_select_top": select_top,
    "registry_merge": registry_merge,
    "registry_defaults": registry_defaults,
    "topic_derivation": topics,
    "metadata_join": metadata_join,
    "column_lists": column_lists,
    "restrict_to_judged": restrict_to_judged,
    "ok_profiles_first": ok_profiles,
    "csv_path_priority": path_priority,
    "missing_files": missing_files,
    "quota_errors": quota_errors,
    "records_last_by_key": last_records,
    "slim_export": slim_export,
    "jsonl_round_trip": jsonl_round_trip,
    "csv_round_trip": csv_round_trip,
    "status_counts": status_counts,
    "run_throughput": run_throughput,
    "runtime_summary": runtime_summary,
}
ORACLES = {
    "resume_remaining": f"WITH {_DONE} SELECT doc_id::VARCHAR AS dataset_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT dataset_id FROM done WHERE status = 'ok')",
    "resume_any_status": "SELECT doc_id::VARCHAR AS dataset_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "run_new_ids": f"WITH {_DONE} SELECT DISTINCT doc_id::VARCHAR AS dataset_id FROM documents WHERE lang = 'en' AND doc_id::VARCHAR NOT IN (SELECT dataset_id FROM done WHERE status = 'ok')",
    "catalog_select_top": """SELECT page_id::VARCHAR AS id, url, length(html)::INTEGER AS page_views FROM pages
WHERE contains(html, '<nav') AND page_id NOT IN (SELECT doc_id FROM labels) ORDER BY length(html) DESC, id LIMIT 40""",
    "registry_merge": f"""WITH {_REG} SELECT id, md5(CASE WHEN id IN (SELECT doc_id::VARCHAR FROM labels) THEN name ELSE name || '!' END) AS name,
page_views + CASE WHEN id IN (SELECT doc_id::VARCHAR FROM labels) THEN 0 ELSE 1 END AS page_views FROM reg""",
    "registry_defaults": """SELECT doc_id::VARCHAR AS id, md5(CASE WHEN n_chars > 500 THEN text ELSE '' END) AS description, coalesce(nullif(lang, 'fr'), 'Uncategorized') AS category,
coalesce(nullif(source, 'src1'), 'Unknown') AS agency, 'a,' || source AS columns, CASE WHEN n_chars > 1000 THEN n_chars ELSE 0 END AS page_views FROM documents""",
    "topic_derivation": "SELECT p_partkey, "
    + _TOPIC.format(
        category="CASE WHEN p_size % 2 = 0 THEN p_type WHEN p_size % 3 = 0 THEN '' END",
        name="CASE WHEN p_size % 5 <> 0 THEN p_name || '  ' || p_brand || '  ' || p_type END",
    )
    + " AS topic FROM part",
    "metadata_join": f"""WITH {_REG}
SELECT c_custkey::VARCHAR AS dataset_id, md5(coalesce(name, '')) AS title, {_TOPIC.format(category='category', name='name')} AS topic, agency, md5(coalesce(description, '')) AS original
FROM customer LEFT JOIN reg ON reg.id = c_custkey::VARCHAR""",
    "column_lists": "SELECT doc_id::VARCHAR AS id, 'doc_id, ' || source || ', ' || lang AS columns FROM documents",
    "restrict_to_judged": "SELECT doc_id::VARCHAR AS dataset_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "ok_profiles_first": "SELECT doc_id::VARCHAR AS dataset_id, 'ok' AS status, doc_id AS ord FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT 100",
    "csv_path_priority": f"""WITH {_LIST}, best AS (SELECT dataset_id, min(p) AS p FROM listing GROUP BY 1)
SELECT doc_id::VARCHAR AS dataset_id, 'root' || p || '/' || doc_id || '.csv' AS path, CASE WHEN p IS NULL THEN 'missing_csv' ELSE 'ok' END AS status
FROM documents LEFT JOIN best ON best.dataset_id = doc_id::VARCHAR""",
    "missing_files": f"WITH {_LIST} SELECT doc_id::VARCHAR AS dataset_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT dataset_id FROM listing)",
    "quota_errors": "SELECT doc_id, regexp_matches(lower(text), 'quota|429|exceeded') AS is_quota FROM documents",
    "records_last_by_key": "SELECT conv_id, min(turn) AS ord, arg_max(role, turn) AS role, md5(arg_max(text, turn)) AS text FROM conversations GROUP BY conv_id",
    "slim_export": """SELECT conv_id::VARCHAR AS dataset_id, min(role) AS title, md5(coalesce(arg_max(text, turn) FILTER (role = 'user'), '')) AS ufd_nyc,
md5(coalesce(arg_max(text, turn) FILTER (turn > 3), '')) AS sfd_nyc FROM conversations GROUP BY conv_id""",
    "jsonl_round_trip": "SELECT doc_id::VARCHAR AS dataset_id, lang AS title, md5(text) AS ufd FROM documents",
    "csv_round_trip": "SELECT conv_id, turn, role, md5(text) AS text FROM conversations",
    "status_counts": """SELECT count(*) FILTER (event_type IN ('click', 'view')) AS n_ok, count(*) FILTER (event_type = 'error') AS n_missing,
count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS n_error FROM events""",
    "run_throughput": f"WITH {_RUNS} SELECT event_id, round(CASE WHEN ok > 0 AND secs > 0 THEN ok / secs * 3600 ELSE 0 END, 6) AS per_hour FROM runs",
    "runtime_summary": f"""WITH {_RUNS} SELECT concurrency, count(*) AS runs, sum(ok)::BIGINT AS datasets, round(sum(secs), 4) AS seconds,
round(CASE WHEN sum(ok) > 0 THEN sum(secs) / sum(ok) END, 4) AS mean_seconds, round(CASE WHEN sum(ok) > 0 AND sum(secs) > 0 THEN sum(ok) / sum(secs) * 3600 ELSE 0 END, 4) AS per_hour FROM runs GROUP BY 1""",
}
