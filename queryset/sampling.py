"""Seeded samplers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescribe.operators import catalog
from tablescribe.operators import triage as T

from .tables import table

KEYWORDS = ["tion", " Data ", "the", "http", "zzz-absent", " "]

_SCORE_SQL = "(contains(lower(text), 'tion')::INT + contains(lower(text), 'data')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'http')::INT + contains(lower(text), 'zzz-absent')::INT)"


def _labelled(spark, sf):
    """Documents with their quality label, NULL where there is none."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return table(spark, sf, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")


_LABELLED_SQL = "pool AS (SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"


def sample_random(spark, sf):
    return T.random_sample(table(spark, sf, "documents"), 100, "doc_id", seed=42)


def sample_random_ranges(spark, sf):
    """The cut by ranges itself, for a sample of thousands."""
    df = table(spark, sf, "orders")
    hashed = T.order_key(7, "o_orderkey")
    return T.first_by(df, 9000, hashed, "o_orderkey").select("o_orderkey", "o_totalprice")


def sample_keyword(spark, sf):
    return T.keyword_sample(table(spark, sf, "documents"), 150, "doc_id", KEYWORDS, seed=3).drop("text")


def keyword_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.keyword_score(F.col("text"), KEYWORDS).alias("keyword_score"))


def sample_keyword_fill(spark, sf):
    """Fewer rows with a keyword than wanted: the rest is filled at random."""
    return T.keyword_sample(table(spark, sf, "pages"), 200, "page_id", ['<HTML lang="fr"'], "html", seed=5).select("page_id", "keyword_score")


def sample_stratified(spark, sf):
    return T.stratified_sample(_labelled(spark, sf), 120, "doc_id", "source", min_per_label=3, seed=11)


def sample_stratified_nulls(spark, sf):
    return T.stratified_sample(_labelled(spark, sf), 50, "doc_id", "quality", min_per_label=20, seed=12)


def _stratified_sql(label, n, per, seed):
    return f"""WITH {_LABELLED_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || doc_id), doc_id) AS r FROM pool WHERE {label} IS NOT NULL),
base AS (SELECT * FROM ranked WHERE r <= {per} ORDER BY {label}, r LIMIT {n}),
fill AS (SELECT * FROM ranked WHERE doc_id NOT IN (SELECT doc_id FROM base) ORDER BY md5('{seed}:fill:' || doc_id), doc_id
  LIMIT (SELECT {n} - count(*) FROM base))
SELECT doc_id, lang, source, quality FROM base UNION ALL SELECT doc_id, lang, source, quality FROM fill"""


def sample_cluster_diverse(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "label")
    return T.cluster_diverse_sample(df, 45, "vec_id", "label", max_per_cluster=6, seed=9)


def sample_cluster_cap(spark, sf):
    """A cap that binds: more rows wanted than the clusters may give."""
    df = table(spark, sf, "documents").select("doc_id", "source")
    return T.cluster_diverse_sample(df, 5000, "doc_id", "source", max_per_cluster=2, seed=10)


def _cluster_sql(source, key, cluster, n, cap, seed):
    return f"""WITH ranked AS (SELECT {key}, {cluster}, row_number() OVER (PARTITION BY {cluster} ORDER BY md5('{seed}:' || {key}), {key}) AS r
  FROM {source} WHERE {cluster} IS NOT NULL)
SELECT {key}, {cluster} FROM ranked WHERE r <= {cap} ORDER BY r, md5('{seed}:' || {cluster}), {cluster} LIMIT {n}"""


def sample_combined(spark, sf):
    """Two samplers combined, each row once."""
    df = table(spark, sf, "documents").select("doc_id", "lang", "source")
    first = T.random_sample(df, 60, "doc_id", seed=1)
    second = T.cluster_diverse_sample(df, 40, "doc_id", "lang", seed=2)
    return T.combine(df, "doc_id", first, second)


def choose_judged(spark, sf):
    return catalog.choose_datasets(table(spark, sf, "documents").select("doc_id", "source"), 50, 42, "doc_id")


QUERIES = {
    "sample_random": sample_random,
    "sample_random_ranges": sample_random_ranges,
    "keyword_score": keyword_score,
    "sample_keyword": sample_keyword,
    "sample_keyword_fill": sample_keyword_fill,
    "sample_stratified": sample_stratified,
    "sample_stratified_nulls": sample_stratified_nulls,
    "sample_cluster_diverse": sample_cluster_diverse,
    "sample_cluster_cap": sample_cluster_cap,
    "sample_combined": sample_combined,
    "choose_judged": choose_judged,
}
ORACLES = {
    "sample_random": "SELECT * FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100",
    "sample_random_ranges": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 9000",
    "keyword_score": f"SELECT doc_id, {_SCORE_SQL} AS keyword_score FROM documents",
    "sample_keyword": f"""SELECT doc_id, lang, source, n_chars, {_SCORE_SQL} AS keyword_score FROM documents
ORDER BY CASE WHEN {_SCORE_SQL} > 0 THEN 0 ELSE 1 END, md5('3:' || doc_id), doc_id LIMIT 150""",
    "sample_keyword_fill": """SELECT page_id, contains(lower(html), '<html lang="fr"')::INT AS keyword_score FROM pages
ORDER BY CASE WHEN contains(lower(html), '<html lang="fr"') THEN 0 ELSE 1 END, md5('5:' || page_id), page_id LIMIT 200""",
    "sample_stratified": _stratified_sql("source", 120, 3, 11),
    "sample_stratified_nulls": _stratified_sql("quality", 50, 20, 12),
    "sample_cluster_diverse": _cluster_sql("embeddings", "vec_id", "label", 45, 6, 9),
    "sample_cluster_cap": _cluster_sql("documents", "doc_id", "source", 5000, 2, 10),
    "sample_combined": f"""WITH a AS (SELECT doc_id FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 60),
b AS ({_cluster_sql("documents", "doc_id", "lang", 40, 10, 2)})
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM a UNION SELECT doc_id FROM b)""",
    "choose_judged": "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
}
