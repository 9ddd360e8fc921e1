"""BM25 ranking and NDCG: documents as the corpus, benchmark items as the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablescribe.functions.text import tokenize
from tablescribe.operators import ranking as R
from tablescribe.sources.records import relevance_long, relevance_wide

from .tables import table

METHODS = {"original": "text", "ufd": "words", "sfd": "tagged"}
# Columns of the relevance matrix, as its format has them.
JUDGED_QUERIES = 20


def corpus(spark, sf):
    """Three variants of every text: as it is, without punctuation, and with the source in front."""
    words = F.regexp_replace("text", "[^A-Za-z]+", " ")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("dataset_id"),
        F.col("doc_id").alias("ord"),
        "text",
        words.alias("words"),
        F.concat_ws(" ", "source", "lang", words).alias("tagged"),
    )
    return R.method_texts(docs, METHODS)


def benchmark_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.concat(F.lit("query_"), F.col("item_id") + 1).alias("query_id"), "text")


def relevance_matrix(spark, sf):
    """A wide relevance matrix of the labelled documents: 0, 1 or 2 from the labels, 0 for a quarter of the queries."""
    rel = F.col("quality") + 1 - F.col("toxic")
    cells = [F.when((F.col("doc_id") + i) % 4 == 0, 0).otherwise(rel).alias(f"query_{i}") for i in range(1, JUDGED_QUERIES + 1)]
    return table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("dataset_id"), *cells)


def judgements(spark, sf):
    """Every labelled document judged for every query, by the same rule, in long form."""
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("rel"))
    numbers = table(spark, sf, "benchmark").select((F.col("item_id") + 1).alias("i"))
    rel = F.when((F.col("doc_id") + F.col("i")) % 4 == 0, 0).otherwise(F.col("rel"))
    return labels.crossJoin(numbers).select(F.concat(F.lit("query_"), "i").alias("query_id"), F.col("doc_id").cast("string").alias("dataset_id"), rel.alias("rel"))


_TOKENS = r"list_filter(string_split_regex(lower({t}), '\s+'), lambda x: x <> '')"
_TEXTS_SQL = f"""words AS (SELECT doc_id, text, regexp_replace(text, '[^A-Za-z]+', ' ', 'g') AS w, source, lang FROM documents),
texts AS (SELECT 'original' AS method, doc_id, text AS t FROM words UNION ALL SELECT 'ufd', doc_id, w FROM words
  UNION ALL SELECT 'sfd', doc_id, source || ' ' || lang || ' ' || w FROM words),
tok AS (SELECT method, doc_id, {_TOKENS.format(t="t")} AS toks FROM texts),
stats AS (SELECT method, count(*) AS n_docs, sum(len(toks))::BIGINT AS n_tokens, avg(len(toks)) AS avgdl FROM tok GROUP BY method),
tf AS (SELECT method, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT method, doc_id, len(toks) AS dl, unnest(toks) AS term FROM tok) GROUP BY ALL),
df AS (SELECT method, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY ALL)"""
_RANKED_SQL = f"""{_TEXTS_SQL},
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT 'query_' || (item_id + 1) AS query_id, unnest({_TOKENS.format(t="text")}) AS term FROM benchmark) GROUP BY ALL),
hits AS (SELECT method, query_id, doc_id, round(sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (dl / avgdl)))), 9) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (method, term) JOIN stats USING (method) GROUP BY ALL),
everything AS (SELECT method, query_id, doc_id FROM (SELECT DISTINCT 'query_' || (item_id + 1) AS query_id FROM benchmark), (SELECT method, doc_id FROM texts)),
ranked AS (SELECT method, query_id, doc_id, coalesce(score, 0.0) AS score,
  row_number() OVER (PARTITION BY method, query_id ORDER BY coalesce(score, 0.0) DESC, doc_id)::INTEGER AS rank
  FROM everything LEFT JOIN hits USING (method, query_id, doc_id))"""
_REL_SQL = f"""rel AS (SELECT doc_id, 'query_' || i AS query_id, CASE WHEN (doc_id + i) % 4 = 0 THEN 0 ELSE quality + 1 - toxic END AS rel
  FROM labels, range(1, {JUDGED_QUERIES + 1}) AS q(i))"""
_ALL_REL_SQL = """rel AS (SELECT doc_id, 'query_' || (item_id + 1) AS query_id, CASE WHEN (doc_id + item_id + 1) % 4 = 0 THEN 0 ELSE quality + 1 - toxic END AS rel FROM labels, benchmark)"""


def tokens(spark, sf):
    toks = tokenize(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(toks).alias("n_tokens"), F.md5(F.array_join(toks, " ")).alias("tokens")
    )


def corpus_stats(spark, sf):
    return R.corpus_stats(corpus(spark, sf)).select("method", "n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


def document_frequencies(spark, sf):
    return R.document_frequencies(corpus(spark, sf))


def bm25_topk(spark, sf):
    """The ten best documents of every query for all three text variants."""
    top = R.bm25_top(corpus(spark, sf), benchmark_queries(spark, sf), list(METHODS), 10)
    return top.select("method", "query_id", "rank", "dataset_id", F.round("score", 6).alias("score"))


def bm25_fill(spark, sf):
    """Queries that match few documents: the rest of the ranking is the corpus order."""
    docs = table(spark, sf, "documents")
    texts = R.method_texts(docs.select(F.col("doc_id").cast("string").alias("dataset_id"), F.col("doc_id").alias("ord"), "source"), {"src": "source"})
    queries = table(spark, sf, "benchmark").select(
        F.concat(F.lit("query_"), F.col("item_id") + 1).alias("query_id"),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("web src"), F.col("item_id"))).otherwise("nothing").alias("text"),
    )
    return R.bm25_top(texts, queries, ["src"], 100).select("query_id", "rank", "dataset_id")


def ndcg(spark, sf):
    result = R.mean_ndcg(corpus(spark, sf), benchmark_queries(spark, sf), judgements(spark, sf), list(METHODS))
    return result.select("method", "k", F.round("ndcg", 6).alias("ndcg"))


def ideal(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dataset_id"))
    best = R.ideal_dcg(judgements(spark, sf), docs, [10, 20])
    return best.select("query_id", "k", F.round("ideal", 6).alias("ideal"))


def relevance_unpivot(spark, sf):
    return relevance_long(relevance_matrix(spark, sf))


def relevance_pivot(spark, sf):
    """Long judgements back to one column per query."""
    return relevance_wide(relevance_long(relevance_matrix(spark, sf)), [f"query_{i}" for i in range(1, JUDGED_QUERIES + 1)])


def judged_coverage(spark, sf):
    """Datasets named by customers' numbers are judged, those named by documents' are the corpus; each side lacks some of the other."""
    judged = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("dataset_id"))
    return R.judged_coverage(judged, table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dataset_id")))


_PIVOT_CELLS = ", ".join(f"max(rel) FILTER (query_id = 'query_{i}') AS query_{i}" for i in range(1, JUDGED_QUERIES + 1))

QUERIES = {
    "tokenize": tokens,
    "bm25_corpus_stats": corpus_stats,
    "bm25_document_frequencies": document_frequencies,
    "bm25_topk": bm25_topk,
    "bm25_fill": bm25_fill,
    "ndcg_by_method": ndcg,
    "ideal_dcg": ideal,
    "relevance_unpivot": relevance_unpivot,
    "relevance_pivot": relevance_pivot,
    "judged_coverage": judged_coverage,
}
ORACLES = {
    "tokenize": f"SELECT doc_id, len(toks)::INTEGER AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens FROM (SELECT doc_id, {_TOKENS.format(t='text')} AS toks FROM documents)",
    "bm25_corpus_stats": f"WITH {_TEXTS_SQL} SELECT method, n_docs, n_tokens, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_document_frequencies": f"WITH {_TEXTS_SQL} SELECT method, term, df, cf FROM df",
    "bm25_topk": f"WITH {_RANKED_SQL} SELECT method, query_id, rank, doc_id::VARCHAR AS dataset_id, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    "bm25_fill": """WITH qt AS (SELECT 'query_' || (item_id + 1) AS query_id, unnest(string_split(CASE WHEN item_id % 2 = 0 THEN 'web src' || item_id ELSE 'nothing' END, ' ')) AS term FROM benchmark),
hits AS (SELECT query_id, doc_id, true AS hit FROM qt JOIN documents ON lower(source) = term),
allq AS (SELECT query_id, doc_id FROM (SELECT DISTINCT query_id FROM qt), documents),
ranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(hit, false) DESC, doc_id)::INTEGER AS rank FROM allq LEFT JOIN hits USING (query_id, doc_id))
SELECT query_id, rank, doc_id::VARCHAR AS dataset_id FROM ranked WHERE rank <= 100""",
    "ndcg_by_method": f"""WITH {_RANKED_SQL}, {_ALL_REL_SQL}, ks AS (SELECT unnest([10, 20]) AS k),
gain AS (SELECT method, query_id, k, sum(coalesce(rel, 0) / log2(rank + 1)) AS dcg FROM ranked LEFT JOIN rel USING (query_id, doc_id) JOIN ks ON rank <= k GROUP BY ALL),
best AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS r FROM rel SEMI JOIN documents USING (doc_id)),
ideal AS (SELECT query_id, k, sum(rel / log2(r + 1)) AS ideal FROM best JOIN ks ON r <= k GROUP BY ALL)
SELECT method, k::INTEGER AS k, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg FROM gain LEFT JOIN ideal USING (query_id, k) GROUP BY method, k""",
    "ideal_dcg": f"""WITH {_ALL_REL_SQL}, ks AS (SELECT unnest([10, 20]) AS k),
best AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS r FROM rel SEMI JOIN documents USING (doc_id))
SELECT query_id, k::INTEGER AS k, round(sum(rel / log2(r + 1)), 6) AS ideal FROM best JOIN ks ON r <= k GROUP BY query_id, k""",
    "relevance_unpivot": f"WITH {_REL_SQL} SELECT query_id, doc_id::VARCHAR AS dataset_id, rel::INTEGER AS rel FROM rel",
    "relevance_pivot": f"WITH {_REL_SQL} SELECT doc_id::VARCHAR AS dataset_id, {_PIVOT_CELLS} FROM (SELECT doc_id, query_id, rel::INTEGER AS rel FROM rel) GROUP BY doc_id",
    "judged_coverage": "SELECT count(*) AS n_judged, count(*) FILTER (c_custkey NOT IN (SELECT doc_id FROM documents)) AS n_missing FROM customer",
}
