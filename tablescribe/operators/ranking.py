"""BM25 ranking of description texts and NDCG of the rankings, for all methods and queries in one plan.

The corpus is tokenised once, and the query words of a document are counted in its own row, so what is shuffled and kept is
one short row per document; its scores are summed up in the task that reads that row, for all queries at once. For every query a first pass scores only by its rarest words; the best documents found so are
scored in full, and the k-th of these scores is what any other document must reach: pairs below it end in the task that made
them, before anything is sorted or shuffled. Words that could not lift a document to it on their own pair no documents.
Documents without any query word score 0 and can only follow the matching ones, in corpus order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.text import tokenize
from ..session import bucketed, materialize

# The BM25 parameters.
K1 = 1.5
B = 0.75
# Scores are ranked at this precision, so that equal texts tie whatever the order of summation.
SCORE_DIGITS = 9
# Query words are looked up, and joined by broadcast, up to this many (word, query) pairs; larger query sets are joined by
# shuffling words.
BROADCAST_TERMS = 200_000
# Documents per wanted rank that the rarest words of a query may bring into the first pass, and that are scored in full.
RARE_DOCUMENTS, SEEDS = 50, 4
# Scores are compared with this much room, so that rounding never drops a document.
ROOM = 1e-6
# Documents whose words are counted together.
BATCH_DOCUMENTS = 1_000
# Sums of documents and queries, and the products added up to them, that a task holds at a time.
TASK_CELLS = 2_000_000


def method_texts(records: DataFrame, methods: dict[str, str], key: str = "dataset_id", order: str = "ord") -> DataFrame:
    """``method, dataset_id, ord, text`` from one record per dataset; ``methods`` maps a name to its text column."""
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.coalesce(F.col(c), F.lit("")).alias("text")) for m, c in methods.items()])
    return records.select(F.col(key).alias("dataset_id"), F.col(order).alias("ord"), F.explode(entries).alias("e")).select(
        "e.method", "dataset_id", "ord", "e.text"
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf``: how often each word occurs in each query."""
    words = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def corpus_stats(texts: DataFrame) -> DataFrame:
    """Documents, words and average document length per method."""
    return texts.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size(tokenize(F.col("text")))).alias("n_tokens"),
        F.avg(F.size(tokenize(F.col("text")))).alias("avgdl"),
    )


def document_terms(texts: DataFrame) -> DataFrame:
    """``method, dataset_id, term, tf`` for every word of every document."""
    words = texts.select("method", "dataset_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return words.groupBy("method", "dataset_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per some documents and their words: in how many each word occurs, and how often."""
    for batch in (b.slice(at, BATCH_DOCUMENTS) for b in batches for at in range(0, b.num_rows, BATCH_DOCUMENTS)):
        lists, methods = batch.column("tokens"), batch.column("method").dictionary_encode("encode")
        rows = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        words = lists.flatten().dictionary_encode()
        n = max(len(words.dictionary), 1)
        pairs, counts = np.unique(rows.astype(np.int64) * n + words.indices.to_numpy(), return_counts=True)
        row, term = np.divmod(pairs, n)
        found, place = np.unique(methods.indices.to_numpy()[row].astype(np.int64) * n + term, return_inverse=True)
        df, cf = np.bincount(place, minlength=len(found)), np.bincount(place, counts, len(found))
        columns = [methods.dictionary.take(pa.array(found // n)), words.dictionary.take(pa.array(found % n)), pa.array(df, pa.int64()), pa.array(cf.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["method", "term", "df", "cf"])


def combined_terms(texts: DataFrame) -> DataFrame:
    """``method, term, df, cf`` of some documents each, for documents that have one row: to be added up."""
    return texts.select("method", tokenize(F.col("text")).alias("tokens")).mapInArrow(_combined, "method string, term string, df bigint, cf bigint")


def document_frequencies(texts: DataFrame) -> DataFrame:
    """In how many documents of a method each word occurs, and how often in all.

    The words of some documents are counted and combined in the task that reads them; only documents of several rows are
    counted by a shuffle of theirs.
    """
    key = F.struct("method", "dataset_id")
    several = materialize(texts.groupBy("method", "dataset_id").count().where("count > 1").select("method", "dataset_id"), "several-rows")
    single, more = texts, None
    if not several.isEmpty():
        found = several.select(key.alias("key"))
        keyed = texts.withColumn("key", key)
        single = keyed.join(found, keyed["key"].eqNullSafe(found["key"]), "left_anti").drop("key")
        more = keyed.join(found, keyed["key"].eqNullSafe(found["key"]), "left_semi").drop("key")
    terms = combined_terms(single)
    if more is not None:
        terms = terms.unionByName(document_terms(more).select("method", "term", F.lit(1).cast("bigint").alias("df"), F.col("tf").alias("cf")))
    return terms.groupBy("method", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _counted(terms: list[str]):
    """Per batch of documents and their words: the numbers and counts of the wanted words among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            lists = batch.column("tokens")
            rows = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            found = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy()
            hit = found >= 0
            pairs, counts = np.unique(rows[hit].astype(np.int64) * len(terms) + found[hit], return_counts=True)
            row, term = np.divmod(pairs, max(len(terms), 1))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            hits = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, counts)]
            kept = [batch.column(c) for c in batch.schema.names if c != "tokens"]
            yield pa.RecordBatch.from_arrays([*kept, *hits], names=[*(c for c in batch.schema.names if c != "tokens"), "terms", "counts"])

    return run


def word_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``method, dataset_id, ord, dl, terms, counts``: per document its length and the query words in it, by number, with how often.

    ``words`` has ``word, term`` with numbers from 0 on. The rows are written in buckets by document. Up to
    ``BROADCAST_TERMS`` words are looked up in each row as it is read, more are joined and counted by document.
    """
    tokens = tokenize(F.col("text"))
    sized = texts.select("method", "dataset_id", "ord", F.size(tokens).alias("dl"), tokens.alias("tokens"))
    listed = words.orderBy("term").limit(BROADCAST_TERMS + 1).collect()
    if len(listed) <= BROADCAST_TERMS:
        schema = StructType([*sized.drop("tokens").schema.fields, *(StructField(c, ArrayType(IntegerType())) for c in ("terms", "counts"))])
        counted = sized.mapInArrow(_counted([r["word"] for r in listed]), schema)
    else:
        rows = sized.withColumn("row", F.monotonically_increasing_id())
        # Each document also has an entry without a word, so that those without any query word are kept.
        each = rows.select("row", "method", "dataset_id", "ord", "dl", F.explode(F.array_append("tokens", F.lit(""))).alias("word"))
        empty = words.sparkSession.createDataFrame([("", -1)], "word string, term int")
        found = each.join(words.select("word", "term").unionByName(empty), "word").groupBy("row", "method", "dataset_id", "ord", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("n"))
        grouped = found.groupBy("row", "method", "dataset_id", "ord", "dl").agg(F.collect_list(F.when(F.col("term") >= 0, F.struct("term", "n"))).alias("x"))
        counted = grouped.select("method", "dataset_id", "ord", "dl", F.col("x.term").alias("terms"), F.col("x.n").alias("counts"))
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(counted.repartition(buckets, "method", "dataset_id"), ["method", "dataset_id"], "counts")


def _scored(asked: dict[str, tuple[np.ndarray, ...]], queries: list[str], averages: dict[str, float], k1: float, b: float):
    """Per batch of documents and their query words: the pairs with a query that can reach what it asks for.

    ``asked`` has for every method, by the numbers of the words: where the queries of a word begin, and for each of them its number,
    the weight and whether the word is essential; and for each query the score to reach.
    """

    def pairs(batch: pa.RecordBatch, at: np.ndarray, words: tuple[np.ndarray, ...], average: float) -> tuple[np.ndarray, ...]:
        begins, query, weight, essential, least = words
        offsets = batch.column("terms").offsets.to_numpy()
        sizes = offsets[at + 1] - offsets[at]
        row = np.repeat(np.arange(len(at)), sizes)
        place = np.repeat(offsets[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        term = batch.column("terms").values.to_numpy()[place]
        tf = batch.column("counts").values.to_numpy()[place + (batch.column("counts").offsets[0].as_py() - offsets[0])].astype(np.float64)
        dl = batch.column("dl").to_numpy()[at][row]
        part = (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * (dl / average)))
        each = begins[term + 1] - begins[term]
        upto = np.concatenate([[0], np.cumsum(np.bincount(row, each, len(at)).astype(np.int64) + len(queries))])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        found, first = [], 0
        while first < len(at):
            # As many documents as fit, one at least.
            last = max(int(np.searchsorted(upto, upto[first] + TASK_CELLS, "right")) - 1, first + 1)
            some = slice(ends[first], ends[last])
            n = each[some]
            entry = np.repeat(begins[term[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            key = np.repeat(row[some] - first, n) * len(queries) + query[entry]
            score = np.bincount(key, weight[entry] * np.repeat(part[some], n), (last - first) * len(queries)).astype(np.float64)
            told = np.zeros(len(score), bool)
            told[key[essential[entry]]] = True
            hit = np.flatnonzero(told & (score.reshape(-1, len(queries)) >= least - ROOM).ravel())
            found.append((at[first + hit // len(queries)], hit % len(queries), score[hit]))
            first = last
        return tuple(map(np.concatenate, zip(*found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(queries, pa.string())
        for batch in batches:
            methods = batch.column("method").dictionary_encode()
            for i, method in enumerate(methods.dictionary.to_pylist()):
                at = np.flatnonzero(methods.indices.to_numpy(zero_copy_only=False) == i)
                if method in asked and len(at):
                    row, query, score = pairs(batch, at, asked[method], averages[method])
                    rows = batch.select(["method", "dataset_id", "ord"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*rows.columns, names.take(pa.array(query)), pa.array(score, pa.float64())], names=[*rows.schema.names, "query_id", "score"])

    return run


class _Index:
    """Documents by their query words, and the weights of the query words for each method and query."""

    def __init__(self, texts: DataFrame, queries: DataFrame, k1: float, b: float):
        terms = query_terms(queries)
        names = materialize(terms.select("term").distinct(), "words")
        place = Window.orderBy("term")
        # As many rows as different words in the queries.
        words = materialize(names.select(F.col("term").alias("word"), (F.row_number().over(place) - 1).alias("term")), "numbered")
        self.n_terms = words.count()
        self.docs = word_counts(texts, words)
        totals = self.docs.groupBy("method").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
        self.totals = F.broadcast(materialize(totals, "totals"))
        self.k1, self.b = k1, b
        found = self.postings(self.docs).groupBy("method", "term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
        idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weighed = found.join(self.totals, "method").select("method", "term", "df", "most", idf.alias("idf"))
        asked = terms.withColumnRenamed("term", "word").join(words, "word").select("query_id", "term", "qtf")
        weight = F.col("qtf") * F.col("idf")
        self.asked = materialize(weighed.join(asked, "term").select("method", "query_id", "term", "df", weight.alias("weight"), (weight * F.col("most")).alias("bound")), "asked")
        self.few = self.asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        # A document of several rows scores their sum, and its rows may lie in several tasks.
        key = F.struct("method", "dataset_id", "ord")
        several = materialize(self.docs.groupBy("method", "dataset_id", "ord").count().where("count > 1").select(key.alias("key")), "several-rows")
        self.single, self.more = self.docs, None
        if not several.isEmpty():
            keyed = self.docs.withColumn("key", key)
            self.single = keyed.join(several, keyed["key"].eqNullSafe(several["key"]), "left_anti").drop("key")
            self.more = keyed.join(several, keyed["key"].eqNullSafe(several["key"]), "left_semi").drop("key")

    def postings(self, docs: DataFrame) -> DataFrame:
        """A row per document and query word in it; ``part`` is what the word adds to a score for each unit of weight."""
        each = docs.join(self.totals, "method").select(*(c for c in docs.columns if c not in ("terms", "counts")), "avgdl", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        tf = F.col("x.counts")
        part = (tf * (self.k1 + 1)) / (tf + self.k1 * (1 - self.b + self.b * (F.col("dl") / F.col("avgdl"))))
        return each.select(*(c for c in docs.columns if c not in ("terms", "counts")), F.col("x.terms").alias("term"), part.alias("part"))

    def scores(self, docs: DataFrame, asked: DataFrame, *more: Column) -> DataFrame:
        """``method, dataset_id, ord, query_id, score`` over the words of ``asked``; a document's pairs stay in its task."""
        asked = F.broadcast(asked) if self.few else asked
        found = self.postings(docs).join(asked, ["method", "term", *(["query_id"] if "query_id" in docs.columns else [])])
        return found.groupBy("method", "dataset_id", "ord", "query_id").agg(F.round(F.sum(F.col("weight") * F.col("part")), SCORE_DIGITS).alias("score"), *more)

    def reaching(self, asked: DataFrame) -> DataFrame:
        """``method, dataset_id, ord, query_id, score`` of the pairs that share an ``essential`` word of ``asked`` and score ``least`` or more.

        Up to ``BROADCAST_TERMS`` words of queries are summed up in the task that reads the documents; more, and documents of several rows, by
        a row for each word.
        """
        listed = asked.orderBy("method", "term", "query_id").collect() if self.few else []
        if not listed:
            return self._reaching_rows(self.docs, asked)
        queries = sorted({r["query_id"] for r in listed}, key=lambda q: (q is not None, q))
        number = {q: i for i, q in enumerate(queries)}
        by_method = {}
        for r in listed:
            by_method.setdefault(r["method"], []).append(r)
        tables = {}
        for method, rows in by_method.items():
            begins = np.searchsorted([r["term"] for r in rows], np.arange(self.n_terms + 1))
            least = np.zeros(len(queries))
            for r in rows:
                least[number[r["query_id"]]] = r["least"]
            tables[method] = (begins, np.array([number[r["query_id"]] for r in rows]), np.array([r["weight"] for r in rows], float), np.array([r["essential"] for r in rows], bool), least)
        averages = {r["method"]: r["avgdl"] for r in self.totals.collect()}
        fields = [f for f in self.docs.schema.fields if f.name in ("method", "dataset_id", "ord")]
        schema = StructType([*fields, StructField("query_id", asked.schema["query_id"].dataType), StructField("score", DoubleType())])
        found = self.single.mapInArrow(_scored(tables, queries, averages, self.k1, self.b), schema).withColumn("score", F.round("score", SCORE_DIGITS))
        return found if self.more is None else found.unionByName(self._reaching_rows(self.more, asked))

    def _reaching_rows(self, docs: DataFrame, asked: DataFrame) -> DataFrame:
        pairs = self.scores(docs, asked, F.bool_or("essential").alias("essential"), F.max("least").alias("least"))
        return pairs.where(F.col("essential") & (F.col("score") >= F.col("least"))).select("method", "dataset_id", "ord", "query_id", "score")

    def thresholds(self, k: int) -> DataFrame:
        """``method, query_id, least``: a score that the k-th best document of the query has or exceeds."""
        rarest = Window.partitionBy("method", "query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        rare = self.asked.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("before") < RARE_DOCUMENTS * k)
        best = Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "ord")
        wanted = rare.select("method", "query_id", "term", "weight", F.lit(True).alias("essential"), F.lit(0.0).alias("least"))
        first = self.reaching(wanted).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= SEEDS * k)
        seeds = materialize(first.select("method", "query_id", "dataset_id"), "seeds")
        whole = self.scores(self.docs.join(seeds, ["method", "dataset_id"]), self.asked.select("method", "query_id", "term", "weight"))
        kth = whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        return materialize(kth.select("method", "query_id", (F.col("score") - ROOM).alias("least")), "thresholds")

    def candidates(self, k: int) -> DataFrame:
        """All pairs that can be among the ``k`` best of their query, with their scores."""
        least = self.thresholds(k)
        bounds = Window.partitionBy("method", "query_id").orderBy("bound", "term")
        told = self.asked.join(least, ["method", "query_id"], "left")
        # Words whose bounds together stay below the threshold lift no document to it alone.
        essential = F.coalesce(F.sum("bound").over(bounds) >= F.col("least"), F.lit(True))
        asked = told.select("method", "query_id", "term", "weight", essential.alias("essential"), F.coalesce("least", F.lit(0.0)).alias("least"))
        return self.reaching(asked).select("method", "query_id", "dataset_id", "ord", "score")


def bm25_top(texts: DataFrame, queries: DataFrame, methods: list[str], k: int, k1: float = K1, b: float = B) -> DataFrame:
    """``method, query_id, rank, dataset_id, score``: the best ``k`` documents of every query and method.

    ``method`` and ``dataset_id`` name a text. Ties, including all zero scores, go in corpus order. A match always scores
    above 0, so the top ``k`` lie within the ``k`` best matches and the first ``k`` documents of the corpus.
    """
    return _top(_Index(texts, queries, k1, b), queries, methods, k)


def _top(index: _Index, queries: DataFrame, methods: list[str], k: int) -> DataFrame:
    best = Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "ord")
    matches = index.candidates(k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    best_of = matches.groupBy("method", "query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "dataset_id", "score"))).alias("matches")
    )
    in_order = Window.partitionBy("method").orderBy("ord")
    # The written documents, for the texts would be made once more.
    head = (
        index.docs.select("method", "dataset_id", "ord")
        .withColumn("pos", F.row_number().over(in_order))
        .where(F.col("pos") <= k)
        .groupBy("method")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "dataset_id"))).alias("head"))
    )
    per_method = F.explode(F.array(*[F.lit(m) for m in methods]))
    asked = queries.select("query_id", per_method.alias("method")).join(head, "method")
    scored = F.transform("matches", lambda m: F.struct(m["dataset_id"].alias("dataset_id"), m["score"].alias("score")))
    rest = F.filter("head", lambda d: ~F.coalesce(F.array_contains("matches.dataset_id", d["dataset_id"]), F.lit(False)))
    zeros = F.transform(rest, lambda d: F.struct(d["dataset_id"].alias("dataset_id"), F.lit(0.0).alias("score")))
    ranked = F.slice(F.concat(F.coalesce(scored, F.slice(zeros, 1, 0)), zeros), 1, k)
    return (
        asked.join(best_of, ["method", "query_id"], "left")
        .select("method", "query_id", F.posexplode(ranked).alias("pos", "d"))
        .select("method", "query_id", (F.col("pos") + 1).alias("rank"), "d.dataset_id", "d.score")
    )


def dcg(rel: Column, rank: Column) -> Column:
    """Discounted cumulative gain (an aggregate) of relevances at 1-based ranks."""
    return F.sum(rel / F.log2(rank + 1))


def ideal_dcg(relevance: DataFrame, corpus: DataFrame, ks: list[int]) -> DataFrame:
    """``query_id, k, ideal``: the best possible DCG from the judgements of documents in the corpus."""
    judged = relevance.join(corpus.select("dataset_id"), "dataset_id", "left_semi")
    # Which document has a relevance makes no difference, so there is one row for each different one of a query.
    alike = judged.groupBy("query_id", "rel").agg(F.count(F.lit(1)).alias("n"))
    better = Window.partitionBy("query_id").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("before", F.coalesce(F.sum("n").over(better), F.lit(0))).where(F.col("before") < max(ks))
    ranks = F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(max(ks)))))
    top = alike.select("query_id", "rel", ranks.alias("rank"))
    cut = F.explode(F.array(*[F.lit(k) for k in ks]))
    return (
        top.withColumn("k", cut).where(F.col("rank") <= F.col("k"))
        .groupBy("query_id", "k")
        .agg(dcg(F.col("rel"), F.col("rank")).alias("ideal"))
    )


def ndcg_per_query(ranking: DataFrame, relevance: DataFrame, ideal: DataFrame, ks: list[int]) -> DataFrame:
    """``method, query_id, k, ndcg``; unjudged documents count 0, and so does a query without relevant documents."""
    judged = ranking.join(relevance, ["query_id", "dataset_id"], "left")
    cut = F.explode(F.array(*[F.lit(k) for k in ks]))
    gained = (
        judged.withColumn("k", cut).where(F.col("rank") <= F.col("k"))
        .groupBy("method", "query_id", "k")
        .agg(dcg(F.coalesce("rel", F.lit(0)), F.col("rank")).alias("dcg"))
    )
    value = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(0.0))
    return gained.join(ideal, ["query_id", "k"], "left").select("method", "query_id", "k", value.alias("ndcg"))


def mean_ndcg(
    texts: DataFrame, queries: DataFrame, relevance: DataFrame, methods: list[str], ks: tuple[int, ...] = (10, 20)
) -> DataFrame:
    """``method, k, ndcg``: the mean over all queries, for every method and cut-off in one plan."""
    index = _Index(texts, queries, K1, B)
    ranking = materialize(_top(index, queries, methods, max(ks)), "ranking")
    corpus = index.docs.select("dataset_id").distinct()
    ideal = ideal_dcg(relevance, corpus, list(ks))
    # Of the judgements, of which there may be one for each query and document, those of ranked documents are joined.
    judged = relevance.join(ranking.select("query_id", "dataset_id").distinct(), ["query_id", "dataset_id"], "left_semi")
    per_query = ndcg_per_query(ranking, judged, ideal, list(ks))
    return per_query.groupBy("method", "k").agg(F.avg("ndcg").alias("ndcg"))


def judged_coverage(relevance: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: judged datasets and how many of them the corpus lacks."""
    judged = relevance.select("dataset_id").distinct()
    known = corpus.select("dataset_id", F.lit(1).alias("known")).distinct()
    return judged.join(known, "dataset_id", "left").agg(
        F.count(F.lit(1)).alias("n_judged"), F.count_if(F.col("known").isNull()).alias("n_missing")
    )
