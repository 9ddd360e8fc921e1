"""BM25 and NDCG against plain Python on small corpora."""

import math
import random

import pytest

from tablescribe.operators import ranking as R
from tablescribe.plans import evaluate


def brute_force(query, docs, k1=1.5, b=0.75):
    """Scores by the textbook formula; ``docs`` is a list of (id, text)."""
    tokens = {d: t.lower().split() for d, t in docs}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    scores = {d: 0.0 for d, _ in docs}
    for term in query.lower().split():
        df = sum(term in t for t in tokens.values())
        for d, t in tokens.items():
            if tf := t.count(term):
                scores[d] += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
    return sorted(((round(s, 9), -i, d) for i, (d, s) in enumerate(scores.items())), reverse=True)


def corpus(spark, docs, method="m"):
    return spark.createDataFrame([(method, d, i, t) for i, (d, t) in enumerate(docs)], "method string, dataset_id string, ord int, text string")


def questions(spark, *texts):
    return spark.createDataFrame([(f"query_{i}", t) for i, t in enumerate(texts, 1)], "query_id string, text string")


def test_hand_made_corpus(spark):
    docs = [("a", "Red cats, red dogs"), ("b", ""), ("c", "red\tbirds\nfly red red"), ("d", "nothing here")]
    texts = ["red", "red red", "absent", "dogs red. fly"]
    got = R.bm25_top(corpus(spark, docs), questions(spark, *texts), ["m"], 4).collect()
    for i, q in enumerate(texts, 1):
        mine = sorted((r.rank, r.dataset_id, round(r.score, 6)) for r in got if r.query_id == f"query_{i}")
        want = [(rank, d, round(s, 6)) for rank, (s, _, d) in enumerate(brute_force(q, docs), 1)]
        assert mine == want, q
    stats = R.corpus_stats(corpus(spark, docs)).first()
    assert (stats.n_docs, stats.n_tokens, stats.avgdl) == (4, 11, 2.75)


def test_random_corpora(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i}", " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randint(0, 12)))) for i in range(60)]
    docs += [(f"e{i}", docs[i][1]) for i in range(10)]
    texts = [" ".join(rng.choices(words + ["zzz"], k=rng.randint(1, 4))) for _ in range(8)]
    both = corpus(spark, docs, "x").unionByName(corpus(spark, docs[::-1], "y"))
    got = R.bm25_top(both, questions(spark, *texts), ["x", "y"], 15).collect()
    for method, order in (("x", docs), ("y", docs[::-1])):
        for i, q in enumerate(texts, 1):
            mine = [d for _, d in sorted((r.rank, r.dataset_id) for r in got if (r.method, r.query_id) == (method, f"query_{i}"))]
            assert mine == [d for _, _, d in brute_force(q, order)[:15]]


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = [("a", "x y z"), ("b", "x x"), ("c", "q")]
    want = R.bm25_top(corpus(spark, docs), questions(spark, "x", "z q"), ["m"], 3).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(R, "BROADCAST_TERMS", 0)
    assert want == R.bm25_top(corpus(spark, docs), questions(spark, "x", "z q"), ["m"], 3).orderBy("query_id", "rank").collect()


def test_an_empty_corpus_ranks_nothing(spark):
    assert R.bm25_top(corpus(spark, [("a", "x")]).limit(0), questions(spark, "x"), ["m"], 3).count() == 0


def test_ndcg_of_a_known_ranking(spark):
    ranking = spark.createDataFrame([("m", "query_1", i, d) for i, d in enumerate("abc", 1)], "method string, query_id string, rank int, dataset_id string")
    judged = spark.createDataFrame([("query_1", "a", 2), ("query_1", "b", 0), ("query_1", "c", 1), ("query_1", "gone", 2)], "query_id string, dataset_id string, rel int")
    docs = spark.createDataFrame([(d,) for d in "abc"], "dataset_id string")
    ideal = R.ideal_dcg(judged, docs, [2])
    assert R.ndcg_per_query(ranking, judged, ideal, [2]).first().ndcg == pytest.approx(0.760188, abs=1e-6)
    zero = judged.selectExpr("query_id", "dataset_id", "0 AS rel")
    assert R.ndcg_per_query(ranking, zero, R.ideal_dcg(zero, docs, [2]), [2]).first().ndcg == 0.0
    coverage = R.judged_coverage(judged, docs).first()
    assert (coverage.n_judged, coverage.n_missing) == (4, 1)


def test_search_quality_of_records(spark):
    """Records written twice, a missing text, a null description and an unjudged query."""
    records = spark.createDataFrame(
        [("a", 0, "old", "taxi trips", None), ("b", 1, "parks", "trees", "trees"), ("a", 2, "taxi", "taxi rides", "rides")],
        "dataset_id string, ord int, HandS string, ufd string, sfd string",
    )
    registry = spark.createDataFrame([("a", 0, None), ("b", 1, "city taxi")], "id string, ord int, description string")
    judged = spark.createDataFrame([("query_1", "a", 2)], "query_id string, dataset_id string, rel int")
    methods = {"hs": "HandS", "ufd": "ufd", "sfd": "sfd", "original": "original"}
    out = evaluate.search_quality(records, registry, questions(spark, "taxi", "parks"), judged, methods, (1, 2))
    got = {(r.method, r.k): r.ndcg for r in out.collect()}
    # query_2 has no judgements and counts 0; "original" finds only b, and a comes second.
    assert got["hs", 1] == got["ufd", 1] == got["sfd", 1] == 0.5
    assert got["original", 1] == 0.0 and got["original", 2] == pytest.approx(0.5 / math.log2(3))
    metrics = {r.metric for r in evaluate.search_results(out).collect()}
    assert metrics == {"bm25@1", "bm25@2"}


def zipf_corpus(spark, n=600, queries=25):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3_000)]
    weights = [1 / (i + 1) for i in range(3_000)]
    docs = [(f"d{i}", " ".join(rng.choices(words, weights, k=rng.randint(20, 120)))) for i in range(n)]
    texts = [" ".join(rng.choices(words, weights, k=20)) for _ in range(queries)]
    return docs, texts


def test_few_pairs_are_ranked(spark):
    docs, texts = zipf_corpus(spark)
    index = R._Index(corpus(spark, docs), questions(spark, *texts), R.K1, R.B)
    pairs = index.candidates(5)
    assert len(texts) * 5 <= pairs.count() < len(texts) * len(docs) / 20
    got = R.bm25_top(corpus(spark, docs), questions(spark, *texts), ["m"], 5).collect()
    for i, q in enumerate(texts, 1):
        mine = [(r.dataset_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r.rank) if r.query_id == f"query_{i}"]
        assert mine == [(d, round(s, 6)) for s, _, d in brute_force(q, docs)[:5]]


def test_thresholds_are_reached(spark):
    docs, texts = zipf_corpus(spark, 200, 10)
    index = R._Index(corpus(spark, docs), questions(spark, *texts), R.K1, R.B)
    least = {r.query_id: r.least for r in index.thresholds(4).collect()}
    for i, q in enumerate(texts, 1):
        kth = brute_force(q, docs)[3][0]
        assert least.get(f"query_{i}", 0.0) <= kth


def test_words_are_counted_in_their_row(spark):
    texts = corpus(spark, [("a", "X y x"), ("b", ""), ("c", None), ("d", "q q")]).fillna("", ["text"])
    words = spark.createDataFrame([("x", 0), ("q", 1), ("absent", 2)], "word string, term int")
    got = {r.dataset_id: (r.dl, dict(zip(r.terms, r.counts))) for r in R.word_counts(texts, words).collect()}
    assert got == {"a": (3, {0: 2}), "b": (0, {}), "c": (0, {}), "d": (2, {1: 2})}


def test_pairs_are_summed_in_their_task(spark, monkeypatch):
    docs, texts = zipf_corpus(spark, 300, 12)
    # Some documents come twice, some of them with another text, and some have no id.
    twice = docs + docs[:7] + [("d9", "w1 w2 w2"), (None, "w0 w1"), (None, "w3")]
    rows = [("m", d, i % 300, t) for i, (d, t) in enumerate(twice)] + [("n", d, i, t) for i, (d, t) in enumerate(docs[:50])] + [("n", "empty", 50, "")]
    corpus = spark.createDataFrame(rows, "method string, dataset_id string, ord int, text string").repartition(5)
    asked = questions(spark, *texts, "absent", "")
    keys = ["method", "query_id", "rank"]
    monkeypatch.setattr(R, "TASK_CELLS", 40)
    got = R.bm25_top(corpus, asked, ["m", "n"], 6).orderBy(*keys).collect()
    index = R._Index(corpus, asked, R.K1, R.B)
    pairs = index.candidates(6)
    # Single documents are scored where they are read: no row for each word and query.
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and index.more.count() == 7 * 2 and index.single.count() == len(rows) - 7 * 2
    monkeypatch.setattr(R._Index, "reaching", lambda self, asked: self._reaching_rows(self.docs, asked))
    assert got == R.bm25_top(corpus, asked, ["m", "n"], 6).orderBy(*keys).collect() and len(got) == 2 * 14 * 6


def test_texts_are_made_once(spark):
    docs, texts = zipf_corpus(spark, 40, 3)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    corpus_of = corpus(spark, docs)
    counted = corpus_of.mapInArrow(count, corpus_of.schema)
    judged = spark.createDataFrame([("query_1", "d1", 2), ("query_2", "d2", 1), ("query_2", "d3", 0)], "query_id string, dataset_id string, rel int")
    got = R.mean_ndcg(counted, questions(spark, *texts), judged, ["m"], (5,)).collect()
    assert len(got) == 1 and made.value == 40
