"""Tokens, packing, languages, toxicity and HTML against the libraries, brute force and planted cases."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescribe.llm import html, language, packing, queries, tokens, toxicity

from .cases import DOCS, documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer(queries.TOKENS_MODEL), queries.tokenizer(queries.PACKING_MODEL)


# ---------------------------------------------------------------- tokens


def test_counts_are_the_librarys(spark, model):
    import sentencepiece
    import tokenizers

    piece = sentencepiece.SentencePieceProcessor(model_file=model[0])
    words = tokenizers.Tokenizer.from_file(model[1])
    for path, count in ((model[0], lambda t: len(piece.encode(t))), (model[1], lambda t: len(words.encode(t, add_special_tokens=False).ids))):
        got = tokens.token_counts(documents(spark), path, limit=100, batch_bytes=1000)
        want = sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 100) for i, t, _, _ in DOCS), key=repr)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr) == want
        assert got.columns.count("n_bytes") == 1 and "lang" in got.columns
        assert tokens.token_counts(documents(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cuts_are_safe(model, seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "é", "▁", ".", "'s", "42", " ", "\r\n", "日本", "<s>", "<|endoftext|>", " x", "word", " "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(400)]
    for path in model:
        encoder = tokens.Encoder(path)
        stream, bounds = encoder.batch(pa.array(texts))
        for i, text in enumerate(texts):
            assert stream[bounds[i] : bounds[i + 1]].tolist() == list(encoder.encode([text])[0]), repr(text)
        long = " ".join(texts) * 20
        assert np.frombuffer(encoder.whole(long), "<u4").tolist() == list(encoder.encode([long])[0])


def test_a_model_is_needed():
    with pytest.raises(ValueError, match="is needed"):
        tokens.Encoder("vocabulary.txt")


# ---------------------------------------------------------------- packing


def brute_fullest(counts, room):
    best = {0}
    for k, n in counts.items():
        best = {s + k * m for s in best for m in range(n + 1) if s + k * m <= room}
    return max(best)


@pytest.mark.parametrize("seed", range(20))
def test_fullest_and_bins(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(rng.integers(1, 5)) for k in rng.integers(1, 30, 6)}
    room = int(rng.integers(1, 60))
    found = packing.fullest(counts, room)
    assert sum(k * n for k, n in found.items()) == brute_fullest(counts, room)
    assert all(n <= counts[k] for k, n in found.items())
    bins = packing.minimum_bin_slack(counts, 40)
    used = Counter()
    for times, chosen in bins:
        assert sum(k * n for k, n in chosen.items()) <= 40
        for k, n in chosen.items():
            used[k] += times * n
    assert used == counts


@pytest.mark.parametrize("capacity", [8, 1024])
def test_packing_places_every_token_once(spark, model, capacity):
    import tokenizers

    words = tokenizers.Tokenizer.from_file(model[1])
    rows = [r for r in DOCS if len(r[1] or "") < 5_000 or capacity > 8]
    out = packing.pack(documents(spark, rows), model[1], capacity=capacity, keep_ids=True).collect()
    whole = Counter((i, tuple(words.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t, _, _ in rows)
    by_doc = defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[r.doc_id].append(r)
    for i, ids in whole:
        n = whole[i, ids]
        first = len(ids) % capacity or capacity
        for piece, start in enumerate((0, *range(first, len(ids), capacity))):
            part = list(ids[start : first if not start else start + capacity])
            assert sum(r.piece == piece and r.start == start and list(r.ids) == part for r in by_doc[i]) == n
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    assert packing.pack(documents(spark, []), model[1]).count() == 0


def test_packing_moves_no_pieces_for_few_shifts(spark, model, monkeypatch):
    """Not even where Spark would not broadcast by itself; many shifts are joined by a shuffle, with the same places."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "31"}
    before = {k: spark.conf.get(k) for k in settings}
    docs = documents(spark, [(i, "stone " * (i % 50), "en", "a") for i in range(2_000)]).repartition(4, "doc_id")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        few = packing.pack(docs, model[1])
        assert few.rdd.getNumPartitions() <= 8  # as many as the pieces are read in
        monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
        many = packing.pack(docs, model[1])
        assert many.rdd.getNumPartitions() == 31
        assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 2_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ---------------------------------------------------------------- languages


def test_language_of_held_out_documents(spark):
    from tablescribe.llm.common import table

    found = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in held) / len(held) < 0.02
    assert all(0 <= r.score <= 1 for r in held)


def test_what_was_not_learned_is_rejected(spark):
    """French left out of training, letters without a language, and the languages that were learned."""
    from tablescribe.llm.common import table

    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang").filter("text RLIKE '\\\\p{L}'")
    dictionaries = language.train(docs.filter("lang <> 'fr' AND doc_id % 2 = 0"))
    rng = np.random.default_rng(5)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz    "), n)) for n in (80, 200, 1_000, 4_000) for _ in range(25)]
    rows = docs.filter("doc_id % 2 = 1").unionByName(spark.createDataFrame([(-1 - i, t, "junk") for i, t in enumerate(junk)], docs.schema))
    found = language.identify(rows, dictionaries).groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("share"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    share = {r.lang: r.share for r in found}
    assert share["fr"] >= 0.9 and share["junk"] >= 0.95
    assert all(share[x] < 0.02 for x in ("en", "de", "es"))


def test_sizes_are_the_librarys(spark):
    """The classifier against plain zstandard: each language's dictionary, one text at a time."""
    import zstandard

    contents = {"a": b" ".join(b"word%d" % i for i in range(900)), "b": b" ".join(b"mot%d" % i for i in range(900))}
    classifier = language.Classifier(language.Dictionaries(contents))
    words = language.distinct_words(" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} mot" for i in range(300)))
    assert len(words) > language.SHORT_BYTES
    sizes = []
    for lang, content in contents.items():
        model = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        sizes.append((len(model.compress(words)), lang))
    assert classifier.sizes(words) == sorted(sizes)
    lang, margin, gain, kind = classifier.measure(words)
    plain = len(zstandard.ZstdCompressor(level=language.LEVEL, write_content_size=False).compress(words))
    (best, _), (second, _) = sorted(sizes)
    assert (lang, margin, gain, kind) == (min(sizes)[1], (second - best) / second, 1 - best / plain, 3)


def test_language_of_odd_documents(spark):
    rows = [(i, t * 30, l, "s") for i, (t, l) in enumerate((("the river and the stone of water ", "en"), ("la rivière et la pierre de l'eau ", "fr"), (None, "xx"), ("no language ", None)) * 3) if t]
    dictionaries = language.train(documents(spark, rows))
    assert set(dictionaries) == {"en", "fr"}
    found = {r.doc_id: r for r in language.identify(documents(spark), dictionaries).collect()}
    assert all(found[i].lang_pred == "und" and found[i].rejected and found[i].score == 0 for i in (3, 4, 5, 11))
    assert found[1].lang_pred == "en" and not found[1].rejected
    odd = language.identify(documents(spark, [(1, "½ Ⅷ ² _ 7", "en", "s"), (2, "é", "en", "s")]), dictionaries).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in odd} == {1: True, 2: False}
    assert language.identify(documents(spark, []), dictionaries).count() == 0
    nothing = language.train(documents(spark, []))
    assert nothing == {} and {r.lang_pred for r in language.identify(documents(spark), nothing).collect()} == {"und"}
    with pytest.raises(ValueError, match="more than"):
        language.train(spark.range(300).select(F.col("id").cast("string").alias("lang"), F.lit("some text").alias("text")))


def test_few_texts_of_many_copies_make_dictionaries(spark):
    copies = spark.range(6_000).selectExpr("'en' AS lang", "concat('word', translate(CAST(id % 5 AS string), '01234', 'abcde')) AS text")
    odd = spark.range(3_000).selectExpr("'en' AS lang", "IF(id % 2 = 0, NULL, CAST(id AS string)) AS text")
    alone = spark.createDataFrame([("fr", "mot")], "lang string, text string")
    found = language.train(copies.union(odd).union(alone))
    assert {k: set(v.split()) for k, v in found.items()} == {"en": {b"worda", b"wordb", b"wordc", b"wordd", b"worde"}, "fr": {b"mot"}}


def test_the_sample_is_filled(spark):
    many = spark.range(20_000).selectExpr("'en' AS lang", "translate(CAST(id % 10000 AS string), '0123456789', 'abcdefghij') AS text")
    assert len(language.train(many)["en"].split()) == language.SAMPLE_ROWS
    assert len(language.train(many, rows=7)["en"].split()) == 7


def test_words_of_whole_texts_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "COUNTED_WORDS", 3)
    rows = spark.createDataFrame([("en", "boiler plate " * 4_000 + "Late late ending"), ("en", "boiler other"), ("fr", "à la fin"), ("xx", "²½ x" + "y" * 70_000)], "lang string, text string")
    found = language.train(rows)
    assert found == {"en": b"other ending late plate boiler", "fr": "à la fin".encode(), "xx": "²½".encode()}
    assert language.train(rows, size=13)["en"] == b"plate boiler"


# ---------------------------------------------------------------- toxicity


def labelled(spark, n=600):
    """Toxic where an insult meets a group; either of them alone is harmless, and so are long texts."""
    rng = np.random.default_rng(3)
    filler = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = list(rng.choice(filler, rng.integers(0, 60)))
        kind = i % 4
        words += ["insult"] * (kind in (1, 3)) + ["group"] * (kind in (2, 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", int(kind == 3)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int")


def test_pairs_of_words_are_learned(spark):
    machine = toxicity.train(labelled(spark))
    rows = [(1, "insult group", "", ""), (2, "insult", "", ""), (3, "group", "", ""), (4, "", "", ""), (5, None, "", ""), (6, "INSULT, a w1 w2 GROUP! " + "w3 " * 20_000, "", "")]
    found = {r.doc_id: r for r in toxicity.score(documents(spark, rows), machine).collect()}
    assert [found[i].predicted for i in (1, 2, 3, 4, 5, 6)] == [1, 0, 0, 0, 0, 1]
    assert found[4].score == found[5].score and all(0 <= r.score <= 1 for r in found.values())
    assert toxicity.score(documents(spark, []), machine).count() == 0
    again = toxicity.train(labelled(spark))
    assert np.array_equal(again.features, machine.features)


def test_pairs_that_show_only_together(spark):
    """The label is whether two words stand together or both are absent; neither differs between the labels on its own."""
    rng = np.random.default_rng(9)
    filler = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(4_000):
        a, b = i % 2, i // 2 % 2
        words = [*rng.choice(filler, 20), *["alpha"] * a, *["beta"] * b]
        rng.shuffle(words)
        rows.append((" ".join(words), int(a == b)))
    machine = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    tried = [(1, "w1 w2 alpha beta", "", ""), (2, "alpha w3", "", ""), (3, "w4 beta", "", ""), (4, "w5 w6", "", "")]
    found = {r.doc_id: r.predicted for r in toxicity.score(documents(spark, tried), machine).collect()}
    assert found == {1: 1, 2: 0, 3: 0, 4: 1}


def test_sums_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(np.arange(12), 0.3, rng.normal(size=12), rng.normal(size=(12, 4)))
    texts = [sorted(rng.choice(12, rng.integers(0, 8), replace=False).tolist()) for _ in range(30)]
    rows = np.array([i for i, t in enumerate(texts) for _ in t], np.int64)
    columns = np.array([c for t in texts for c in t], np.int64)
    want = [0.3 + sum(machine.weights[c] for c in t) + sum(machine.factors[x] @ machine.factors[y] for i, x in enumerate(t) for y in t[i + 1 :]) for t in texts]
    assert np.allclose(machine.sums(30, rows, columns), want)


def test_repeated_rows_and_null_labels(spark):
    rows = labelled(spark)
    more = rows.unionByName(rows).unionByName(rows.withColumn("toxic", F.lit(None).cast("int"))).unionByName(rows.withColumn("toxic", F.lit(7)))
    machine = toxicity.train(more)
    tried = [(1, "insult group", "", ""), (1, "insult group", "", ""), (2, "insult", "", "")]
    assert sorted(r.predicted for r in toxicity.score(documents(spark, tried), machine).collect()) == [0, 1, 1]


def test_the_sample_has_both_labels_whatever_the_copies(spark, monkeypatch):
    # 40,000 rows of 420 clean and 20 toxic texts; the sample has room for 60.
    clean = spark.range(39_900).selectExpr("concat('calm ', translate(CAST(id % 420 AS string), '0123456789', 'abcdefghij')) AS text", "0 AS toxic")
    toxic = spark.range(100).selectExpr("concat('vile ', translate(CAST(id % 20 AS string), '0123456789', 'abcdefghij')) AS text", "1 AS toxic")
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda features, n, rows, columns, labels: seen.append(Counter(labels)) or fit(features, n, rows, columns, labels))
    machine = toxicity.train(clean.union(toxic), sample_rows=60)
    assert seen == [{1.0: 20, 0.0: 40}]
    rows = [(1, "vile zz", "", ""), (2, "calm zz", "", "")]
    found = {r.doc_id: r.predicted for r in toxicity.score(documents(spark, rows), machine).collect()}
    assert found == {1: 1, 2: 0}
    assert toxicity._shares({1: 10**7, 0: 5}, 20) == {1: 15, 0: 5} and toxicity._shares({1: 100, 0: 100}, 20) == {1: 10, 0: 10}


def test_without_both_labels_all_scores_are_equal(spark):
    for rows in (labelled(spark).filter("toxic = 0"), labelled(spark).limit(0)):
        scores = {r.score for r in toxicity.score(documents(spark), toxicity.train(rows)).collect()}
        assert len(scores) == 1 and scores.pop() < 0.5


def test_toxic_documents_are_found(spark):
    from tablescribe.llm.common import table

    sf = "/root/testdata/sf0.1"
    found = queries.op5_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    toxic, clean = [r.score for r in found if r.toxic], [r.score for r in found if not r.toxic]
    assert np.mean([np.mean(np.array(clean) < s) for s in toxic]) > 0.9
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.02


# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a = "<p>no</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<ARTICLE><h2>Head &amp; &lt;line&gt;</h2><p>First   <b>par</b>agraph&nbsp;here<br>and
more<p>Te.<form><input value="x"><label>Search</label></form><aside>Side</aside><div class="comments"><p>Nice!</p></div><p>Last &#x41;.</p></ARTICLE>
<footer>&copy; us</footer></body>"""


def test_article_without_its_surroundings():
    assert html.main_text(PAGE) == "Head & <line> First paragraph here and more Te. Last A."


def test_surge_and_dive_without_an_article_element():
    body = "".join(f"<p>{'Sentence number %d of a long story. ' % i * 3}</p>" for i in range(5))
    menu = "".join(f'<div><a href="#">Link {i}</a></div>' for i in range(30))
    page = f"<body><div>{menu}</div><div>{body}<p>Short.</p></div><div>{menu}</div></body>"
    text = html.main_text(page)
    assert text.startswith("Sentence number 0") and "Short." in text and "Link 29" not in text


def test_odd_pages(spark):
    rows = [(1, "u", None, "o"), (2, None, "", "o"), (3, "u", "<p>", "o"), (4, "u", "<article><p>" + "word " * 100_000, "o"), (5, "u", '<article><p>a<div class="ad">b<p>c<article>d', "o"), (5, "u", "<article>x & y < z &bogus; <", "o"), (6, "u", "<script>never closed", "o"), (7, "u", "<!-- never closed <article>x", "o")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("old"))
    found = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df).collect())
    assert found == sorted([(1, "", 0), (2, "", 0), (3, "", 0), (4, ("word " * 100_000).strip(), 499_999), (5, "a d", 3), (5, "x & y < z &bogus; <", 19), (6, "", 0), (7, "", 0)])
    assert html.extract(df.limit(0)).count() == 0


STORY = "".join(f"<p>{'Sentence number %d of a long story. ' % i * 3}</p>" for i in range(3))
TOLD = " ".join(("Sentence number %d of a long story. " % i * 3).strip() for i in range(3))


@pytest.mark.parametrize(
    "page, want",
    [
        # Reader comments and teasers stay out, though they are articles.
        (f"<body><div>{STORY}</div><div class='comments'><article><p>Nice one, reader! {'So long. ' * 30}</p></article></div></body>", TOLD),
        (f"<article>{STORY}<div class='comments'><article class='comment'><p>Nice</p></article></div></article><article class='comment'>Bad</article>", TOLD),
        (f"<body><div>{STORY}</div><aside><article><h2>Teaser</h2></article></aside></body>", TOLD),
        # Labels are read as words, with denials and what they stand beside.
        (f"<div class='content has-sidebar'>{STORY}</div>", TOLD),
        (f"<div class='post no-comments'>{STORY}</div>", TOLD),
        (f"<article><div class='article-header'><h1>Headline</h1></div><p class='share-price'>Up 3 %</p>{STORY}</article>", f"Headline Up 3 % {TOLD}"),
        (f"<div class='siteHeader'>Site</div><div id='cookie-bar'>Cookies</div><div role='navigation'>Nav</div><div class='ad-slot-2'>Ad</div>{STORY}<div class='share-buttons'>Share</div>", TOLD),
        # A teaser beside a story in a div, and stories without an article.
        (f"<div>{STORY}</div><article><h2>Teaser card</h2></article>", f"{TOLD} Teaser card"),
        ("<div><div><p>A short page.</p></div></div>", "A short page."),
        ("<div><div><h1>Short</h1></div></div><div><div><p>" + "long text " * 20 + "</p></div></div><div><div><p>end</p></div></div>", "Short " + ("long text " * 20).strip() + " end"),
        (f"<article>{STORY}</article><div>{'<a href=x>More news here</a> ' * 40}</div>", TOLD),
    ],
)
def test_hand_made_pages(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("piece", ["<script x ", "<br ", "<a '", '<a "', "</div>", "<div class='ad'>", '<a href=">', "<!--", "<![x", "<svg>", "<p>", "<b><p></b>", "<li>", "<"])
def test_broken_pages_take_time_in_proportion(piece):
    import time

    html.main_text("<p>warm</p>")
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 15


def test_pages_of_the_tables_keep_their_article(spark):
    import re

    from tablescribe.llm.common import table

    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in queries.op1_html_extraction(spark, SF).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = html.entities.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inside)))
        assert r.text == " ".join(want.split()) and r.n_chars == len(r.text)
