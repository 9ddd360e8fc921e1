"""Archives, near and exact duplicates, conversations, benchmark passages and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from queryset.compare import compare, connect
from tablescribe.llm import chat, components, contamination, exact, queries, simhash, template, warc

from .cases import DOCS, LONG, documents, pairs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) == ""


# ---------------------------------------------------------------- archives


def pages(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "", ""), (5, "u", "é" * 300_000), (None, "u", "<p>x</p>"), (2, "again", "<p>x</p>"), (6, "u", "alone\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload_bytes": F.lit("old"), "path": F.lit("old"), "offset": F.lit("old")})


def test_archives_come_back(spark):
    digest = lambda s: warc.sha1_base32(s.encode())
    x = digest("<p>x</p>")
    want = [(1, 8, x, "revisit", 2), (2, 8, x, "response", None), (2, 8, x, "response", None), (3, 0, digest(""), "revisit", 4), (4, 0, digest(""), "response", None)]
    want += [(5, 600_000, digest("é" * 300_000), "response", None), (None, 8, x, "revisit", 2), (6, 9, digest("alone\r\n\r\n"), "response", None)]
    got = warc.archive_round_trip(pages(spark))
    assert pairs(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.archive_round_trip(pages(spark).limit(0)).count() == 0
    # Below the least size nothing is a revisit.
    assert warc.archive_round_trip(pages(spark), least=9).filter("record_type = 'revisit'").count() == 0


def test_records_by_index(spark):
    from tablescribe.session import new_path

    index = warc.write_archives(pages(spark), new_path(spark, "warc"))
    some = warc.read_records(index.filter("page_id IN (5, 6)"))
    assert {r.page_id: len(r.payload) for r in some.collect()} == {5: 600_000, 6: 9}
    row = index.filter("page_id = 6").first()
    data = open(row.path.removeprefix("file:"), "rb").read()[row.offset : row.offset + row.length]
    assert zlib.decompress(data, wbits=31).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_ranges_that_lie_close_are_read_at_once():
    ranges = [(0, 10), (10, 5), (100, 10), (5000, 10), (5010, 90)]
    assert warc.fetched(ranges, gap=100, most=1000) == [(0, 110, [0, 1, 2]), (5000, 5100, [3, 4])]
    assert warc.fetched(ranges, gap=10_000, most=50) == [(0, 15, [0, 1]), (100, 110, [2]), (5000, 5010, [3]), (5010, 5100, [4])]


# ---------------------------------------------------------------- near duplicates


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """prints: (id, fingerprint) rows; the smallest id reachable for each row."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return [(i, f"{p:016x}", least.get(find(p))) for i, p in prints]


def test_near_duplicates_of_odd_documents(spark):
    words = [f"word{i}" for i in range(300)]
    near = [(100 + k, " ".join(words[:k] + ["other"] * (k > 0) + words[k + 1 :]), "en", "s") for k in range(0, 300, 30)]
    rows = [r for r in DOCS if r[1] != LONG] + near
    got = simhash.near_duplicates(documents(spark, rows))
    want = plain_components([(i, plain_fingerprint(t)) for i, t, _, _ in rows])
    assert pairs(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    # One row of each component stays, with its columns.
    stay = simhash.drop_near_duplicates(documents(spark, rows))
    assert stay.columns == documents(spark).columns
    kept = [r.doc_id for r in stay.collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


@pytest.mark.parametrize("shard_rows", [16_384, 7])
def test_links_of_clusters(spark, shard_rows):
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(25):
        base = int(rng.integers(0, 2**63)) * 2
        for _ in range(int(rng.integers(1, 30))):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    found = simhash.links(spark.createDataFrame([(p,) for p in signed.values()], "fp long"), 4, blocks=6, shard_rows=shard_rows)
    roots = {r.node: r.root for r in components.components(found).collect()}
    want = plain_components([(p, p) for p in prints])
    groups = Counter(c for _, _, c in want)
    assert {n for n in roots} == {signed[i] for i, _, c in want if groups[c] > 1}
    label = {}
    for i, _, c in want:
        if groups[c] > 1:
            assert label.setdefault(c, roots[signed[i]]) == roots[signed[i]]
    assert len(set(label.values())) == len(label)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, j) for j in range(501, 560)] + [(900, 900)]
    rng = np.random.default_rng(1)
    rng.shuffle(edges)
    found = {r.node: r.root for r in components.components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")).collect()}
    assert found == {i: 0 for i in range(101)} | {500 + j: 500 for j in range(60)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- exact duplicates


def plain_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _, _ in rows]
    size = Counter(n for _, n in norm)
    least = {n: min((i for i, m in norm if m == n and i is not None), default=None) for n in size}
    seen, out = set(), []
    for i, n in norm:
        keep = i == least[n] and n not in seen
        if keep:
            seen.add(n)
        out.append((i, least[n], size[n], keep, hashlib.sha256(n.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("trie_bytes", [exact.TRIE_BYTES, 3_000])
def test_exact_duplicates(spark, trie_bytes):
    rows = DOCS + [(1000 + i, "prefix " * 20 + "abc"[i % 3] * (i % 7), "en", "s") for i in range(60)]
    got = exact.exact_duplicates(documents(spark, rows), trie_bytes=trie_bytes)
    assert pairs(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(plain_exact(rows), key=repr)
    assert exact.exact_duplicates(documents(spark, [])).count() == 0
    stay = exact.drop_exact_duplicates(documents(spark, rows))
    assert stay.columns == documents(spark).columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, _, _, kept, _ in plain_exact(rows) if kept)


@pytest.mark.parametrize("ident", ["CAST(id AS int)", "id", "CAST(NULL AS long)"])
def test_many_short_texts_in_a_partition(spark, ident):
    # Over 8 MiB of results at 100 bytes each, so that batches leave in mid-stream.
    rows = spark.range(0, 90_000, 1, 1).selectExpr(f"{ident} AS doc_id", "CAST(id AS string) AS text")
    norm = rows.selectExpr("CAST(text AS binary) AS norm", "doc_id AS ident", "1L AS rows")
    found = exact._tries(norm, "ident", rows.schema["doc_id"].dataType, exact.TRIE_BYTES, digest=True)
    assert found.selectExpr("count(*)", "sum(n_bytes)", "sum(rows)", "count(ident)").first()[:] == (90_000, 438_890, 90_000, 0 if "NULL" in ident else 90_000)
    if ident == "id":
        assert found.filter("ident = 89999").first().text_sha256 == hashlib.sha256(b"89999").hexdigest()


def test_tries_spill_by_subtree():
    rng = np.random.default_rng(2)
    entries = [(bytes(rng.choice(list(b"ab"), rng.integers(0, 12))), int(rng.integers(0, 99)), 1) for _ in range(5_000)]
    entries += [(b"long common beginning " * 30 + k, i, n) for k, i, n in entries[:2_000]]
    want = {}
    for k, i, n in entries:
        least, rows = want.get(k, (i, 0))
        want[k] = (min(least, i), rows + n)
    for limit in (1 << 30, 50_000, 4_000):
        found = list(exact.merged(iter(entries), limit))
        assert len(found) == len(want) and {k: (i, n) for k, i, n in found} == want


# ---------------------------------------------------------------- conversations


def test_templates():
    render = lambda source, **env: "".join(t for t, _ in template.compile_template(source, env)(env))
    source = "{% for m in ms %}{{ loop.index }}:{{ m.a | upper }}{% if not loop.last %}, {% endif %}{% endfor %}"
    assert render(source, ms=[{"a": "x"}, {"a": None}, {}]) == "1:X, 2:, 3:"
    assert render("a {{- ' b ' -}} c{% if x == 1 and not y %}1{% elif x != 2 %}2{% else %}3{% endif %}", x=2, y=True) == "a b c3"
    tree = template.fold(template.parse("{{ 'a' + 'b' }}c{% if 1 == 2 %}no{% else %}{{ 'd' | upper }}{% endif %}{{ x or 'e' }}", ["x"]))
    assert len(tree) == 2 and tree[0] == template.Out(template.Const("abcD"))
    pieces = list(template.compile_template("a{% generation %}{{ x }}{% endgeneration %}b", ["x"])({"x": "s"}))
    assert pieces == [("a", False), ("s", True), ("b", False)]
    for bad in ("{{ y }}", "{{ x | nothing }}", "{% for %}", "{% if x %}", "{% endif %}", "{{ x() }}", "{{ x.__class__() }}", "{% import os %}", "{{ 'a' 'b' }}"):
        with pytest.raises(template.TemplateError):
            template.parse(bad, ["x"])
    assert render("{{ x.__class__ }}{{ x.keys }}", x={"k": 1}) == ""


def plain_conversations(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] is not None, r[2], r[3] is not None, r[3]))
        said = "".join(t or "" for _, _, who, t in turns if who == "assistant")
        text = "".join(f"{who or ''}\n{t or ''}\n" for _, _, who, t in turns)
        out[conv] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


TURNS = [
    (1, 1, "assistant", "second"), (1, 0, "user", "first"), (2, 0, None, None), (2, 1, "assistant", None), (None, 0, "user", "of nobody"), (3, 5, "assistant", "a" * 9),
    (3, 5, "assistant", "a" * 9), (4, 0, "odd\nrole:", ":\n</turn>\n### user:\n"), (4, None, "assistant", "\\\\</turn>\\"), (5, 0, "assistant", "\\" * 101), (6, 0, "assistant", "é𝔘" * 5_000),
]


@pytest.mark.parametrize("part_chars", [chat.PART_CHARS, 5])
def test_conversations_come_back(spark, part_chars):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("old"), "formatted": F.lit("old")})
    parts = chat.format_conversations(df, part_chars=part_chars)
    if part_chars == 5:
        assert parts.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 3
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_formatted(parts).collect()}
    assert got == plain_conversations(TURNS)
    assert chat.read_formatted(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(template.TemplateError):
        chat.format_conversations(df, "{{ os }}")


def test_a_rendering_of_no_turns_is_refused(spark):
    bad = spark.createDataFrame([(1, 0, "### user:\nno end", [])], "conv_id long, part int, formatted string, loss array<struct<start:int,end:int>>")
    with pytest.raises(Exception, match="no whole turn"):
        chat.read_formatted(bad).collect()


# ---------------------------------------------------------------- benchmark passages


def plain_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        windows |= {(i, tuple(w[s : s + k])) for s in range(len(w) - k + 1)} if w else set()
    out = []
    for d, t, _, _ in docs:
        w = words(t)
        hit, found = set(), set()
        for i, g in windows:
            for s in range(len(w) - len(g) + 1):
                if w[s] == g[0] and tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found.add(i)
        ids = sorted({str(i) for i in found if i is not None})
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    items = [(1, passage), (2, "Some FEW, words!"), (10, passage), (3, None), (4, "..."), (5, "the the the the the the the the the the the the"), (2, "some few words"), (6, "absent " * 12)]
    docs = [r for r in DOCS if len(r[1] or "") < 1_000] + [
        (50, f"before {passage} after", "en", "s"), (51, " ".join(passage.split()[:10]), "en", "s"), (52, " ".join(passage.split()[:9]) + " x " + " ".join(passage.split()[10:19]), "en", "s"),
        (53, f"{passage} {passage}", "en", "s"), (54, "the " * 30, "en", "s"), (55, "some; few words. SOME FEW WORDS", "en", "s"), (56, passage.upper().replace(" ", "--"), "en", "s"), (57, "ſome few words é", "en", "s"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({"n": F.lit("old"), "word": F.lit("old")})
    got = contamination.contamination(documents(spark, docs), table)
    assert pairs(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(plain_contamination(docs, items), key=repr)
    assert contamination.contamination(documents(spark, []), table).count() == 0
    clean = contamination.contamination(documents(spark, docs), table.limit(0))
    assert clean.count() == len(docs) and clean.filter("contaminated").count() == 0
    rest = contamination.drop_contaminated(documents(spark, docs), table)
    assert sorted(r.text or "" for r in rest.collect()) == sorted(t or "" for (d, t, _, _), c in zip(docs, plain_contamination(docs, items)) if not c[5])
    assert rest.columns == documents(spark).columns


def test_proximity(spark):
    words = [f"p{i}" for i in range(12)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    changed = words[:6] + ["other"] + words[7:]
    docs = documents(spark, [(1, " ".join(words), "", ""), (2, "a b " + " ".join(changed), "", ""), (3, "p1 p2 p3", "", "")])
    terms = contamination.benchmark_terms(items)
    vocabulary = terms.select("word").distinct().withColumn("term", F.monotonically_increasing_id())
    index = contamination.positional_index(docs, vocabulary)
    found = contamination.matches(index, terms.join(vocabulary, "word"))
    names = index.select("row", "doc_id").distinct()
    got = {r.doc_id: (r.kind, r.shift, r.most) for r in found.join(names, "row").collect()}
    assert got == {1: ("phrase", 0, 10), 2: ("proximity", 2, 9)}


# ---------------------------------------------------------------- the pipeline


def plain_pipeline(spark, sf, kept_languages):
    """Ids that reach the last stage, by brute force; languages are decided by the classifier itself."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect() if r.doc_id in kept_languages]
    stay = {i for i, _, _, kept, _ in plain_exact(rows) if kept}
    rows = [r for r in rows if r[0] in stay]
    stay = {c for _, _, c in plain_components([(i, plain_fingerprint(t)) for i, t, _, _ in rows])}
    rows = [r for r in rows if r[0] in stay]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    return {r[0] for r, c in zip(rows, plain_contamination(rows, items)) if not c[5]}


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, and no rows at all."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    rows = [r for r in DOCS if r[0] != 8]
    docs, none = documents(spark, rows), documents(spark, [])
    for name, stage in stages.items():
        assert stage(spark, none, SF).count() == 0
        if name != "pack":
            assert stage(spark, docs, SF).columns == docs.columns
    ids = lambda name: sorted((r.doc_id for r in stages[name](spark, docs, SF).select("doc_id").collect()), key=repr)
    assert not set(ids("language_id")) & {3, 4, 5, 11}  # no letters
    # 1 and 2 differ in white space only, null ids come last, null and empty texts and white space are equal but for the space.
    assert ids("exact_dedup") == sorted((x[0] for x in plain_exact(rows) if x[3]), key=repr)
    assert ids("near_dedup") and 2 not in ids("near_dedup")
    assert ids("decontaminate") == sorted((r[0] for r in rows), key=repr)
    packed = stages["pack"](spark, docs, SF)
    assert packed.filter("piece = 0").count() == len(rows) and packed.filter("length > 1024").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF)
    assert stage.columns == docs.columns
    languages = {r.doc_id for r in stage.collect()}
    assert len(languages) >= 0.98 * docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == plain_pipeline(spark, SF, languages)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][-1] == "pack"
