"""Byte-level BPE, the prefix trie and token alignment against the libraries and brute force."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from tablescribe.llm import alignment, bpe, queries, trie, words

from .cases import DOCS, documents

SF = "/root/testdata/sf0.001"
RANKS = queries.tokenizer(queries.RANKS)
A, B = queries.tokenizer(queries.PACKING_MODEL), queries.tokenizer(queries.TOKENS_MODEL)
PARTS = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "é", "▁", ".", "'s", "'ll", "42", " ", "\r\n", "日本", "<s>", "<|endoftext|>", " x", "word", " ", "𐐷", "👩‍👩‍👧", "\0", "\x1c", "՘", "౜", "²"]


def texts(seed, n=250):
    rng = random.Random(seed)
    return [(1000 + i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 30))), None, None) for i in range(n)]


def library():
    return bpe.encoding(RANKS, public_tokenizers.PATTERN)


# ---------------------------------------------------------------- byte-level BPE


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_are_the_librarys(spark, seed):
    rows = [*DOCS, *texts(seed)]
    out = bpe.bpe_round_trip(documents(spark, rows), RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in out.collect()), key=repr)
    assert got == sorted(((i, tuple(library().encode_ordinary(t or "")), (t or "").encode()) for i, t, _, _ in rows), key=repr)


def test_no_rows_no_ids(spark):
    assert bpe.bpe_round_trip(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, None), (1, "")], "doc_id long, text string")
    got = bpe.bpe_round_trip(nulls, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((repr(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == [("1", [], b""), ("1", [], b""), ("None", [], b"")]


def test_several_blocks_and_rows_of_a_dictionary(spark):
    rows = [(i, f"the word{i % 50} and word{i} again the", None, None) for i in range(12_000)]
    out = bpe.encode(documents(spark, rows).repartition(3), RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert len(got) == 12_000 and all(got[i] == library().encode_ordinary(t) for i, t, _, _ in rows[::37])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=("Cs",))), max_size=30))
def test_pre_tokens(parts):
    text = "".join(parts)
    pieces = bpe.PreTokens(public_tokenizers.PATTERN)(text)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in library().encode_ordinary(p)] == library().encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30))
def test_splitter_keeps_texts(parts):
    text = "".join(parts)
    split = words.Splitter(bpe.PreTokens(public_tokenizers.PATTERN))
    places = split(text)
    assert "".join(list(split.words)[i] for i in places) == text
    assert split(text).tolist() == places.tolist()


def test_pack_and_unpack():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 4, 500)
    places = np.concatenate([rng.permutation((blocks == b).sum()) for b in range(4)])[np.argsort(np.argsort(blocks, kind="stable"))]
    sizes = rng.integers(0, 5, 500)
    values = rng.integers(0, 1 << 30, sizes.sum())
    parts = np.split(values, np.cumsum(sizes)[:-1])
    packed = pa.Table.from_batches([words.pack(blocks, places, (sizes, values, "<i4"), (sizes, values, "<i8"))])
    for b in range(4):
        rows = packed.filter(pa.compute.equal(packed["block"], b))
        for channel, kind in ((0, "<i4"), (1, "<i8")):
            begin, size, flat = words.unpack(rows, channel, kind)
            want = {int(p): v.tolist() for p, v, own in zip(places, parts, blocks) if own == b}
            assert {i: flat[begin[i] : begin[i] + size[i]].tolist() for i in range(len(begin))} == want
            order = rng.permutation(len(begin))
            assert words.gather(begin, size, flat, order).tolist() == [x for i in order.tolist() for x in want[i]]


def test_decode_rejects_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [15496]), (2, []), (3, None), (4, [15496, 50_256]), (5, [-1]), (6, [15496, 15496])], "k int, ids array<int>").withColumn("decoded", F.lit("old"))
    got = {r.k: r.decoded for r in bpe.decode(rows, RANKS).collect()}
    assert got == {1: b"Hello", 2: b"", 3: None, 4: None, 5: None, 6: b"HelloHello"}


def test_op11_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs:
        ids = library().encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    got = queries.op11_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# ---------------------------------------------------------------- prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [v[1:] for v in sorted(o)] for c, o in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                children[p[: d - 1]].add(p[:d])
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("old"), "part": F.lit("old"), "conv": F.lit("old")})


@pytest.mark.parametrize("seed, partitions", [(0, 1), (1, 3), (2, 8), (3, 20)])
def test_nodes_equal_brute_force(spark, seed, partitions):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 400), 150):
        for t in range(rng.choice([1, 1, 3, 9, 12])):
            said = rng.choice(["", "a", "é", "b", None]) if t > 1 or seed % 2 else "same"
            rows.append((c if rng.random() > 0.01 else None, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), said))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted((tuple(r) for r in trie.prefix_trie(turns(spark, rows)).collect()), key=repr) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_conversations_over_many_partitions(spark):
    # One conversation many times: its nodes go through all partitions, and so does the list of those that end there.
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(400) for t in range(3)] + [(7, 0, None, None), (7, None, "", ""), (11, 0, "user", "x" * 100_000)]
    assert sorted((tuple(r) for r in trie.prefix_trie(turns(spark, rows)).collect()), key=repr) == plain_trie(rows)
    assert trie.prefix_trie(turns(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40))
def test_minima(values):
    table = trie.Minima(np.array(values))
    n = len(values)
    for i in range(n):
        for bound in range(6):
            right = next((j - 1 for j in range(i + 1, n) if values[j] < bound), n - 1)
            left = next((j for j in range(i, -1, -1) if values[j] < bound), -1)
            assert table.right(np.array([i]), np.array([bound]))[0] == right
            assert table.left(np.array([i]), np.array([bound]))[0] == left
        for j in range(i, n):
            assert table.least(np.array([i]), np.array([j]))[0] == min(values[i : j + 1])


# ---------------------------------------------------------------- alignment


def plain_alignment(rows):
    import sentencepiece
    import tokenizers

    token_bytes = {i: t for t, i in bpe.read_ranks(RANKS).items()}
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    piece_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], Counter()
    for key, text in rows:
        text = text or ""
        whole = f" {text}".encode()
        x, y = a.encode(f" {text}", add_special_tokens=False).ids, list(b.encode(text))
        if not text or b"".join(token_bytes[i] for i in x) != whole or b"".join(map(piece_bytes, y)) != whole:
            found.append((key, [], [], [], []))
            continue
        x_ends, y_ends = np.cumsum([len(token_bytes[i]) for i in x]).tolist(), np.cumsum([len(piece_bytes(i)) for i in y]).tolist()
        common = sorted(set(x_ends) & set(y_ends))
        last_x, last_y = dict(zip(x_ends, x)), dict(zip(y_ends, y))
        links = [(last_x[e], last_y[e]) for e in common]
        cut, i, j = [], 0, 0
        for e in common:
            p, q = bisect.bisect_right(x_ends, e), bisect.bisect_right(y_ends, e)
            cut.append((x[i:p], y[j:q]))
            i, j = p, q
        count.update(links)
        found.append((key, x, y, links, cut))
    best = defaultdict(int)
    for (_, q), n in count.items():
        best[q] = max(best[q], n)
    out = []
    for key, x, y, links, cut in found:
        written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in cut)
        out.append((key, len(x), len(y), len(cut), len(links), sum(count[z] == best[z[1]] for z in links), sum(count[z] for z in links), written))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment_equals_brute_force(spark, seed):
    rows = [*DOCS, *texts(seed)]
    out = alignment.align(documents(spark, rows), A, B)
    assert out.columns == ["doc_id", *alignment.NUMBERS, "groups"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_alignment([r[:2] for r in rows])
    assert alignment.align(documents(spark, []), A, B).count() == 0


def test_op13_of_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain_alignment(docs)]
    got = queries.op13_token_alignment(spark, SF).select("doc_id", *alignment.NUMBERS, "groups_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_ends_by_spans_and_bytes():
    # A character of four bytes in four tokens whose spans are all that character's, then a token of its own.
    assert alignment.byte_ends([(0, 2), (2, 6), (2, 6), (2, 6), (2, 6), (6, 7)], [2, 1, 1, 1, 1, 1]) == [2, 3, 4, 5, 6, 7]
    # Byte-fallback tokens have empty spans but the last.
    assert alignment.byte_ends([(1, 2), (2, 2), (2, 2), (2, 5)], [2, 1, 1, 1]) == [2, 3, 4, 5]
    assert alignment.aligned([1, 2, 3], [7, 8], [1, 3, 4], [3, 4]) == (2, "1,2|7;3|8", [2, 3], [7, 8])
    assert alignment.aligned([1, 2, 2], [7], [3, 3, 4], [3]) == (1, "1,2|7", [1, 2], [7, 7])
    letters = alignment.byte_letters()
    assert sorted(letters.values()) == list(range(256)) and letters["Ġ"] == 32 and letters["Ċ"] == 10 and letters["a"] == 97


def test_spans_are_used_where_they_tell():
    aligner = alignment.Aligner(A, B)
    assert aligner.cuts and aligner.odd("a▁b") and not aligner.odd("a b")
    n_a, n_b, n_groups, groups, link_a, link_b = aligner.align([" naïve 𐐷 日本"])[0]
    assert n_a and n_b and n_groups == len(groups.split(";")) == len(link_a) == len(link_b)
    assert aligner.align([" a▁b"])[0] == (0, 0, 0, "", [], [])
