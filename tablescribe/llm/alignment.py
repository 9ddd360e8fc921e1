"""Alignment of the tokens of two tokenizers over the bytes of the texts.

Tokens of both are laid over a text's bytes by the spans that the libraries give; where a token ends inside a character, or a
byte-fallback token has no span, the decoded bytes of the tokens say how far it reaches. Where tokens of both end together the
tokens before are one group, and the two tokens that end there are linked.

Neither tokenizer joins what stands before and behind a single space between visible characters, so the alignment of a text is
that of its segments one after another. Each distinct segment is aligned once (see :mod:`.words`); its links, times its
occurrences, give the corpus-wide counts of id pairs, and what a segment adds to its rows goes back to them by position.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .words import PACKED, Splitter, entries, lean, pack, packed_schema, reassemble, slices, unpack, write_blocks

NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: itself where it is printable Latin-1, else the next letter from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def byte_ends(spans: list[tuple[int, int]], widths: list[int]) -> list[int]:
    """Where each token ends, in bytes: its span's end, or as far as its own ``widths`` bytes reach where the span says too little.

    A span is a true cut if it leads beyond the token before and the next one begins behind it: tokens that share a character
    have overlapping spans, byte-fallback tokens but the last of a character have empty ones.
    """
    ends, at = [], 0
    for i, (width, (_, end)) in enumerate(zip(widths, spans)):
        apart = i + 1 == len(spans) or spans[i + 1][0] >= end
        at = end if apart and end > at else at + width
        ends.append(at)
    return ends


def aligned(a: list[int], b: list[int], a_ends: list[int], b_ends: list[int]) -> tuple[int, str, list[int], list[int]]:
    """(n_groups, groups, a of links, b of links): ids of both between common ends, written down, and all pairs that end together."""
    found, link_a, link_b, i, j, from_a, from_b, n_a, n_b = [], [], [], 0, 0, 0, 0, len(a), len(b)
    while i < n_a and j < n_b:
        end, other = a_ends[i], b_ends[j]
        if end < other:
            i += 1
        elif end > other:
            j += 1
        else:
            first_a, first_b, i, j = i, j, i + 1, j + 1
            # Tokens without bytes end where the one before them does.
            while i < n_a and a_ends[i] == end:
                i += 1
            while j < n_b and b_ends[j] == end:
                j += 1
            if i - first_a == j - first_b == 1:
                link_a.append(a[first_a])
                link_b.append(b[first_b])
            else:
                pairs = [(x, y) for x in a[first_a:i] for y in b[first_b:j]]
                link_a += [x for x, _ in pairs]
                link_b += [y for _, y in pairs]
            found.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
            from_a, from_b = i, j
    return len(found), ";".join(found), link_a, link_b


class Aligner:
    """Tokens of a byte-level BPE of the tokenizers library (A) and of a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in token) for token, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes |= {i: x.content.encode() for i, x in self.a.get_added_tokens_decoder().items() if i not in self.a_bytes}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        # Spans are of characters or of bytes, depending on the version.
        self.char_spans = self._spans_of_b(["é"])[0][1][-1][1] == 1
        with open(a_path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts["pre_tokenizer"] or {}
        cuts_a = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not parts["normalizer"]
        # B keeps every character, white space too, and white space only ever begins a piece.
        plain = " ﬁ① Ａ  é\t \n x "
        cuts_b = b"".join(self.b_bytes[i] for i in self.b.encode(plain)) == f" {plain}".encode() and not any("▁" in x.lstrip("▁") for x in names)
        self.cuts = cuts_a and cuts_b

    def odd(self, text: str) -> bool:
        """Texts that must be aligned whole: a U+2581 is no longer told from a space in B."""
        return not self.cuts or "▁" in text

    def _spans_of_b(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        try:
            return [(x["ids"], x["offsets"]) for x in self.b.encode(texts, return_type="offset_mapping", return_bytes=True, num_threads=1)]
        except TypeError:  # versions that have the immutable proto instead
            return [([x.id for x in p.pieces], [(x.begin, x.end) for x in p.pieces]) for p in self.b.encode(texts, out_type="immutable_proto", num_threads=1)]

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, list[int], list[int]]]:
        """(tokens of A, of B, then as :func:`aligned`) per text, each beginning with the space that B puts before it.

        All is empty where the tokens' bytes are not the text's.
        """
        out, bytes_a, bytes_b = [], self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for text, x, (b, b_spans) in zip(texts, self.a.encode_batch(texts, add_special_tokens=False), self._spans_of_b([t[1:] for t in texts])):
            a, whole = x.ids, text.encode()
            a_parts, b_parts = list(map(bytes_a, a)), list(map(bytes_b, b))
            if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
                out.append((0, 0, 0, "", [], []))
                continue
            if len(whole) == len(text):
                # One byte a character: every span is a true cut.
                a_ends, b_ends = [e for _, e in x.offsets], [e + 1 for _, e in b_spans]
            else:
                reach = [0, *itertools.accumulate([len(c.encode()) for c in text])]
                if self.char_spans:
                    b_spans = [(reach[s + 1] - 1, reach[e + 1] - 1) for s, e in b_spans]
                a_ends = byte_ends([(reach[s], reach[e]) for s, e in x.offsets], list(map(len, a_parts)))
                b_ends = byte_ends([(s + 1, e + 1) for s, e in b_spans], list(map(len, b_parts)))
            out.append((len(a), len(b), *aligned(a, b, a_ends, b_ends)))
        return out


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process and pair of files."""
    return Aligner(a_path, b_path)


def _segments(a_path: str, b_path: str) -> Splitter:
    return Splitter(lambda segment: [segment], lead=" ", odd=aligner(a_path, b_path).odd)


def align(df: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the numbers of :data:`NUMBERS` and ``groups`` (``a1,a2|b1;a3|b2,b3``, ids in order) per row of ``df``.

    A (tokenizers .json) encodes a space and the text, B (sentencepiece .model) the text; strings of special tokens are plain
    text. n_links counts the pairs of an A and a B token whose bytes end together. The count of an id pair is how often it is
    linked in all rows; count_sum adds it up over a row's links, n_best are the links whose count is the highest of their B
    id. Null and empty texts, and texts whose tokens' bytes are not a space and the text, have zeros and ''. Repeated rows and
    null or equal keys are rows of their own, and count each; other columns are dropped; an empty table gives an empty one.
    """
    blocks = write_blocks(df, lambda: _segments(a_path, b_path), key=key, text=text, name="segments")
    fields = "id long, n long, numbers array<long>, groups string, a array<int>, b array<int>, blocks array<long>, places array<int>"

    def align_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        names = [f.split()[0] for f in fields.split(", ")]
        word, total, at, places = None, 0, [], []

        def batch_of(held: list[tuple[str, int, list, list]]) -> pa.RecordBatch:
            nonlocal made
            rows = []
            for (n_a, n_b, n_groups, groups, link_a, link_b), (_, n, own_blocks, own_places) in zip(aligner(a_path, b_path).align([x[0] for x in held]), held):
                rows.append((made, n, [n_a, n_b, n_groups, len(link_a)], groups, link_a, link_b, own_blocks, own_places))
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            # Rows of one word follow each other.
            held = []
            for w, block, place, n in zip(*(batch.column(c).to_pylist() for c in ("word", "block", "place", "n"))):
                if w != word:
                    if word is not None:
                        held.append((word, total, at, places))
                    word, total, at, places = w, 0, [], []
                total += n
                at.append(block)
                places.append(place)
            if held:
                yield batch_of(held)
        if word is not None:
            yield batch_of([(word, total, at, places)])

    words = materialize(entries(blocks).mapInArrow(align_words, fields), "aligned")
    links = words.select("id", "n", F.explode(F.arrays_zip("a", "b")).alias("x")).select("id", "n", "x.a", "x.b")
    pairs = materialize(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    # At most as many rows as B has ids.
    best = F.broadcast(pairs.groupBy("b").agg(F.max("count").alias("most")))
    counts = pairs.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("is_best"))
    sums = links.select("id", "a", "b").join(counts, ["a", "b"]).groupBy("id").agg(F.sum("is_best").alias("n_best"), F.sum("count").alias("count_sum"))
    numbers = F.concat("numbers", F.array(F.coalesce("n_best", F.lit(0)), F.coalesce("count_sum", F.lit(0)))).alias("numbers")
    scored = words.select("id", "numbers", "groups", "blocks", "places").join(sums, "id", "left").select(numbers, "groups", "blocks", "places")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def flush() -> pa.RecordBatch:
            own_blocks, own_places, numbers, sizes, texts = (np.concatenate(x) for x in zip(*held))
            return pack(own_blocks, own_places, (np.full(len(own_blocks), len(NUMBERS)), numbers.ravel(), "<i8"), (sizes, texts, "u1"))

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("blocks")
            times = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), times)
            numbers = batch.column("numbers").flatten().to_numpy().reshape(-1, len(NUMBERS))
            texts = [x.encode() for x in batch.column("groups").to_pylist()]
            size = np.fromiter(map(len, texts), np.int64)
            pool = np.frombuffer(b"".join(texts[i] for i in row.tolist()), np.uint8)
            held.append((lists.flatten().to_numpy(), batch.column("places").flatten().to_numpy(), numbers[row], size[row], pool))
            waiting += len(row)
            if waiting > PACKED:
                yield flush()
                held, waiting = [], 0
        if held:
            yield flush()

    schema = T.StructType([df.schema[key], *(T.StructField(n, T.LongType()) for n in NUMBERS), T.StructField("groups", T.StringType())])

    def rows(texts: pa.Table, results: pa.Table) -> pa.Table:
        lean()
        begin, _, values = unpack(results, 0, "<i8")
        table = values.reshape(-1, len(NUMBERS))[begin // len(NUMBERS)]
        begin, size, pool = unpack(results, 1, "u1")
        pool = pool.tobytes()
        names = [pool[a : a + n] for a, n in zip(begin.tolist(), size.tolist())]
        out = []
        for part, places in slices(texts):
            sums = np.array([table[p].sum(axis=0) for p in places], np.int64)
            lines = [b";".join([names[i] for i in p.tolist()]).decode() for p in places]
            out.append(pa.Table.from_arrays([part.column("key"), *(pa.array(sums[:, i]) for i in range(len(NUMBERS))), pa.array(lines, pa.string())], names=schema.names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([texts.column("key"), *([pa.array([], pa.int64())] * len(NUMBERS)), pa.array([], pa.string())], names=schema.names)

    return reassemble(blocks, scored.mapInArrow(packed, packed_schema(2)), rows, schema)
