"""Byte-level BPE by ranks: encoding over the distinct pre-tokens of the whole corpus, decoding by the token-byte table.

Pre-tokens are the matches of a pattern. They leave the texts with their positions (see :mod:`.words`), each distinct one is
encoded once, wherever it occurs, and its ids are joined back and put together by position. Decoding looks each id up in the
table of token bytes, which has as many rows as the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .words import PACKED, Splitter, entries, gather, lean, pack, packed_schema, reassemble, slices, unpack, write_blocks


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks of a file with a base64 token and a rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


class PreTokens:
    r"""The matches of a pattern made of ``\p{L}``, ``\p{N}``, ``\s`` and plain characters, as the tiktoken library finds them.

    Its Unicode tables may be older or newer than those of ``regex``. Each character beyond ASCII is tried once with the
    library itself; where the two disagree another one of the class that the library sees stands in for it.
    """

    STAND_INS = ("z", "1", "!", "\t")  # a letter, a number, neither, white space

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.find = regex.compile(pattern).findall
        self.letter, self.number, self.space = (regex.compile(x).match for x in (r"\p{L}", r"\p{N}", r"\s"))
        leads = range(0x80, 0x100)
        ranks = {bytes([i]): i for i in range(256)} | {x + bytes([i]): 256 + 128 * k + i - 0x80 for k, x in enumerate((b"z", b"1", b"!")) for i in leads}
        own = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+"
        # A character is merged with the one before it only if both are of one class.
        self.probe = tiktoken.Encoding("probe", pat_str=own, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tried: set[str] = set()
        self.stand_ins: dict[int, str] = {}

    def _try(self, c: str) -> None:
        theirs = next((i for i in range(3) if self.probe(self.STAND_INS[i] + c)[0] >= 256), 3)
        ours = 0 if self.letter(c) else 1 if self.number(c) else 3 if self.space(c) else 2
        if ours != theirs:
            self.stand_ins[ord(c)] = self.STAND_INS[theirs]
        self.tried.add(c)

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text)
        for c in set(text):
            if c > "\x7f" and c not in self.tried:
                self._try(c)
        if not self.stand_ins:
            return self.find(text)
        ends = list(itertools.accumulate(map(len, self.find(text.translate(self.stand_ins)))))
        return [text[a:b] for a, b in zip([0, *ends], ends)]


def encode(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) per row of ``df``: the ranks of the text's tokens.

    Each match of ``pattern`` is encoded separately, without special tokens, as the tiktoken library does with the ranks of
    ``path``. Null and empty texts have no ids. Repeated rows and null or equal keys are rows of their own; other columns are
    dropped; an empty table gives an empty one.
    """
    blocks = write_blocks(df, lambda: Splitter(PreTokens(pattern)), key=key, text=text, name="pre_tokens")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(path, pattern).encode_ordinary_batch
        held, last, last_ids = [], None, np.zeros(0, "<i4")
        waiting = 0

        def flush() -> pa.RecordBatch:
            blocks, places, sizes, values = (np.concatenate(x) for x in zip(*held))
            return pack(blocks, places, (sizes, values, "<i4"))

        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of one word follow each other, so the words of a batch are its runs.
            runs = batch.column("word").dictionary_encode()
            words = runs.dictionary.to_pylist()
            ids = [np.array(x, "<i4") for x in tokens(words[1:] if words[0] == last else words, num_threads=1)]
            ids = [last_ids, *ids] if words[0] == last else ids
            last, last_ids = words[-1], ids[-1]
            word = runs.indices.to_numpy()
            sizes = np.fromiter(map(len, ids), np.int64)
            begin = np.cumsum(sizes) - sizes
            held.append((batch.column("block").to_numpy(), batch.column("place").to_numpy(), sizes[word], gather(begin, sizes, np.concatenate(ids), word)))
            waiting += batch.num_rows
            if waiting > PACKED:
                yield flush()
                held, waiting = [], 0
        if held:
            yield flush()

    found = entries(blocks).select("word", "block", "place").mapInArrow(encoded, packed_schema(1))
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def rows(texts: pa.Table, results: pa.Table) -> pa.Table:
        lean()
        begin, size, values = unpack(results, 0, "<i4")
        out = []
        for part, places in slices(texts):
            ends = np.concatenate(([0], np.cumsum([size[p].sum() for p in places])))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gather(begin, size, values, np.concatenate(places)), pa.int32()))
            out.append(pa.Table.from_arrays([part.column("key"), ids], names=[key, "ids"]))
        return pa.concat_tables(out) if out else pa.table({key: texts.column("key"), "ids": pa.array([], pa.list_(pa.int32()))})

    return reassemble(blocks, found, rows, schema)


@functools.lru_cache(maxsize=4)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: where each token's bytes begin, how many they are (-1: no such id), and all bytes."""
    ranks = read_ranks(path)
    begin, size, at = np.zeros(max(ranks.values(), default=-1) + 1, np.int64), np.full(max(ranks.values(), default=-1) + 1, -1, np.int64), 0
    for token, i in ranks.items():
        begin[i], size[i] = at, len(token)
        at += len(token)
    return begin, size, np.frombuffer(b"".join(ranks), np.uint8)


def decode(df: DataFrame, path: str, *, ids: str = "ids", name: str = "decoded", batch_tokens: int = 1 << 18) -> DataFrame:
    """``df`` with the bytes of ``ids`` as column ``name``: a join of all ids of a batch with the token-byte table of ``path``.

    The table is as large as the vocabulary, and every task holds it, so no row moves. Null ids give null, no ids empty
    bytes; a row with an id that the table lacks gives null. A column called ``name`` is replaced.
    """
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.BinaryType())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        begin, size, pool = token_table(path)
        lists = batch.column(ids)
        flat, counts = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        ends = np.concatenate(([0], np.cumsum(counts)))
        known = (flat >= 0) & (flat < len(size))
        known[known] = size[flat[known].astype(np.int64)] >= 0
        found = np.where(known, flat, 0).astype(np.int64)
        sizes = np.where(known, size[found], 0) if len(size) else np.zeros(len(flat), np.int64)
        missing = np.concatenate(([0], np.cumsum(~known)))
        null = (missing[ends[1:]] > missing[ends[:-1]]) | lists.is_null().to_numpy(zero_copy_only=False)
        reached = np.concatenate(([0], np.cumsum(sizes)))
        data = pool[np.repeat(begin[found] - reached[:-1], sizes) + np.arange(reached[-1])] if reached[-1] else np.zeros(0, np.uint8)
        made = pa.Array.from_buffers(pa.binary(), batch.num_rows, [pa.array(~null).buffers()[1], pa.py_buffer(reached[ends].astype("<i4")), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy()
            # Slices of about equal numbers of tokens; a longer row is a slice of its own.
            bins = np.cumsum(counts) // batch_tokens
            cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                if b > a:
                    yield step(batch.slice(a, b - a))

    return df.mapInArrow(run, schema)


def bpe_round_trip(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` and ``decoded``: every text encoded, and its ids decoded again. As :func:`encode` for nulls and the like."""
    return decode(encode(df, path, pattern, key=key, text=text), path)
