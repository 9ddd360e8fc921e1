"""Token counts and token ids of whole texts.

Texts travel in Arrow batches of about equal bytes. A text is cut only where no token can span the cut, so the counts and
ids are those of the uncut text: before a single space that follows a visible character, and in byte-level models also before
line feeds and where letters or digits meet signs. Texts that hold a string which the model knows as an added token are cut at
such spaces only. The pieces of a batch repeat a lot,
so each distinct piece is encoded once per batch, and short ones are remembered by the worker up to a fixed number.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches

REMEMBERED = 100_000  # pieces a worker remembers
REMEMBERED_CHARS = 48  # longer pieces are not remembered
PART_CHARS = 65_536  # texts with runs of white space are encoded in parts of about so many characters
_CUT = re.compile(r"(?<=\S) (?=\S)")
_JOINT = "\x01"
_SIGNS = r"([\p{L}\p{N}])([^\s\p{Z}\p{L}\p{N}']+)"
_IN_A_ROW, _TOGETHER = 64, 16_384  # pieces encoded as one text, and pieces whose ids are told apart at once


class Encoder:
    """Ids of pieces by one of the two libraries.

    ``spaced`` tells that a piece inside a text is given with the space before it (byte-level BPE); otherwise the library
    itself puts that space before whatever it encodes (sentencepiece's dummy prefix). Models of other kinds get whole texts.
    """

    def __init__(self, path: str):
        self.memory: dict[str, bytes] = {}
        self.spaced = self.cuts = False
        self.unsafe = ""
        if path.endswith(".json"):
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                parts = json.load(f)
            before = parts["pre_tokenizer"] or {}
            if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not parts["normalizer"]:
                self.spaced = self.cuts = not any(x.lstrip or x.rstrip or " " in x.content for x in model.get_added_tokens_decoder().values())
                # Two neighbouring white-space characters may be one token; an added token may be of letters and signs.
                added = "".join(f"|{re.escape(x.content)}" for x in model.get_added_tokens_decoder().values())
                self.unsafe = rf"[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]{{2}}|{_JOINT}{added}"
                # Bytes of each id: a letter of such a vocabulary is a byte, added tokens are texts.
                self.widths = np.zeros(model.get_vocab_size(), np.int64)
                for token, i in model.get_vocab(with_added_tokens=False).items():
                    self.widths[i] = len(token)
                for i, token in model.get_added_tokens_decoder().items():
                    self.widths[i] = len(token.content.encode())
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            # Cuts are safe if white space is kept and only ever starts a piece.
            keeps = len(model.encode(" a  a ")) > len(model.encode("a a")) and model.encode("a") != model.encode(" a")
            self.cuts = keeps and not any("▁" in x.lstrip("▁") for x in names)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.unsafe = "^ | $|  |▁"
        else:
            raise ValueError(f"{path}: a .json or .model file is needed")

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, as little-endian unsigned 32-bit numbers."""
        if not self.spaced:
            return [np.asarray(ids, "<u4").tobytes() for ids in self.encode(pieces)]
        # Pieces that begin with a space can be encoded one behind the other; the ids' widths tell them apart again.
        out: list[bytes | None] = [None] * len(pieces)
        apart = [i for i, x in enumerate(pieces) if len(x) < 2 or x[0] != " "]
        joint = [i for i, x in enumerate(pieces) if len(x) > 1 and x[0] == " "]
        for at in range(0, len(joint), _TOGETHER):
            own = joint[at : at + _TOGETHER]
            texts = ["".join(pieces[i] for i in own[k : k + _IN_A_ROW]) for k in range(0, len(own), _IN_A_ROW)]
            ids = np.fromiter((i for x in self.encode(texts) for i in x), "<u4")
            reached = np.cumsum(self.widths[ids])
            ends = np.cumsum(np.fromiter((len(pieces[i].encode()) for i in own), np.int64, len(own)))
            cuts = np.searchsorted(reached, ends) + 1
            if len(ids) and cuts[-1] == len(ids) and (reached[cuts - 1] == ends).all():
                data, begin = ids.tobytes(), 0
                for i, end in zip(own, (4 * cuts).tolist()):
                    out[i] = data[begin:end]
                    begin = end
            else:
                apart += own
        for i, ids in zip(apart, self.encode([pieces[i] for i in apart])):
            out[i] = np.asarray(ids, "<u4").tobytes()
        return out

    def known(self, pieces: list[str]) -> list[bytes]:
        """As :meth:`fresh`, remembering short pieces."""
        memory = self.memory
        new = [x for x in pieces if x not in memory]
        fresh = dict(zip(new, self.fresh(new)))
        found = [fresh[x] if x in fresh else memory[x] for x in pieces]
        if len(memory) + len(fresh) > REMEMBERED:
            memory.clear()
        memory.update((x, ids) for x, ids in itertools.islice(fresh.items(), REMEMBERED) if len(x) <= REMEMBERED_CHARS)
        return found

    def whole(self, text: str) -> bytes:
        """Ids of one text, in parts cut at safe places."""
        if not self.cuts:
            return np.asarray(self.encode([text])[0], "<u4").tobytes()
        parts, start = [], 0
        for cut in _CUT.finditer(text):
            if cut.start() - start >= PART_CHARS and "▁" not in text[cut.start() - 1 : cut.end() + 1]:
                parts.append(text[start : cut.start()])
                # Without ``spaced`` the encoder adds the space itself.
                start = cut.start() if self.spaced else cut.end()
        parts.append(text[start:])
        return b"".join(np.asarray(x, "<u4").tobytes() for x in self.encode(parts))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts one after another, and where each text begins (one more entry than texts)."""
        n = len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        unsafe = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False) if self.cuts else np.ones(n, bool)
        easy = pc.if_else(pa.array(unsafe), "", texts)
        if self.spaced:
            # Further cuts, before line feeds and where letters meet signs; a piece that begins so has no space before it.
            easy = pc.replace_substring_regex(pc.replace_substring(easy, "\n", " \n"), _SIGNS, f"\\1 {_JOINT}\\2")
        lists = pc.split_pattern(easy, " ")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = flat.dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).copy()
        if self.spaced:
            firsts = index[offsets[:-1]]
            openers = list(dict.fromkeys(firsts.tolist()))
            place = dict(zip(openers, range(len(words), len(words) + len(openers))))
            pieces = [x if x[:1] == "\n" else x[1:] if x[:1] == _JOINT else f" {x}" for x in words] + [words[i] for i in openers]
            index[offsets[:-1]] = [place[i] for i in firsts.tolist()]
        else:
            pieces = words
        ids = self.known(pieces)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        pool = np.frombuffer(b"".join(ids), "<u4")
        counts = sizes[index]
        ends = np.cumsum(counts, dtype=np.int32)
        # Each occurrence of a piece takes its run of the pool.
        spread = np.repeat(begins[index] - ends + counts, counts)
        spread += np.arange(len(spread), dtype=np.int32)
        stream = pool[spread]
        bounds = np.concatenate(([0], ends))[offsets]
        if unsafe.any():
            rows = [stream[bounds[i] : bounds[i + 1]] for i in range(n)]
            for i in np.flatnonzero(unsafe).tolist():
                rows[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
            stream = np.concatenate(rows)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        return stream, bounds


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process and file. Such a worker gives the memory of finished batches back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    return Encoder(path)


def filled(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def map_texts(df: DataFrame, text: str, step: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch], schema: T.StructType, limit: int) -> DataFrame:
    """``step(batch, texts)`` on byte-balanced batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, text, limit):
            yield step(batch, filled(batch.column(text)))

    return df.mapInArrow(run, schema)


def token_counts(df: DataFrame, path: str, *, text: str = "text", limit: int = 4096, batch_bytes: int = 8 << 20) -> DataFrame:
    """All rows and columns of ``df`` but ``text``, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` is a tokenizers .json or a sentencepiece .model file that every executor can read. Null and empty texts count
    0 bytes and 0 tokens; repeated rows are counted each; columns of the same names as the new ones are replaced; an empty
    table gives an empty one.
    """
    kept = [c for c in df.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        _, bounds = encoder(path).batch(texts)
        sizes = pc.binary_length(texts).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [sizes, pa.array(np.diff(bounds), pa.int64())], names=[*kept, "n_bytes", "n_tokens"])

    return map_texts(df.select(*kept, text), text, count, schema, batch_bytes).withColumn("over_limit", F.col("n_tokens") > limit)
