"""Conversations rendered by a compiled template, with the spans of generated text, and read back.

A conversation is rendered while its sorted turns stream through a task, and leaves it in parts of bounded size, so its
length is limited by neither memory nor a row's size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .template import compile_template

#: A turn is its role's line, its text and the end mark; what an assistant says is generated.
TEMPLATE = (
    "{%- for m in messages -%}\n"
    "{{ '### ' + (m.role | label) + ':\\n' }}\n"
    "{%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}\n"
    "{%- else -%}{{ m.text | escape }}{%- endif -%}\n"
    "{{- '</turn>\\n' }}\n"
    "{%- endfor -%}"
)
PART_CHARS = 1 << 20

_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\\n:]|\\.|:(?!\n))*+):\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def label(text: str) -> str:
    """As :func:`escape`, for one line: line feeds become backslash and n."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS = {"escape": escape, "label": label}


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of equal first column in a sorted stream; each run must be read to its end before the next one."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(rows, None)

        inside = run()
        yield key, inside
        for _ in inside:
            pass


def format_conversations(
    df: DataFrame, template: str = TEMPLATE, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART_CHARS
) -> DataFrame:
    """``conv``, part (from 0), formatted, and loss: the [start, end) spans of ``formatted`` under the loss mask, in code points.

    The parts of a conversation joined in order are its rendering. Turns are in the order of ``turn``, then role, then text,
    nulls first. Null texts and roles are empty; rows of null ``conv`` are one conversation; repeated rows are turns of
    their own. Other columns are dropped; an empty table gives an empty one. The template may loop over ``messages`` once.
    """
    schema = T.StructType([df.schema[conv], T.StructField("part", T.IntegerType()), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    compile_template(template, filters=FILTERS)  # fails here rather than in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, filters=FILTERS)
        kind = None

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in source:
                kind = batch.schema.field(0).type
                yield batch

        held, size = [], 0
        for key, rows in _groups(typed(batches)):
            messages = ({"role": who or "", "text": said or ""} for who, said in rows)
            part, texts, loss, at = 0, [], [], 0
            for piece, masked in render({"messages": messages}):
                if at and at + len(piece) > part_chars:
                    held.append((key, part, "".join(texts), loss))
                    size += at
                    part, texts, loss, at = part + 1, [], [], 0
                if masked and piece:
                    if loss and loss[-1]["end"] == at:
                        loss[-1]["end"] = at + len(piece)
                    else:
                        loss.append({"start": at, "end": at + len(piece)})
                texts.append(piece)
                at += len(piece)
                if size > part_chars:
                    yield _batch(held, (kind, pa.int32(), pa.string(), spans), schema.names)
                    held, size = [], 0
            held.append((key, part, "".join(texts), loss))
            size += at
        if held:
            yield _batch(held, (kind, pa.int32(), pa.string(), spans), schema.names)

    ordered = df.select(conv, role, text, turn).repartition(conv).sortWithinPartitions(conv, turn, role, text).select(conv, role, text)
    return ordered.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_formatted(df: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """What the parts of conversations rendered by :data:`TEMPLATE` hold, per conversation.

    n_turns; turns_sha256 of role, line feed, text, line feed per turn; loss_chars and loss_sha256 of all text under the loss
    mask without its escapes; formatted_chars. A part that does not begin where turns end is completed by the next one;
    a rendering that is not made of whole turns fails.
    """
    names = [conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([df.schema[conv]] + [T.StructField(n, T.StringType() if "sha" in n else T.LongType()) for n in names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = [], None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        kinds = lambda: (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for key, parts in _groups(typed()):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = total = 0
            rest = masked = ""
            for formatted, spans in parts:
                total += len(formatted)
                rest += formatted
                at = 0
                for m in _TURN.finditer(rest):
                    if m.start() != at:
                        break
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n, at = n + 1, m.end()
                rest = rest[at:]
                for span in spans:
                    said = masked + formatted[span["start"] : span["end"]]
                    # An escape may be cut by the end of a part.
                    cut = len(said) - (1 if (len(said) - len(said.rstrip("\\"))) % 2 else 0)
                    said, masked = unescape(said[:cut]), said[cut:]
                    loss.update(said.encode())
                    chars += len(said)
            if rest or masked:
                raise ValueError(f"conversation {key}: {rest[:80]!r} is no whole turn")
            held.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(held) >= 10_000:
                yield _batch(held, kinds(), names)
                held = []
        if held:
            yield _batch(held, kinds(), names)

    ordered = df.select(conv, "part", "formatted", "loss").repartition(conv).sortWithinPartitions(conv, "part")
    return ordered.select(conv, "formatted", "loss").mapInArrow(run, schema)


def with_marks(df: DataFrame, conv: int = -7) -> DataFrame:
    """``df`` (conv_id, turn, role, text) and one conversation whose texts are control strings."""
    said = r"\### Assistant: </turn> ok"
    rows = df.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(who).alias("role")) for i, who in enumerate(("user", "assistant"))))).alias("r"))
    extra = rows.select(F.lit(conv).cast(df.schema["conv_id"].dataType).alias("conv_id"), F.col("r.turn").cast(df.schema["turn"].dataType).alias("turn"), "r.role", F.lit(said).alias("text"))
    return df.select("conv_id", "turn", "role", "text").unionByName(extra)
