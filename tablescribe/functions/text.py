"""Scalar text functions, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The size limit of a prompt and the notes that mark a cut text.
MAX_PROMPT_CHARS = 120_000
PROMPT_NOTE = "\n\n...[prompt truncated from {n} to {limit} chars]..."
BLOCK_NOTE = "\n...[{label} truncated at {limit} chars]..."
DOMAIN_BLOCK_NOTE = "...(truncated)"

# Every character that separates words: Unicode white space and the four information separators.
_WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def tokenize(text: Column) -> Column:
    """Lower-cased words split on white space; punctuation stays, NULL gives no words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _WHITESPACE), "")


def cap_text(text: Column, limit: int, note: Column) -> Column:
    """``text`` unchanged up to ``limit`` characters, else its first ``limit`` characters and ``note``."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), note))


def cap_block(block: Column, limit: int, label: str) -> Column:
    """A JSON block cut to ``limit`` characters with a note naming the block."""
    return cap_text(block, limit, F.lit(BLOCK_NOTE.format(label=label, limit=limit)))


def cap_domain_block(block: Column, limit: int) -> Column:
    """A JSON block cut to ``limit`` characters with the short note of the domain prompts."""
    return cap_text(block, limit, F.lit(DOMAIN_BLOCK_NOTE))


def cap_prompt(prompt: Column, limit: int = MAX_PROMPT_CHARS, strict: bool = False) -> Column:
    """A prompt cut to ``limit`` characters with a note; ``strict`` fails the query instead."""
    before, after = PROMPT_NOTE.replace("{limit}", str(limit)).split("{n}")
    if strict:
        message = F.concat(F.lit("prompt too long: "), F.length(prompt).cast("string"), F.lit(" chars"))
        return F.when(F.length(prompt) <= limit, prompt).otherwise(F.raise_error(message))
    note = F.concat(F.lit(before), F.length(prompt).cast("string"), F.lit(after))
    return cap_text(prompt, limit, note)


def csv_field(value: Column) -> Column:
    """One CSV field: NULL is empty; a value with a comma, quote or line break is quoted."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), F.lit("")).when(value.rlike('[,"\r\n]'), quoted).otherwise(value)
