"""Language identification by compression.

Each language has a raw-content Zstandard dictionary of words of its training texts, the commonest ones last, where matches
are cheapest. A text is reduced to its distinct words in lower case and compressed with each dictionary; the smallest result
names the language. Short texts are compressed behind two stretches of the dictionary's own words, and count by what they add,
because a frame of few bytes is hardly ever compressed.

A text is rejected if the second-best dictionary does nearly as well, or if the best one hardly does better than none: texts in
a language that was not learned, and letters without a language. What is too little is learned by size class from the texts
that were learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import byte_batches, smallest_hashes, text_hash, unused, up_to_hash

SAMPLE_ROWS = 400  # training texts of a language
DICTIONARY_BYTES = 65_536
COUNTED_WORDS = 200_000  # words a task holds before it passes them on
LEVEL = 9
SHORT_BYTES = 512
STRETCH_BYTES = 1024
CLASSES = (64, 256, 1024, 4096)  # bytes of distinct words at which the next size class begins
LIMIT = 0.05  # margins and gains above this are never rejected
SHARE = 1 / 3  # nor those above this share of the median of their class
FRAME_BYTES = 9  # of a compressed frame without content
LANGUAGES = 200  # more are an error: every text is compressed once per language

_WORDS = re.compile(r"[^\W\d_]+")


def distinct_words(text: str) -> bytes:
    """The distinct words of a whole text in lower case, in order of first appearance."""
    return " ".join(dict.fromkeys(_WORDS.findall(text.lower()))).encode("utf-8", "surrogatepass")


class Dictionaries(dict):
    """Dictionary content by language, and ``limits``: per size class the least margin and the least gain."""

    limits: dict[int, tuple[float, float]]

    def __init__(self, contents: dict[str, bytes], limits: dict[int, tuple[float, float]] | None = None):
        super().__init__(contents)
        self.limits = limits or {}


def train(df: DataFrame, *, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> Dictionaries:
    """Dictionaries of the languages of ``df``, each of the ``rows`` distinct texts with the smallest hashes, or of all if there are fewer.

    The sample is bounded by languages x rows; its texts are used whole, and what reaches the driver is bounded by languages x
    size. Copies of a text count once, however many there are. Rows whose language or text is null or without letters are not
    used.
    """
    usable = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("text").rlike(r"\p{L}"))
    hashed = usable.withColumn("h", text_hash("text"))
    _, last = smallest_hashes(hashed, "lang", LANGUAGES, lambda distinct: {x: min(rows, n) for x, n in distinct.items()})
    if not last:
        return Dictionaries({})
    first = materialize(up_to_hash(hashed, "lang", last).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text"), "sample")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        for batch in byte_batches(batches, "text"):
            for name, whole in zip(batch.column(0), batch.column(1)):
                counts.update((name.as_py(), m[0]) for m in _WORDS.finditer(whole.as_py().lower()))
                if len(counts) > COUNTED_WORDS:
                    yield _counted(counts)
                    counts.clear()
        if counts:
            yield _counted(counts)

    counted = first.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # A word takes two bytes at least, so that no more than size / 2 words have room.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = counted.filter(F.octet_length("word") < size).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size // 2)
    used = F.sum(F.octet_length("word") + 1).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    found = common.withColumn("used", used).filter(F.col("used") <= size).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word")), asc=False)["word"].alias("words"))
    contents = {r["lang"]: " ".join(r["words"]).encode("utf-8", "surrogatepass") for r in sorted(found.collect(), key=lambda r: r["lang"])}
    return Dictionaries(contents, _limits(first, contents))


def _limits(sample: DataFrame, contents: dict[str, bytes]) -> dict[int, tuple[float, float]]:
    """The limits of each size class: a share of the median margin and gain of the texts that get their own language."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(Dictionaries(contents))
        for batch in batches:
            found = [(lang, classifier.measure(distinct_words(text))) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())]
            rows = [(kind, margin, gain) for lang, (best, margin, gain, kind) in found if best == lang]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.float64(), pa.float64()))], names=["kind", "margin", "gain"])

    medians = sample.mapInArrow(measured, "kind int, margin double, gain double").groupBy("kind").agg(F.median("margin").alias("margin"), F.median("gain").alias("gain"))
    return {r["kind"]: (min(LIMIT, SHARE * r["margin"]), min(LIMIT, SHARE * r["gain"])) for r in medians.collect()}


def _counted(counts: Counter[tuple[str, str]]) -> pa.RecordBatch:
    langs, words = zip(*counts)
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])


class Classifier:
    """Compressors of one worker process."""

    def __init__(self, dictionaries: Dictionaries):
        self.limits = dictionaries.limits
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.models = []
        for lang, content in dictionaries.items():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            model = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)
            middle, late = len(content) // 2, len(content) * 7 // 8
            stretches = [content[at : at + STRETCH_BYTES] + b" " for at in (middle, late)]
            self.models.append((lang, model, [(s, len(model.compress(s))) for s in stretches]))

    def sizes(self, words: bytes) -> list[tuple[int, str]]:
        """(compressed size, language), smallest first."""
        if len(words) >= SHORT_BYTES:
            found = [(len(model.compress(words)), lang) for lang, model, _ in self.models]
        else:
            found = [(sum(len(model.compress(s + words)) - n for s, n in stretches), lang) for lang, model, stretches in self.models]
        return sorted(found)

    def measure(self, words: bytes) -> tuple[str, float, float, int]:
        """(language, margin to the second-best, gain over no dictionary, size class); a single language has all the margin."""
        (best, lang), *others = self.sizes(words)
        alone = len(self.plain.compress(words))
        if len(words) < SHORT_BYTES:
            alone = 2 * max(1, alone - FRAME_BYTES)
        margin = (others[0][0] - best) / max(1, others[0][0]) if others else 1.0
        return lang, margin, 1 - best / max(1, alone), sum(len(words) >= n for n in CLASSES)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, score between 0 and 1, rejected); the score falls to 0.5 as two languages come equal."""
        if not self.models or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        words = distinct_words(text)
        lang, margin, gain, kind = self.measure(words)
        # A dictionary of one size helps a longer text by a smaller share.
        shrink = min(1.0, (CLASSES[-1] / max(1, len(words))) ** 0.5)
        least_margin, least_gain = (shrink * x for x in self.limits.get(kind, (LIMIT, LIMIT)))
        return lang, min(1.0, 0.5 + 2.5 * margin), margin < least_margin or gain < least_gain or not margin


def predicted(column: str, dictionaries: Dictionaries) -> Column:
    """A struct lang_pred, score, rejected of a whole text; null and texts without letters are ``und`` and rejected."""
    holder: list[Classifier] = []

    @F.pandas_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def of(texts: pd.Series) -> pd.DataFrame:
        if not holder:
            holder.append(Classifier(dictionaries))
        return pd.DataFrame([holder[0].predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return of(F.coalesce(F.col(column), F.lit("")))


def identify(df: DataFrame, dictionaries: Dictionaries, *, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and rejected, which replace columns of those names.

    Null and texts without letters are ``und`` and rejected, and so is every text if nothing was learned. Repeated rows are
    judged each; an empty table gives an empty one.
    """
    own = unused(df, "__lang")
    found = df.withColumn(own, predicted(text, dictionaries)).drop("lang_pred", "score", "rejected")
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c != own], f"{own}.*")
