"""Benchmark passages found through a distributed positional index; DataFrame functions only.

The index holds a posting (row, term, position) for every place of a training text where a term of the benchmark stands; it
is written once, in the order of the texts. A window of a benchmark item is looked up from its rarest terms: their postings,
shifted by the terms' offsets in the item, name alignments of item and text, and an alignment is a candidate for a phrase if it
has all of a window's rarest terms, for a near match if it has one of enough of them. Only there are the postings of the other
terms met, and runs of as many consecutive words as the window has are its exact occurrences; alignments that come close to it
are proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small, text_of, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
RAREST = 3  # rarest terms of a window that make a candidate
BROADCAST_ROWS = 200_000  # at most so many small rows (terms, or row ids) are broadcast; more are joined by shuffling
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(column: str) -> Column:
    """The words of a text after lower-casing A-Z; none for null."""
    return F.regexp_extract_all(F.translate(text_of(column), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    return small(df, BROADCAST_ROWS)


def benchmark_terms(items: DataFrame, *, item: str = "item_id", text: str = "text") -> DataFrame:
    """item (a number of its own per row), item_id, place, word, n (words of the item)."""
    rows = items.select(F.col(item).alias("item_id"), words_of(text).alias("words")).filter(F.size("words") > 0)
    numbered = rows.withColumn("item", F.monotonically_increasing_id())
    return numbered.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))


def positional_index(df: DataFrame, vocabulary: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of ``df``: row, ``key``, term, position, for the words of ``vocabulary`` (word, term >= 0).

    Each text also has one posting of term -1, whose position is its number of words.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), words_of(text).alias("words"))
    # No word is made of a line feed, so it can stand for the end of a text.
    placed = rows.select("row", "doc_id", F.posexplode(F.concat("words", F.array(F.lit("\n")))).alias("position", "word"))
    ends = vocabulary.sparkSession.range(1).select(F.lit("\n").alias("word"), F.lit(-1).cast("long").alias("term"))
    known = vocabulary.select("word", "term").unionByName(ends)
    return materialize(placed.join(_small(known), "word").select("row", "doc_id", "term", "position"), "postings")


def alignments(index: DataFrame, terms: DataFrame, *, window: int = WINDOW, rarest: int = RAREST, near: int | None = None) -> DataFrame:
    """row, item, shift, places: candidate alignments and the places of the item whose word stands at place + shift in the text.

    Without ``near`` an alignment must have the ``rarest`` rarest terms of some window. With it, one of its w - near + 1 rarest
    ones is enough, w being the words of the window: whatever has ``near`` words of a window lacks at most w - near of them.
    """
    counts = index.filter("term >= 0").groupBy("term").agg(F.count("*").alias("found"))
    placed = materialize(terms.join(counts, "term", "left").fillna(0, ["found"]).select("item", "n", "place", "term", "found"), "terms")
    wide = F.least(F.col("n"), F.lit(window))
    # Every place belongs to the windows that begin up to window - 1 places before it.
    first = F.greatest(F.lit(0), F.col("place") - wide + 1)
    spread = placed.select("item", "place", "term", "found", F.explode(F.sequence(first, F.least(F.col("place"), F.col("n") - wide))).alias("start"))
    ranked = spread.groupBy("item", "start").agg(F.sort_array(F.collect_list(F.struct("found", "place", "term"))).alias("by"))
    if near is None:
        windows = ranked.filter(F.col("by")[0]["found"] > 0).select("item", "start", F.slice("by", 1, rarest).alias("by"))
    else:
        enough = F.slice("by", F.lit(1), F.greatest(F.size("by") - near, F.lit(0)) + 1)
        windows = ranked.select("item", "start", F.filter(enough, lambda x: x["found"] > 0).alias("by")).filter(F.size("by") > 0)
    windows = materialize(windows.select("item", "start", F.col("by.place").alias("anchors"), F.col("by.term").alias("anchor_terms")), "windows")
    anchors = windows.select("item", F.explode(F.arrays_zip("anchors", "anchor_terms")).alias("a")).select("item", F.col("a.anchors").alias("place"), F.col("a.anchor_terms").alias("term")).distinct()
    met = index.filter("term >= 0").select("row", "term", "position").join(_small(anchors), "term").select("row", "item", (F.col("position") - F.col("place")).alias("shift"), "place")
    if near is None:
        least = windows.groupBy("item").agg(F.min(F.size("anchors")).alias("least"))
        lists = met.groupBy("row", "item", "shift").agg(F.collect_set("place").alias("have"))
        asked = windows.groupBy("item").agg(F.collect_set("anchors").alias("asked")).join(least, "item")
        candidates = lists.join(_small(asked), "item").filter(F.size("have") >= F.col("least"))
        candidates = candidates.filter(F.exists("asked", lambda a: F.size(F.array_except(a, F.col("have"))) == 0))
    else:
        candidates = met.select("row", "item", "shift").distinct()
    candidates = materialize(candidates.select("row", "item", "shift"), "candidates")
    own = index.filter("term >= 0").select("row", "term", "position").join(_small(candidates.select("row").distinct()), "row", "left_semi")
    due = candidates.join(_small(placed.select("item", "place", "term")), "item").select("row", "item", "shift", "place", "term", (F.col("place") + F.col("shift")).alias("position"))
    both = due.join(own, ["row", "term", "position"])
    return both.groupBy("row", "item", "shift").agg(F.sort_array(F.collect_list("place")).alias("places"))


def matches(index: DataFrame, terms: DataFrame, *, window: int = WINDOW, rarest: int = RAREST, near: int | None = 8) -> DataFrame:
    """row, item, shift, kind, starts, most: where items occur.

    kind is ``phrase`` with the places where windows begin that occur word for word, or ``proximity`` (no starts) if at
    least ``near`` words of some window, whichever they are, stand at their places; most is the largest such number. Without
    ``near`` only phrases are looked for.
    """
    found = alignments(index, terms, window=window, rarest=rarest, near=near).join(_small(terms.select("item", "n").distinct()), "item")
    wide = F.least(F.col("n"), F.lit(window))
    runs = F.filter(F.sequence(F.lit(0), F.size("places") - 1), lambda i: F.try_element_at("places", (i + wide).cast("int")) - F.col("places")[i] == wide - 1)
    most = F.array_max(F.transform("places", lambda p: F.size(F.filter("places", lambda q: (q >= p) & (q < p + wide)))))
    found = found.withColumn("starts", F.transform(runs, lambda i: F.col("places")[i])).withColumn("most", most).withColumn("wide", wide)
    kind = F.when(F.size("starts") > 0, "phrase")
    kind = kind if near is None else kind.when(F.col("most") >= near, "proximity")
    return found.withColumn("kind", kind).filter("kind IS NOT NULL").select("row", "item", "shift", "kind", "starts", "most", "wide")


def contamination(df: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``key``, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``df``.

    A window is ``window`` consecutive words of an item; a shorter item is one window, one without words none. Every word of
    a text inside an occurrence is hit, once. Null and empty texts have no words. Repeated rows and keys are texts of their
    own; items of equal id count as one; null item ids are not listed. Empty tables give no hits or no rows.
    """
    terms = materialize(benchmark_terms(items, item=item, text=item_text), "items")
    # Numbers of a distributed count: below 2^33 per task, so they stay long.
    vocabulary = materialize(terms.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    index = positional_index(df, vocabulary, key=key, text=text)
    coded = terms.join(_small(vocabulary), "word")
    found = materialize(matches(index, coded, window=window, near=None), "matches")
    places = found.select("row", F.explode("starts").alias("start"), "shift", "wide").select("row", F.explode(F.sequence(F.col("start") + F.col("shift"), F.col("start") + F.col("shift") + F.col("wide") - 1)).alias("position"))
    hits = places.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    names = found.select("row", "item").distinct().join(_small(terms.select("item", "item_id").distinct()), "item").filter("item_id IS NOT NULL").select("row", F.col("item_id").cast("string").alias("id")).distinct()
    lists = names.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("id"))), 256).alias("items_sha256"))
    texts = index.filter("term = -1").select("row", "doc_id", F.col("position").cast("long").alias("n_words"))
    out = texts.join(hits, "row", "left").join(lists, "row", "left")
    return out.select(
        F.col("doc_id").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``df`` in which no window of an item occurs, with all their columns."""
    own = unused(df, "__row")
    rows = materialize(df.withColumn(own, F.monotonically_increasing_id()), "numbered")
    found = materialize(contamination(rows, items, key=own, text=text, item=item, item_text=item_text, window=window).filter("contaminated").select(own), "contaminated")
    return rows.join(_small(found), own, "left_anti").drop(own)
