"""Documents with every kind of trouble, shared by the tests of this folder."""

WORDS = "the of and stream river stone water light under over between".split()
LONG = " ".join(f"{WORDS[i % 11]}{i % 97}" for i in range(30_000))

DOCS = [
    (1, "The river of stone and water.", "en", "a"),
    (2, "The  river\tof stone\nand water.", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "fr", "b"),
    (6, "el río de piedra y agua, ñandú y cigüeña", "es", "b"),
    (7, LONG, "en", "a"),
    (8, LONG + " end", "en", "a"),
    (9, "<|endoftext|> a  b   c d ▁e\r\n\r\nf</s><s> <unk>   g", "en", "c"),
    (10, "日本語 " * 50, None, "c"),
    (11, "12345 !!! ...", "en", "c"),
    (12, "x" * 50_000, "en", "c"),
    (None, "The river of stone and water.", "en", "c"),
    (2, "The  river\tof stone\nand water.", "en", "a"),
    (13, "emoji 👩‍👩‍👧 and 𝔘𝔫𝔦code", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = "n_bytes n_tokens over_limit lang_pred score rejected predicted fingerprint component_id keep_id group_size kept text_sha256 n_words n_hit n_items fp row term position __row __fp __key __sha __text __lang __score __owner __size".split()


def documents(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(f"old {c}") for c in CLASHING})


def pairs(df, *columns):
    """Rows as a sorted list."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
