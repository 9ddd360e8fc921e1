"""A training corpus from ``documents``: language, exact and near duplicates, benchmark passages, packing.

Every stage takes rows as they come: null and empty texts, texts of any length, repeated rows and ids, null ids, empty tables
and columns beside those of ``documents``, which all stages but the last return as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescribe.llm import contamination, exact, language, packing, simhash
from tablescribe.llm.common import table
from tablescribe.llm.queries import PACKING_MODEL, tokenizer
from tablescribe.session import new_path, scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; not those without letters. Repeated rows are judged alike."""
    return language.identify(docs, language.train(docs)).filter("NOT rejected").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, null coming last; null texts are equal to empty ones. Of repeated rows one stays."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document with the smallest id; all texts without words are one component."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null texts have none. Without items all stay."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; null texts are their end token."""
    return packing.pack(docs, tokenizer(PACKING_MODEL))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: No SQL: languages are learned, fingerprints need 64-bit hashes of shingles, and packing needs a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        # What a stage writes on its way is not kept longer than the stage.
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
