"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's docs. All stages but the last return the
columns of ``documents``. Null and empty texts go at the first stage, as they have
no letter; later stages treat a null text as empty and keep null ids and repeated
rows but for near duplicates, of which one row stays. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import contamination, language, packing, secrets, simhash
from factorloom.llm.common import own_name, stored, table

#: The stages' models and hashes are no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or far from every centroid, go.

    The centroids are fitted on a bounded sample of the documents given that have a language.
    """
    model = language.fit(docs, draw=F.xxhash64("doc_id"))
    names = tuple(own_name(docs, x) for x in ("lang_pred", "lang_score", "lang_rejected"))
    return language.identify(docs, model, names=names).where(~F.col(names[2])).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of 4096."""
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("contamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result lies in the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
