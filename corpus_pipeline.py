"""The corpus pipeline: documents through five of the operators, each stage over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import copies, decontaminate, pieces, queries, surrogates, toxicity
from tidemill.llm.common import small, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of documents that are here.

    Null and empty texts are scored like others, repeated rows share a score, an empty table stays empty.
    """
    found = toxicity.scored(docs, queries.table(spark, sf_dir, "labels"), "~score")
    return found.where(F.col("~score") < 0.5).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at Jaccard 0.8 or more over five-word shingles the document of the smallest doc_id; op7's ball hashing and bands propose, exact Jaccard decides."""
    return copies.without_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no window of a benchmark item occurs; rows go by their texts, whatever their doc_id, and null texts stay."""
    texts = docs.select(F.md5("text").alias("doc_id"), "text").where("text IS NOT NULL")
    hit = decontaminate.contamination(texts, queries.table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("~text")).distinct()
    return docs.withColumn("~text", F.md5("text")).join(small(stored(hit, "contaminated")), "~text", "left_anti").select(docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data; n_chars follows the new text. Null texts and rows without a doc_id stay as rows."""
    found = surrogates.replaced(docs, queries.surrogate_key(spark))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row: doc_id, ids and what round_trips() tells of them; null texts have none."""
    return pieces.round_trips(docs, queries.MODEL)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("surrogates", replace_private), ("pieces", encode)]

#: SQL can express neither the classifier nor the fingerprints; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each but the last is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
