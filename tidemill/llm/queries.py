"""The operators' queries: one opN_<name> for each, over whole tables with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, language_model, licences, mixing, passages, pieces, prefix_trie, ranked, simhash, surrogates, toxicity
from .oracle import ORACLE

#: Path of a public vocabulary file; another one is given by setting this or by calling the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> str:
    """The session's key of surrogates: spark.tidemill.surrogates.key, or one drawn for this session if that is unset."""
    name = "spark.tidemill.surrogates.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), MODEL)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(documents, surrogate_key(spark))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.removals(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    turns = turns.union(spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema))
    events = turns.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message_id"), F.lit("message").alias("kind"), "role", "text")
    back = chat.read_back(chat.format_chats(events))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allotted(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie.nodes(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_decontaminate": op2_decontaminate, "op3_pieces": op3_pieces, "op4_licences": op4_licences, "op5_surrogates": op5_surrogates, "op6_passages": op6_passages, "op7_simhash": op7_simhash, "op8_chat_format": op8_chat_format, "op9_embeddings": op9_embeddings, "op10_language_model": op10_language_model, "op11_mix_sources": op11_mix_sources, "op12_ranked_search": op12_ranked_search, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
