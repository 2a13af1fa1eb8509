"""One query per operator: production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtab.llm import merkle, pii, secrets, tokens
from logtab.llm.chat import perspectives
from logtab.llm.common import materialise
from logtab.llm.divergence import divergence
from logtab.llm.embeddings import near_vectors
from logtab.llm.linededup import dedup_lines
from logtab.llm.mixing import mixed, profile
from logtab.llm.packing import pack, text_cluster, word_count
from logtab.llm.quality import judged
from logtab.llm.oracle import SQL
from logtab.llm.simhash import simhash_groups
from logtab.llm.spans import digest
from logtab.llm.urls import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(secrets.find_secrets(table(spark, sf_dir, "documents")), "doc_id", secrets.BASE)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pii.find_personal_data(table(spark, sf_dir, "documents")), "doc_id", pii.BASE)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, "doc_id", word_count(F.col("text")), F.col("source"), text_cluster(F.col("text")))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("n_candidates")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's topic, expected copies and copies drawn."""
    rows = materialise(profile(table(spark, sf_dir, "documents")), "mix-profile")
    return mixed(rows, repeats=True).withColumnRenamed("id", "doc_id").drop("key")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every perspective; the trained stretches as text."""
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("spans", F.array_join(spans, ","))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text and its counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, from the files read back."""
    path = tokens.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_tokens(spark, path).select(
        F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; some documents have lost their line feeds."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string")) % 2 == 0
    changed = F.when(tampered, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    done = merkle.manifest(docs, changed)
    hexed = [merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return done.select(
        F.col("id").alias("doc_id"), *hexed, F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        merkle.hexed(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secrets, op2_pii, op3_simhash, op4_quality, op5_packing, op6_urls, op7_mixing, op8_chat,
                            op9_line_dedup, op10_embeddings, op11_tokens, op12_divergence, op13_merkle)
}

__all__ = ["QUERIES", "SQL"]
