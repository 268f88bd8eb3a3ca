"""The registered queries of this package: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from busnet.llm import bpe, centroids, conversations, decontam, langid, lines, minhash, quality, secrets, sharding, suffix, topk, toxicity
from busnet.session import configure, keep

#: Rank file of the byte-level BPE; any other file of that form can be given to `bpe`.
RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return topk.search(vectors, F.col("id") % 20 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items found in them, and the best similarity."""
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("similarity"), 9).alias("similarity"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner is the source; the repository is the source and language."""
    return secrets.scan(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Similarity(shingle=4))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels grow with the documents: one plan at every size
    learned = docs.filter(~langid.held_out()).select("doc_id", "text").join(labels.hint("merge"), "doc_id").select("text", "toxic")
    model = toxicity.fit(keep(learned, "toxicity-labelled"))
    return toxicity.score(docs, model).select(
        "doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "best", "n_passages"
    )


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), lone=lines.LONE)
    return docs.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score"
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.documents_to_shards(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repaired = conversations.summary(conversations.repair(conversations.damaged(turns)))
    every = turns.select("conv_id").distinct()
    found = every.join(repaired.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, found, _ = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(members, found)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk": op1_topk,
        "op2_decontamination": op2_decontamination,
        "op3_secrets": op3_secrets,
        "op4_suffix": op4_suffix,
        "op5_minhash": op5_minhash,
        "op6_toxicity": op6_toxicity,
        "op7_lines": op7_lines,
        "op8_language": op8_language,
        "op9_bpe": op9_bpe,
        "op10_sharding": op10_sharding,
        "op11_conversations": op11_conversations,
        "op12_centroids": op12_centroids,
        "op13_quality": op13_quality,
    }
