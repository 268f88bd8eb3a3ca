"""From raw documents to token digests in five stages, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before has kept.  All but the last return
the columns of documents, so stages can be left out or run one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from busnet.llm import bpe, decontam, langid, lines, minhash
from busnet.llm.queries import RANKS
from busnet.session import configure, keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is predicted with some confidence; without labels, all with letters.

    The least confidence is that of `langid.least_score` on the labelled rows held back from learning.  A missing lang is
    filled in; a given one stays.
    """
    configure(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    least = langid.least_score(docs.filter(langid.held_out()), model)
    known = langid.predict(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without long lines and runs of lines that stand earlier in the corpus; documents that lose all lines go."""
    configure(spark)
    cut = lines.without_repeats(docs.select(*COLUMNS), lone=lines.LONE).filter(~F.col("emptied"))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Rows without a doc_id come after the others; of those that share one, or have none, one stays.
    """
    configure(spark)
    # groups are found by a number for each row, whatever the ids are
    rows = keep(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "near-rows")
    groups = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = (
        groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")).select("first.row")
    )
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    configure(spark)
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    configure(spark)
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Models and sketches have no SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
