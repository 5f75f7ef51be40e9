"""The corpus pipeline: from documents to token ids in five stages.

Each stage works on all that the one before kept and is written to the shared
folder in between.  The first four return the columns of ``documents``, and
whatever other columns they are given.  An empty table passes through all of
them, and texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import bpe, decontaminate, jaccard_join, langid, substring_dedup
from streamloom.llm.common import materialize, scratch, ship, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones too) and texts of no clear language go.

    A tie of two languages has no margin, so its text goes.  Repeated rows and
    null ids are judged by their text like all others; a null language isn't
    learned from.  Without labelled rows no language is known, and all go.
    """
    return langid.identify(docs, keep=True).where(~F.col("rejected")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays, the one with the least id.

    Null and empty texts and rows with a null id have no class and stay;
    repeated rows of one id and text are one.
    """
    return jaccard_join.keep_one(docs).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that start earlier elsewhere go; a text without any keeps its form.

    All rows stay.  Null texts stay null.  Of windows at the same place of rows
    with one id, or with null ids, which come last, the first stored counts as
    earlier.
    """
    found = substring_dedup.deduplicate(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, also those with a null id.

    Null and empty texts contain nothing and stay, as do repeated rows; items
    with a null id, a null text or fewer than five words are never contained.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), nulls=True).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, as little-endian 32-bit integers, and digests of both directions.

    Null and empty texts have no ids; each row has a row, null ids too.
    """
    rows = bpe.encode(docs)
    return rows.select("doc_id", "n_tokens", "ids_le", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can't express compression or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way is deleted once its result is."""
    docs = table(ship(spark), sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            with scratch(spark):
                docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
