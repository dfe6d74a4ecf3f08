"""From raw documents to packed sequences, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and
read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdlens.llm.cluster import checkpoint_dir
from holdlens.llm.decontamination import drop_contaminated
from holdlens.llm.language_id import keep_identified
from holdlens.llm.near_duplicates import keep_one_of_each
from holdlens.llm.packing import pack
from holdlens.llm.passages import KEEP_STOCK_LINES, remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, by cosines that labelled documents of their length have; others go."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8)."""
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has, short stock lines apart; none goes."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others")
    made = remove_repeats(docs.select("doc_id", "text", others), **KEEP_STOCK_LINES)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return made.select(*(new.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
