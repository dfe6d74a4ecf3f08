"""The registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdlens.llm.chat import format_turns, read_conversations, text_part
from holdlens.llm.decontamination import contaminated
from holdlens.llm.language_id import identify_languages
from holdlens.llm.licenses import scan_licenses
from holdlens.llm.media import text_media
from holdlens.llm.merkle import merkle_manifest
from holdlens.llm.near_duplicates import near_duplicates
from holdlens.llm.oracle import merkle_sql, search_sql
from holdlens.llm.packing import pack
from holdlens.llm.passages import KEEP_STOCK_LINES, remove_repeats
from holdlens.llm.pii import find_personal_data
from holdlens.llm.pii import train as train_field
from holdlens.llm.search import search
from holdlens.llm.sharding import shard_by_bytes
from holdlens.llm.toxicity import grade_toxicity, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_text(column: str):
    return F.concat_ws(",", F.transform(column, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))).alias(column)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, as pairs."""
    out = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.drop("text_hash").distinct()


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity grade of every document."""
    docs = _table(spark, sf_dir, "documents")
    return grade_toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))


#: A conversation of control strings, which goes through the format as the others do.
HARD_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted text."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(HARD_TURNS, "conv_id long, turn long, role string, text string"))
    return read_conversations(format_turns(turns.withColumn("parts", text_part(F.col("text")))))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with repeated passages cut out, short stock lines apart; spans are start-end in bytes of the original."""
    out = remove_repeats(_table(spark, sf_dir, "documents"), **KEEP_STOCK_LINES)
    return out.select("doc_id", "text", "n_units", "n_removed", "n_spans", _span_text("removed"), _span_text("kept"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as audio samples, sniffed, carved and read back."""
    return text_media(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    return shard_by_bytes(_table(spark, sf_dir, "documents"), 16)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on two-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    return pack(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify_languages(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    spans = F.transform("detections", lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string")))
    return out.withColumn("detections", F.concat_ws(",", spans))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, folded with the texts of half of them tampered with."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    text = F.when(F.coalesce(odd, F.lit(True)), F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("")))
    return merkle_manifest(_table(spark, sf_dir, "documents"), text)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = _table(spark, sf_dir, "documents")
    return find_personal_data(docs, train_field(docs))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_chat_format": op3_chat_format,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_media": op5_media,
    "op6_sharding": op6_sharding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_pii": op12_pii,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": merkle_sql(), "op13_ranked_search": search_sql()}
