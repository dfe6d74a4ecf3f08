"""The registered queries return what their contracts name, over whole tables."""

import hashlib

import duckdb
import pytest

from holdlens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op3_chat_format": "conv_id bigint n_turns bigint turns_sha256 string loss_chars bigint loss_sha256 string formatted_chars bigint",
    "op5_media": "doc_id bigint n_bytes bigint payload_bytes bigint payload_sha256 string tail_crc32 bigint media_bytes bigint media_sha256 string feature string",
    "op6_sharding": "doc_id bigint size bigint text_crc32 bigint law string shard int slot bigint grown_shard int",
    "op7_minhash_near_dedup": "doc_id bigint n_shingles bigint component_id bigint kept boolean",
    "op8_packing": "doc_id bigint start bigint length bigint ids_crc32 bigint doc_tokens bigint sequence_id bigint offset bigint",
    "op9_language_id": "doc_id bigint held_out boolean lang_pred string score double",
    "op10_license_scan": "doc_id bigint n_words bigint n_base bigint first_word bigint last_word bigint base_labels string labels string score double",
    "op11_merkle_manifest": "doc_id bigint leaf string subroot string root string proof_sha256 string folded_root string verified boolean",
    "op12_pii": "doc_id bigint n_email bigint n_ip bigint n_card bigint n_phone bigint base_sha256 string spans string",
}


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_and_documents(spark, name):
    out = QUERIES[name](spark, SF)
    words = CONTRACT[name].split()
    assert dict(zip(words[::2], words[1::2])).items() <= dict(out.dtypes).items()
    if "doc_id" in out.columns:
        ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
        assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in ids.collect()}


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_rows_are_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()]
    assert got and sorted(got, key=str) == sorted(want.fetchall(), key=str)


def test_conversations_and_the_one_of_control_strings(spark):
    got = {r.conv_id: r for r in QUERIES["op3_chat_format"](spark, SF).collect()}
    turns = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert set(got) == set(turns)
    for c, found in turns.items():
        found.sort()
        loss = "".join(t for _, r, t in found if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in found).encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(found), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_with_null_turns_repeated_rows_and_long_texts(spark):
    from holdlens.llm.chat import format_turns, read_conversations, text_part
    from pyspark.sql import functions as F

    rows = [(1, None, "user", "first", 1), (1, 2, "assistant", "x" * 300_000 + "</s>", 1), (1, 2, "assistant", "x" * 300_000 + "</s>", 2), (None, None, None, None, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in read_conversations(format_turns(df.withColumn("parts", text_part(F.col("text"))))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * 300_004 and got[None].n_turns == 1 and got[None].loss_chars == 0


def test_document_level_reports(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, SF).collect()} == {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    for r in QUERIES["op4_substring_dedup"](spark, SF).collect():
        spans = [tuple(map(int, x.split("-"))) for x in r.kept.split(",") if x]
        assert b"".join(docs[r.doc_id].encode()[a:b] for a, b in spans).decode() == (r.text or "")
