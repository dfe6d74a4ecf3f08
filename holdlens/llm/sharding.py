"""Contiguous shards of near-equal bytes from global prefix sums.

Documents are ordered by (doc_id, text CRC, size) over range partitions. Each partition's total
gives where it starts in the whole, a running sum gives where each document lies in it, and the
whole is cut at equal targets: a document belongs to the shard in whose part its middle byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdlens.llm.cluster import cut


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of each row of ``docs(doc_id, text)``.

    size: UTF-8 bytes of the text, none for null, and 1; slot: the place in the shard, from 0. Null ids come
    first, rows that repeat keep a place each, and other columns are not read. grown_shard is null, since this law
    moves documents where shards are added. An empty table gives an empty table; where there are fewer documents than shards,
    some shards stay empty.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))
    order = ["doc_id", "text_crc32", "size", "tie"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    # one row for each partition
    totals = sorted(ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect())
    starts, at, count = [], 0, 0
    for r in totals:
        starts.append((r.part, at, count))
        at, count = at + r.bytes, count + r.rows
    before = F.broadcast(spark.createDataFrame(starts, "part int, bytes_before long, rows_before long"))
    within = Window.partitionBy("part").orderBy(*order)
    sums = ranged.select(*order, "part", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(within).alias("nth")).join(before, "part")
    sums = sums.withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
    placed = sums.withColumn("shard", F.expr(f"cast((twice_middle * {shards}) div {max(1, 2 * at)} as int)"))
    placed = placed.withColumn("place", F.col("rows_before") + F.col("nth") - 1)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
