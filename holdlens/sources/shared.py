"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary one, which goes when the driver's process ends; a session
    with executors elsewhere must name a folder that all of them see.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="holdlens-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the checkpoint folder and read from there from now on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as a Parquet table to the shared folder and read from it: a short plan whose columns can be pruned."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Parts of a ``spread``, for each shuffle partition at least, and rows of a part at most (a few columns each).
SPREAD, PART_ROWS = 4, 500_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` dealt by ``keys`` into more parts than a shuffle has, and they stay that many: for steps that make several rows of one, or sort and keep them.

    ``rows``: how many there are. Parts grow with them, whatever the session's number of shuffle partitions, so what a task sorts stays in its memory.
    """
    parts = SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-rows // PART_ROWS)), *keys)


#: Rows of a table of a few columns that is broadcast whatever Spark takes its size for.
SMALL_ROWS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast in a join if it has at most ``SMALL_ROWS`` rows, else hashed by parts: the other side isn't sorted. It is counted, so it should be a file's or a written table."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df.hint("shuffle_hash")
