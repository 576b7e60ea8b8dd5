"""Shared plumbing of the operators: checkpoints and splits."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; without one, a temporary folder in local mode and RuntimeError elsewhere."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this job, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: A key with more than 1 / HOT of all rows is hot; so there are fewer than HOT of them.
HOT = 1024


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The hot keys of df, fewer than HOT rows, which may be broadcast whatever the size of df."""
    return cut(df.groupBy(key).count().where(F.col("count") > max(1, df.count() // HOT)).select(key))


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """many joined with one, which has one row a key at most; the rows of hot keys stay where they are and meet a broadcast."""
    hot = F.broadcast(hot_keys(many, key) if hot is None else hot)
    near = F.broadcast(one.join(hot, key, "left_semi"))
    return many.join(hot, key, "left_semi").join(near, key, how).unionByName(many.join(hot, key, "left_anti").join(one, key, how))


def held_out(doc_id: str, mod: int, rest: int):
    """Whether crc32 of doc_id as text leaves `rest` modulo `mod`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))
