"""Session helpers shared by every operator: table access, checkpoints, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir`` (shared by all
    executors, so a lost executor loses nothing). Only where the session names none, as in
    tests, a temporary folder of this machine is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="voltlake-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    The check reads no more than ``max_rows + 1`` rows to the count, so a side that has grown
    past the bound goes through an ordinary shuffled join instead.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, each_core: int = 2) -> DataFrame:
    """``df`` in enough partitions to keep all cores busy, for work that costs much a row.

    A table that already comes in that many partitions isn't moved.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * each_core
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
