"""Steps over pointers between rows, as Spark joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_checkpoints(spark: SparkSession) -> None:
    """Have checkpoints go to ``spark.checkpoint.dir``; where it is unset and all is one machine, to a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(root or f"file://{tempfile.mkdtemp(prefix='effectql-')}")


def follow(pointers: DataFrame, node: str, up: str) -> DataFrame:
    """(node, root) for rows that point at another one: the row at which following the pointers ends.

    ``pointers`` has a row for each node that points at another; pointers form no cycle. Each round a pointer
    takes the place of that of the row it points at, so there are as many rounds as the logarithm of the
    longest chain. Many rows may point at one; the join is split where it is skewed, as a row has one pointer.
    """
    shared_checkpoints(pointers.sparkSession)
    state = pointers.select(F.col(node).alias("node"), F.col(up).alias("root")).checkpoint()
    while True:
        above = state.select(F.col("node").alias("root"), F.col("root").alias("__above"))
        moved = state.join(above, "root", "left").select("node", F.coalesce("__above", "root").alias("root"), F.col("__above").isNotNull().alias("__moved")).checkpoint()
        state = moved.select("node", "root")
        if moved.where("__moved").isEmpty():
            return state.select(F.col("node").alias(node), "root")
