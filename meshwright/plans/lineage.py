"""Lineage cuts for loops, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Cut = Callable[[DataFrame, str], DataFrame]


class Tables:
    """``cut`` writes a reliable checkpoint into ``spark.checkpoint.dir``; only where that is unset and Spark
    runs in one process is a temporary folder used."""

    def __init__(self, spark: SparkSession):
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            root = spark.conf.get("spark.checkpoint.dir", "") or ""
            if not root:
                if not sc.master.startswith("local["):
                    raise ValueError("spark.checkpoint.dir is not set; on a cluster it names the shared folder")
                root = "file://" + tempfile.mkdtemp(prefix="meshwright-")
            sc.setCheckpointDir(root)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return df.checkpoint(eager=True)


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder of ``spark.checkpoint.dir``."""
    return Tables(df.sparkSession).cut(df, name)
