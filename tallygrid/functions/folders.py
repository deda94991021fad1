"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, made the folder of checkpoints too.

    Where the session leaves it unset, a temporary folder will do if driver and executors are one process (local tests); on a cluster
    executors would not see each other's files, so it is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")
