"""Helpers that several corpus operators use: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallygrid.functions.folders import shared_folder

#: ASCII white space, as the contracts of the corpus operators define it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers that run beside the driver import this package; elsewhere it is installed or shipped with --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (:func:`tallygrid.functions.folders.shared_folder`)."""
    reach_workers(spark)
    return shared_folder(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, name)  # a new name each time: what a lost run left behind is never read
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text"):
    """A tie-breaker that keeps long texts out of sort keys."""
    return F.xxhash64(F.col(text))
