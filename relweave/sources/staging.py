"""Staged results: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the session or the context has it.

    Where that is unset a local session, which is one machine, gets a temporary
    folder; anywhere else it is an error, since no other machine has that folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "relweave-checkpoints"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage of df with Parquet files in the shared folder: a lost executor costs no recomputation before this point."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
