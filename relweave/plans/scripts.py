"""SQL scripts, run as they are by Spark."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def run(spark: SparkSession, text: str, name: str = "") -> DataFrame:
    """script, success, error, time_taken_ns of a script run as one compound statement, up to the first statement that fails.

    Statements end with semicolons; after the last one it may be left out. Names
    of variables are the script's own, temporary views stay in the session.
    """
    began, error = time.time(), None
    body = text.strip()
    if body:
        try:
            spark.sql(f"BEGIN\n{body}{'' if body.endswith(';') else ';'}\nEND").collect()
        except PySparkException as e:
            error = str(e)
    return spark.createDataFrame([(name, error is None, error, int((time.time() - began) * 1e9))], "script string, success boolean, error string, time_taken_ns bigint")


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """run() of a script file anywhere that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()
    return run(spark, text[0] if text else "", path.rstrip("/").rpartition("/")[2])
