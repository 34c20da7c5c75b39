"""Migration history: which scripts have run, which are due, and running them.

History rows: filename, checksum, started_at, time_taken_ns, success.
Scripts below repeatable/ run again when their text changes.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.operators import dml

SCHEMA = "filename string, checksum string, started_at timestamp, time_taken_ns bigint, success boolean"
# Scripts of a dump, which are no migrations.
_NOT_MIGRATIONS = r"(\.undo\.sql|(^|/)(schema|indexes|constraints)\.sql)$"


def checksum(text: Column) -> Column:
    """SHA-256 in hex, the same for either kind of line end."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """filename, text of the migrations in a folder and in repeatable/ below it."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, r"((?:repeatable/.*)?[^/]*)$", 1)
    return files.select(F.when(path.contains("/repeatable/"), F.concat(F.lit("repeatable/"), F.regexp_extract(path, "/repeatable/(.*)$", 1))).otherwise(name).alias("filename"), F.col("value").alias("text")).filter(~F.col("filename").rlike(_NOT_MIGRATIONS))


def _order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("filename").startswith("repeatable/"), "filename")


def status(files: DataFrame, history: DataFrame) -> DataFrame:
    """filename, status (pending, failed, applied, missing) for scripts and history; repeatable ones come last."""
    seen = history.select("filename", F.col("checksum").alias("old"), "success", F.lit(True).alias("known"), F.col("started_at").isNotNull().alias("started"))
    both = files.select("filename", checksum(F.col("text")).alias("now"), F.lit(True).alias("there")).join(seen, "filename", "full")
    changed = F.col("filename").startswith("repeatable/") & ~F.col("now").eqNullSafe(F.col("old"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("known").isNull() | ~F.col("started"), "pending").when(~F.coalesce("success", F.lit(False)), "failed").when(changed, "pending").otherwise("applied")
    return _order(both.select("filename", state.alias("status")))


def pending(files: DataFrame, history: DataFrame) -> DataFrame:
    """filename, checksum of the scripts that a run would take, in its order: new, failed and changed repeatable ones."""
    seen = history.select("filename", F.col("checksum").alias("old"), "success")
    both = files.select("filename", checksum(F.col("text")).alias("checksum")).join(seen, "filename", "left")
    done = F.coalesce("success", F.lit(False))
    again = F.col("filename").startswith("repeatable/") & ~F.col("checksum").eqNullSafe(F.col("old"))
    return _order(both.filter(~done | again).select("filename", "checksum"))


def record(history: DataFrame, rows: DataFrame) -> DataFrame:
    """History with the rows' files replaced or added."""
    return dml.upsert(history, rows, ["filename"])


def touch(history: DataFrame, files: DataFrame) -> DataFrame:
    """History in which the files count as applied, without running them."""
    rows = files.select("filename", F.when(F.col("filename").startswith("repeatable/"), checksum(F.col("text"))).alias("checksum"), F.current_timestamp().alias("started_at"), F.lit(0).cast("bigint").alias("time_taken_ns"), F.lit(True).alias("success"))
    return record(history, rows)


def remove(history: DataFrame, names: list[str]) -> DataFrame:
    return dml.delete_in(history, "filename", names)


def move(history: DataFrame, old: str, new: str) -> DataFrame:
    return dml.rename_key(history, "filename", old, new)


def migrate(spark: SparkSession, files: DataFrame, history: DataFrame, run: Callable[[str], None], undo: Callable[[str], None] | None = None, attempts: int = 1, retry: tuple[type[Exception], ...] = (), delay: float = 1.0) -> tuple[DataFrame, Exception | None]:
    """Runs what is pending, one script at a time, until one fails; returns the new history and the failure.

    Scripts are few and small, so they come to the driver; what they do is
    theirs. Exceptions of `retry` are tried again up to `attempts` times, with
    doubling delays of 5 minutes at most. A script that fails for good is
    undone by `undo(filename)`, and recorded as failed.
    """
    texts = {r["filename"]: r["text"] for r in files.join(pending(files, history).select("filename"), "filename", "left_semi").collect()}
    rows, failure = [], None
    for p in pending(files, history).collect():
        began, failure = time.time(), None
        for turn in range(max(1, attempts)):
            try:
                run(texts[p["filename"]])
                failure = None
                break
            except Exception as e:  # whatever a script raises is recorded
                failure = e
                if not isinstance(e, retry):
                    break
                time.sleep(min(300.0, delay * 2**turn))
        if failure and undo:
            undo(p["filename"])
        repeatable = p["filename"].startswith("repeatable/")
        rows.append((p["filename"], p["checksum"] if repeatable else None, int(began * 1e6), int((time.time() - began) * 1e9), failure is None))
        if failure:
            break
    new = spark.createDataFrame(rows, "filename string, checksum string, at bigint, time_taken_ns bigint, success boolean")
    new = new.select("filename", "checksum", F.timestamp_micros("at").alias("started_at"), "time_taken_ns", "success")
    return record(history, new), failure
