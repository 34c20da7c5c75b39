"""What the operators of this subpackage share: tables, staged results, row identity, bounded slices of batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.sources.staging import shared_dir

#: White space of the word definition `[^\x20\x09-\x0D]+`.
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task works on at once; a longer text is worked on alone.
PIECE = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """This subpackage's own folder in the one that driver and executors share."""
    return f"{shared_dir(spark)}/llm"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back.

    Cuts the lineage: a lost executor costs no recomputation before this point,
    and values that a re-run task might draw anew (row ids) are fixed once.
    What is staged stays until release() or the end of whoever owns the folder.
    """
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this subpackage staged in this application, and nothing else: call it when no result that reads it is in use any more."""
    delete(spark, folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder and what is in it; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes in a binary column, so that what a task makes of them is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        cuts = np.flatnonzero(np.diff(total // size, prepend=0))
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def in_small_batches(spark: SparkSession) -> None:
    """Has Spark hand 4 MB of rows to Python at once where the session keeps the default, which is 64 MB a task on either side."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) == "67108864b":
        spark.conf.set(setting, "4m")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose row_key() isn't among keys(key)."""
    name = fresh(docs, "key")
    return docs.withColumn(name, row_key()).join(keys.select(F.col("key").alias(name)), name, "left_anti").drop(name)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a row: 128 bits over id and text, so that rows sharing an id but not a text stay apart.

    Rows with the same id and the same text are one document to the operators
    that use this key; each of them gets that document's result. A null id and a
    null text are like no other; the id's length goes before it, so that no
    id runs into a text.
    """
    body = F.col(id_col).cast("string")
    parts = [F.coalesce(F.length(body).cast("string"), F.lit("-")), F.coalesce(body, F.lit("")), F.when(F.col(text_col).isNull(), "-").otherwise("+"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    return F.unhex(F.md5(F.concat_ws(":", *parts).cast("binary")))


def bind(value: Column, body) -> Column:
    """Evaluates `value` once and hands it to `body` as a variable, so that lambdas inside don't recompute it."""
    return F.transform(F.array(value), body).getItem(0)


def col(name: str) -> Column:
    """The column of that very name, dots, blanks and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept(fields: list[T.StructField]) -> list[Column]:
    """Columns under names of ours, kept0 and on: Spark hands a column to Python by a name without dots, and none of them clashes with an operator's own."""
    return [col(f.name).alias(f"kept{i}") for i, f in enumerate(fields)]
