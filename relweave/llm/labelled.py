"""Bounded samples of labelled documents, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.common import staged


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, mod folds; a null id counts as an empty text."""
    return F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(folds)).cast("int")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int) -> DataFrame:
    """label (int) and body (binary) of at most per_class documents of each class, equal texts once.

    held_out is a condition over doc_id; its rows are never read. The sample is
    the per_class ids of least hash, so it is the same on every run. A document
    with contradicting label rows counts as 1; rows without a label or without
    an id are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    first = lambda k: known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    picked = first(0).unionByName(first(1))
    # At most 2 * per_class rows of an id and a label: a bounded broadcast.
    body = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    found = body.join(F.broadcast(picked), "doc_id").dropDuplicates(["label", "body"])
    return staged(found.select("label", "body"), "sample")


def class_sizes(labels: DataFrame, label: str, held_out: Column) -> tuple[int, int]:
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out)
    counts = {int(r[0]): r[1] for r in known.groupBy(label).count().collect() if int(r[0]) in (0, 1)}
    return counts.get(0, 0), counts.get(1, 0)
