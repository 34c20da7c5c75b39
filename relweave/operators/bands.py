"""Bands: rows dealt out in an order, so that work along the order is shared by tasks whatever key a row has.

A band is a range of the order. What a band has to know of the others (how many
rows come before, the greatest end so far) is one row a band, and comes by a
window over those rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.sources.staging import staged

UPTO = (Window.unboundedPreceding, -1)


def banded(df: DataFrame, order: Sequence[str | Column], label: str = "bands") -> DataFrame:
    """df with _band (int, ascending in order) and _row (of its own, which tells ties apart), in as many bands as the session has shuffle partitions.

    Rows alike in `order` go by a hash of all their columns, so equal keys fill
    several bands, and a rerun deals out the same. The result is staged, which
    fixes the bands: a lost task can't deal its rows anew.
    """
    spark = df.sparkSession
    told = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).withColumn("_row", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return staged(told.repartitionByRange(n, *order, "_tie", "_row").withColumn("_band", F.spark_partition_id()), label)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """df with gapless numbers from 1 in an order; rows alike in it go by a hash of their columns."""
    rows = banded(df, order)
    counts = rows.groupBy("_band").agg(F.count("*").alias("_n"))
    before = counts.select("_band", F.coalesce(F.sum("_n").over(Window.orderBy("_band").rowsBetween(*UPTO)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_band").orderBy(*order, "_tie", "_row"))
    return rows.withColumn("_own", own).join(before, "_band").withColumn(name, F.col("_own") + F.col("_before")).drop("_band", "_row", "_tie", "_own", "_before")
