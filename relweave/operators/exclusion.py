"""Exclusion constraints: no two rows of equal keys may have spans that overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.catalog import Constraint
from relweave.operators.bands import UPTO, banded


def _lower(known: Column, at: Column) -> Column:
    """Lower bounds in order: unbounded ones first."""
    return F.struct(known.alias("known"), F.when(known, at).alias("at"))


def _upper(open_: Column, at: Column) -> Column:
    """Upper bounds in order: unbounded ones last."""
    return F.struct(open_.alias("open"), F.when(~open_, at).alias("at"))


def overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, closed: bool = False, predicate: str | None = None) -> DataFrame:
    """Rows whose span overlaps that of another row with the same keys, with overlaps_earlier and overlaps_later.

    A span is [start, end), with `closed` [start, end]; a null bound is
    unbounded. Empty spans and those that end before they start overlap nothing,
    rows with a null in a key conflict with none, and with a predicate only rows
    that meet it count. Spans go by start, then end; equal rows overlap.

    A sweep: a row overlaps an earlier one if the greatest end before it lies
    past its start, a later one if the next start lies before its end. Keys and
    starts are dealt out in bands, which hand their greatest end and their first
    start on, so a key that has a third of all rows is swept by many tasks, and
    no pair of rows is ever made.
    """
    a, b = F.col(start), F.col(end)
    rows = df.filter(predicate) if predicate else df
    rows = rows.dropna(subset=list(keys)) if keys else rows
    rows = rows.filter(a.isNull() | b.isNull() | (a <= b if closed else a < b))
    held = banded(rows.withColumn("_lo", _lower(a.isNotNull(), a)).withColumn("_hi", _upper(b.isNull(), b)), [*keys, "_lo", "_hi"], "spans")
    along = Window.partitionBy("_band", *keys).orderBy("_lo", "_hi", "_tie", "_row")
    swept = held.withColumn("_seen", F.max("_hi").over(along.rowsBetween(*UPTO))).withColumn("_next", F.lead("_lo").over(along))
    bands = held.groupBy("_band", *keys).agg(F.min(start).alias("_first"), F.bool_and(a.isNotNull()).alias("_bounded"), F.max(end).alias("_last"), F.bool_or(b.isNull()).alias("_open"))
    bands = bands.select("_band", *keys, _lower(F.col("_bounded"), F.col("_first")).alias("_first"), _upper(F.col("_open"), F.col("_last")).alias("_last"))
    by_key = Window.partitionBy(*keys).orderBy("_band")
    handed = bands.select("_band", *keys, F.max("_last").over(by_key.rowsBetween(*UPTO)).alias("_before"), F.lead("_first").over(by_key).alias("_after")).filter("_before IS NOT NULL OR _after IS NOT NULL")

    def meets(upper: str, lower: str) -> Column:
        hi, lo = F.col(f"{upper}.at"), F.col(f"{lower}.at")
        touch = F.col(f"{upper}.open") | ~F.col(f"{lower}.known") | (hi >= lo if closed else hi > lo)
        return F.coalesce(F.col(upper).isNotNull() & F.col(lower).isNotNull() & touch, F.lit(False))

    out = swept.join(handed, ["_band", *keys], "left")
    out = out.withColumn("overlaps_earlier", meets("_seen", "_lo") | meets("_before", "_lo")).withColumn("overlaps_later", meets("_hi", "_next") | meets("_hi", "_after"))
    return out.filter("overlaps_earlier OR overlaps_later").select(*df.columns, "overlaps_earlier", "overlaps_later")


def violations(df: DataFrame, rule: Constraint) -> DataFrame:
    """Rows that break an exclusion constraint.

    Its operators stand in the order of its columns: = for equal values, && for
    the start and the end of a span, of which there is one or none.
    """
    keys = [c for c, o in zip(rule.columns, rule.operators, strict=True) if o == "="]
    span = [c for c, o in zip(rule.columns, rule.operators, strict=True) if o == "&&"]
    if len(keys) + len(span) < len(rule.columns) or len(span) not in (0, 2):
        raise ValueError(f"{rule.name}: an exclusion has = and two columns of &&, not {rule.operators}")
    if span:
        return overlaps(df, keys, *span, predicate=rule.predicate or None).select(df.columns)
    rows = df.filter(rule.predicate) if rule.predicate else df
    several = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(several, keys, "left_semi").select(df.columns)
