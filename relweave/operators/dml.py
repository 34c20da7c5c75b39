"""Inserts, updates and deletes as DataFrame -> DataFrame: the new contents of the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions.collation import blind
from relweave.operators.bands import numbered
from relweave.sources.staging import staged


def latest(source: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the last in `order`, or any of equal rows' kind where no order is given.

    An aggregate, so copies of a key combine before the shuffle. Rows with a
    null in the key are dropped: nothing can match them. A key whose collation
    takes several spellings for one has that of the row that is kept.
    """
    spelt = any(blind(source.schema[k].dataType) for k in keys)
    rest = source.columns if spelt else [c for c in source.columns if c not in keys]
    whole = source.dropna(subset=list(keys))
    if not rest:
        return whole.distinct()
    row = F.struct(*rest)
    picked = F.max_by(row, F.struct(F.col(order), row)) if order else F.max(row)
    return whole.groupBy(*keys).agg(picked.alias("_row")).select(*([] if spelt else keys), "_row.*").select(source.columns)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of source replace target rows of the same key and join the others.

    The last row of a key in `order` wins; `order` itself is no column of the
    target. Columns that source lacks keep their old value, and are null in new
    rows. A target row without a match stays as it is, null keys included.
    """
    sent = [c for c in source.columns if c != order or c in target.columns]
    new = latest(source, keys, order).select(sent)
    extra = [c for c in sent if c not in target.columns]
    if extra:
        raise ValueError(f"the target has no columns {extra}")
    values = [c for c in sent if c not in keys]
    if not values:
        return insert_if_absent(target, new, keys)
    if set(target.columns) == set(sent):
        return target.join(new, list(keys), "left_anti").select(target.columns).unionByName(new)
    named = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_sent"))
    both = target.withColumn("_had", F.lit(True)).join(named, list(keys), "full")
    hit = F.col("_sent").isNotNull()
    return both.select(*[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def insert_if_absent(target: DataFrame, source: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """target and those rows of source whose key it doesn't have."""
    new = latest(source, keys, order).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(new.select([c for c in source.columns if c in target.columns]), allowMissingColumns=True)


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched rows take source's other columns; nothing is inserted."""
    return upsert(target, source.join(target.select(*keys).distinct(), list(keys), "left_semi"), keys)


def delete_in(target: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Without rows whose column is one of the values; nulls stay."""
    return target.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def rename_key(target: DataFrame, column: str, old, new) -> DataFrame:
    """Rows of one key value take another. Fails if the new one is taken."""
    if target.filter(F.col(column) == new).limit(1).count():
        raise ValueError(f"{column} {new!r} is taken")
    return target.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def copy_common(source: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """The columns that both sides have, in the target's order: what a table rebuilt under a new schema starts from."""
    return source.select([c for c in target_columns if c in source.columns])


def next_identity(target: DataFrame, column: str) -> int:
    """The value after the greatest in use; 1 for an empty table."""
    return (target.agg(F.max(column)).first()[0] or 0) + 1


def with_identity(target: DataFrame, rows: DataFrame, column: str, order: Sequence[str | Column]) -> DataFrame:
    """rows in which those without a number get the ones after the greatest of target and of rows, gapless, in an order.

    Numbers come from counts of bands and their running sums, so no task holds
    more than its band. The same rows get the same numbers on every run; equal
    rows are interchangeable.
    """
    last = max(next_identity(target, column), next_identity(rows, column)) - 1
    new = numbered(rows.filter(F.col(column).isNull()), order, "_number")
    kind = target.schema[column].dataType
    filled = new.withColumn(column, (F.col("_number") + last).cast(kind)).select(rows.columns)
    return rows.filter(F.col(column).isNotNull()).withColumn(column, F.col(column).cast(kind)).unionByName(filled)


def upsert_any_key(target: DataFrame, source: DataFrame, keys: Sequence[Sequence[str]], order: Sequence[str | Column]) -> DataFrame:
    """target after inserting source's rows one at a time in an order, each updating the row it collides with under one of several unique keys.

    A row that shares the value of a key with a row that is there updates that
    row's columns outside all keys; if it shares values of several keys, the
    first of `keys` decides. Otherwise it is inserted, and later rows meet it.
    Keys of rows never change. A key with a null collides with nothing. Columns
    that source lacks stay, and are null in new rows; rows alike in `order` go
    by a hash of their columns, equal rows being interchangeable.

    Which rows are inserted is settled in rounds, on keys alone: a row that is
    the earliest under all its keys is, and rows that share a key with it aren't.
    A round settles at least the earliest row of every group that keys connect,
    so rounds are as many as the longest chain of ever earlier collisions.
    """
    keys = [list(k) for k in keys]
    every = list(dict.fromkeys(c for k in keys for c in k))
    values = [c for c in source.columns if c in target.columns and c not in every]
    sent = staged(numbered(source, order, "_at").select("_at", *every, *values), "sent")
    slim = sent.select("_at", *every)
    held = None
    for k in keys:
        hit = slim.join(target.select(*k), k, "left_semi").select("_at")
        held = hit if held is None else held.unionByName(hit)
    left = staged(slim.join(held.distinct(), "_at", "left_anti"), "open")
    inserted = left.select("_at").limit(0)
    while not left.isEmpty():
        won = left
        for i, k in enumerate(keys):
            first = left.dropna(subset=k).groupBy(*k).agg(F.min("_at").alias(f"_first{i}"))
            won = won.join(first, k, "left")
        won = staged(won.filter(" AND ".join(f"coalesce(_at = _first{i}, true)" for i in range(len(keys)))).select("_at", *every), "won")
        inserted = inserted.unionByName(won.select("_at"))
        left = left.join(won.select("_at"), "_at", "left_anti")
        for k in keys:
            left = left.join(won.select(*k), k, "left_anti")
        left = staged(left.select("_at", *every), "open")
    fresh = sent.join(inserted, "_at", "left_semi")
    there = target.withColumn("_at", F.lit(0).cast("bigint")).unionByName(fresh, allowMissingColumns=True)
    todo = sent.join(inserted, "_at", "left_anti")
    if not values:
        return there.select(target.columns)
    hits = []
    for k in keys:
        owner = there.select(*k, F.col("_at").alias("_since")).dropna()
        mine = todo.join(owner, k).filter("_since < _at")
        hits.append(mine.groupBy(*k).agg(F.max_by(F.struct("_at", *values), "_at").alias("_new")))
        todo = todo.join(mine.select("_at"), "_at", "left_anti")
    out, news = there, []
    for i, (k, hit) in enumerate(zip(keys, hits, strict=True)):
        out = out.join(hit.withColumnRenamed("_new", f"_new{i}"), k, "left")
        news.append(F.col(f"_new{i}"))
    last = F.greatest(*[n["_at"] for n in news]) if len(news) > 1 else news[0]["_at"]
    picked = news[0] if len(news) == 1 else F.coalesce(*[F.when(n["_at"] == last, n) for n in news])
    out = out.withColumn("_pick", picked)
    return out.select(*[F.when(F.col("_pick").isNotNull(), F.col(f"_pick.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])
