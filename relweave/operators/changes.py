"""Row changes between two states of a table, and what follows from them: stamps, and views brought up to date."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"
Tables = Mapping[str, DataFrame]


def feed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, op (insert, update, delete), before and after (whole rows as structs, null where there was none) of the rows that differ.

    Keys are unique on either side; one with a null is like any other. Values
    are compared so that nulls equal each other, so a row that was written anew
    as it was isn't a change.
    """
    columns = before.columns
    old = before.select(*[F.col(k).alias(f"_old_{k}") for k in keys], F.struct(*columns).alias("before"))
    new = after.select(*[F.col(k).alias(f"_new_{k}") for k in keys], F.struct(*columns).alias("after"))
    both = old.join(new, [F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}")) for k in keys], "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    op = F.when(F.col("before").isNull(), INSERT).when(F.col("after").isNull(), DELETE).otherwise(UPDATE)
    return both.select(*[F.when(F.col("before").isNull(), F.col(f"_new_{k}")).otherwise(F.col(f"_old_{k}")).alias(k) for k in keys], op.alias("op"), "before", "after")


def gone(changes: DataFrame) -> DataFrame:
    """Old images: what a change takes away."""
    return changes.filter("before IS NOT NULL").select("before.*")


def come(changes: DataFrame) -> DataFrame:
    """New images: what a change brings."""
    return changes.filter("after IS NOT NULL").select("after.*")


def stamped(before: DataFrame, after: DataFrame, keys: Sequence[str], column: str, value: Column) -> DataFrame:
    """after in which rows that are new or differ from before (but for the column itself) have the value, as a trigger on every row would set it."""
    old = before.select(*[F.col(k).alias(f"_old_{k}") for k in keys], F.struct(*[c for c in before.columns if c != column]).alias("_before"))
    joined = after.join(old, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys], "left")
    same = F.col("_before").eqNullSafe(F.struct(*[c for c in before.columns if c != column]))
    kind = after.schema[column].dataType
    return joined.select(*[F.when(same, F.col(column)).otherwise(value.cast(kind)).alias(column) if c == column else F.col(c) for c in after.columns])


def view_changes(view: Callable[[Tables], DataFrame], before: Tables, changes: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of a view with n: how many more there are (or fewer, below 0) after changes of its tables.

    The view is made of joins, filters and columns, without aggregates,
    outer joins or DISTINCT, so it adds up: the change of a join is the join of the change.
    Tables change one after the other; the change of one meets those before it
    in their new state and those after it in their old one, so no pair of
    changed rows counts twice. A table that didn't change is read for what joins
    the changed rows, and one whose own changes are the only ones isn't read.
    """
    state, parts = dict(before), []
    for name, change in changes.items():
        minus, plus = gone(change), come(change)
        parts.append(view({**state, name: minus}).withColumn("n", F.lit(-1)))
        parts.append(view({**state, name: plus}).withColumn("n", F.lit(1)))
        state[name] = _applied(state[name], change)
    columns = parts[0].columns[:-1]
    return reduce(DataFrame.unionByName, parts).groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")


def _applied(table: DataFrame, change: DataFrame) -> DataFrame:
    keys = [c for c in change.columns if c not in ("op", "before", "after")]
    there = change.filter("before IS NOT NULL").select(*[F.col(k).alias(f"_gone_{k}") for k in keys])
    kept = table.join(there, [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys], "left_anti")
    return kept.unionByName(come(change))


def refreshed(stored: DataFrame, changed: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """The stored rows of a view with its changes (with n) applied.

    With a key, which no two rows of the view share, rows are met by it alone.
    Without one, equal rows are counted: what is left is as many of each as
    there are.
    """
    columns = stored.columns
    if key:
        return stored.join(changed.select(*key).distinct(), list(key), "left_anti").select(columns).unionByName(changed.filter("n > 0").select(columns))
    # Only rows that change are counted; nulls equal each other, as they do in a grouping.
    touched = changed.select(*[F.col(c).alias(f"_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    counted = stored.join(touched, same, "left_semi").groupBy(*columns).agg(F.count("*").alias("n"))
    total = counted.unionByName(changed.select(*columns, "n")).groupBy(*columns).agg(F.sum("n").alias("n"))
    again = total.filter("n > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")
    return stored.join(touched, same, "left_anti").unionByName(again)
