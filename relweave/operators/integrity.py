"""Integrity checks: every function returns the violations, as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.catalog import CHECK, EXCLUDE, FOREIGN_KEY, PRIMARY_KEY, UNIQUE, Catalog
from relweave.functions.collation import collated
from relweave.operators import exclusion


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that stand on several rows, with n_rows. Keys with a null are unlike any other."""
    return df.dropna(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows whose key no parent has; a key with a null refers to nothing."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns, strict=True)])
    return child.dropna(subset=list(columns)).join(keys, list(columns), "left_anti").select(child.columns)


def nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_rows of the columns that have nulls, in one pass."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_rows bigint")
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n_rows").filter("n_rows > 0")


def check_failures(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which the predicate is false; unknown passes."""
    return df.filter(~F.expr(predicate))


def _row_rules(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """constraint, kind, n_rows of rules (name, kind, condition that a row breaks), in one pass over df."""
    counts = df.agg(*[F.count(F.when(broken, 1)).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)])
    named = F.array(*[F.struct(F.lit(name).alias("constraint"), F.lit(kind).alias("kind"), F.col(f"r{i}").alias("n_rows")) for i, (name, kind, _) in enumerate(rules)])
    return counts.select(F.explode(named).alias("x")).select("x.*")


def _key_rules(tables: Mapping[str, DataFrame], columns: tuple[str, ...], parent: str, unique: list[tuple[str, str]], children: list[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """table, constraint, kind, n_rows of all rules about one key of a table: that it is unique, and that the children's references have it.

    Keys of parent and children are counted together, in one aggregate whose
    counts combine before the shuffle, so a key's copies and references meet
    without a join. A reference that has a null counts for nothing.
    """
    kinds = [tables[parent].schema[c].dataType for c in columns]
    names = [f"k{i}" for i in range(len(columns))]

    def side(df: DataFrame, own: Sequence[str], at: int) -> DataFrame:
        keys = df.select(*[F.col(c).cast(t).alias(n) for c, t, n in zip(own, kinds, names, strict=True)]).dropna()
        return keys.withColumn("at", F.lit(at))

    rows = reduce(DataFrame.unionByName, [side(tables[t], own, i + 1) for i, (t, _, own) in enumerate(children)], side(tables[parent], columns, 0))
    count = lambda i: F.count(F.when(F.col("at") == i, 1)).alias(f"n{i}")
    met = rows.groupBy(*names).agg(*[count(i) for i in range(len(children) + 1)])
    twice = F.sum(F.when(F.col("n0") > 1, F.col("n0")))
    sums = met.agg(*[F.coalesce(twice, F.lit(0)).alias("n0")] if unique else [], *[F.coalesce(F.sum(F.when(F.col("n0") == 0, F.col(f"n{i + 1}"))), F.lit(0)).alias(f"n{i + 1}") for i in range(len(children))])
    told = [(parent, name, kind, "n0") for name, kind in unique] + [(t, name, FOREIGN_KEY, f"n{i + 1}") for i, (t, name, _) in enumerate(children)]
    found = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(name).alias("constraint"), F.lit(kind).alias("kind"), F.col(n).alias("n_rows")) for t, name, kind, n in told])
    return sums.select(F.explode(found).alias("x")).select("x.*")


def validate(tables: Mapping[str, DataFrame], catalog: Catalog) -> DataFrame:
    """table, constraint, kind, n_rows for every declared rule that some rows break.

    A table's checks and required columns are counted in one pass over it. A
    key's uniqueness and all references to it are one aggregate (see _key_rules).
    Keys compare by the collations of their columns, references by their parents'.
    """
    found = []
    tables = {t.name: collated(tables[t.name], t) for t in catalog.tables if t.name in tables and not t.ignore}
    note = lambda df, t, name, kind: df.select(F.lit(t).alias("table"), F.lit(name).alias("constraint"), F.lit(kind).alias("kind"), F.col("n_rows"))
    keys: dict[tuple[str, tuple[str, ...]], tuple[list, list]] = {}
    of = lambda table, columns: keys.setdefault((table, tuple(columns)), ([], []))
    for t in catalog.tables:
        if t.ignore or t.name not in tables:
            continue
        df, rules = tables[t.name], []
        for c in t.constraints:
            if c.ignore:
                continue
            if c.kind in (PRIMARY_KEY, UNIQUE):
                of(t.name, c.columns)[0].append((c.name, c.kind))
            elif c.kind == FOREIGN_KEY and c.references_table in tables:
                of(c.references_table, c.references_columns)[1].append((t.name, c.name, c.columns))
            elif c.kind == EXCLUDE:
                found.append(note(exclusion.violations(df, c).agg(F.count("*").alias("n_rows")), t.name, c.name, c.kind))
            elif c.kind == CHECK:
                rules.append((c.name, c.kind, ~F.expr(c.check)))
        rules += [(f"{t.name}_{c.name}_not_null", "NOT NULL", F.col(c.name).isNull()) for c in t.columns if c.not_null and not c.ignore]
        if rules:
            found.append(_row_rules(df, rules).select(F.lit(t.name).alias("table"), "constraint", "kind", "n_rows"))
    found += [_key_rules(tables, columns, table, unique, children) for (table, columns), (unique, children) in keys.items()]
    spark = next(iter(tables.values())).sparkSession
    empty = spark.createDataFrame([], "table string, constraint string, kind string, n_rows bigint")
    return reduce(DataFrame.unionByName, found, empty).filter("n_rows > 0")
