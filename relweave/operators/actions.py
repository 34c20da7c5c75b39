"""Referential actions: what deletes and key changes do to the rows that reference the rows they touch.

A delete is closed over the foreign keys that cascade, cycles included; the
others then set null or a default, or name the rows that forbid it. Only the
referenced keys of touched rows are staged. A table that no key refers to is
changed by joins with its parents' keys and never staged itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.catalog import CASCADE, NO_ACTION, PRIMARY_KEY, RESTRICT, SET_DEFAULT, SET_NULL, Catalog, ForeignKey
from relweave.operators import integrity, subset
from relweave.sources.staging import staged

Tables = Mapping[str, DataFrame]


@dataclass
class Outcome:
    """tables: the contents of all tables afterwards. blocked: table, constraint, rule, row (the row's key as JSON); with a row in it the change must not be made."""

    tables: dict[str, DataFrame]
    blocked: DataFrame


def _key(catalog: Catalog, name: str) -> list[str]:
    return catalog.table(name).primary_key or catalog.table(name).stored_columns()


def _blocked(catalog: Catalog, name: str, constraint: str, rule: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(name).alias("table"), F.lit(constraint).alias("constraint"), F.lit(rule).alias("rule"), F.to_json(F.struct(*_key(catalog, name)), {"ignoreNullFields": "false"}).alias("row"))


def _all_blocked(tables: Tables, found: list[DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    empty = spark.createDataFrame([], "table string, constraint string, rule string, row string")
    return reduce(DataFrame.unionByName, found, empty)


def _renamed(keys: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    return keys.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])


def _without(df: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """Rows whose columns aren't among keys, in which nulls equal each other."""
    there = _renamed(keys, columns, [f"_gone_{c}" for c in columns])
    return df.join(there, [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in columns], "left_anti")


def _mapped(df: DataFrame, columns: Sequence[str], moved: DataFrame) -> DataFrame:
    """df in which rows of old values have the new ones; moved: old_<column>, new_<column>, one row for each old value."""
    marked = moved.withColumn("_hit", F.lit(True))
    joined = df.join(marked, [F.col(c) == F.col(f"old_{c}") for c in columns], "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _default(catalog: Catalog, name: str, column: str, kind) -> Column:
    declared = next(c for c in catalog.table(name).columns if c.name == column).default
    return (F.expr(declared) if declared else F.lit(None)).cast(kind)


def _emptied(catalog: Catalog, k: ForeignKey, rule: str, keys: DataFrame, child: DataFrame) -> DataFrame:
    """old_<column>, new_<column> of the child's foreign key under SET NULL or SET DEFAULT, for parents' keys under the child's names."""
    kinds = dict(child.dtypes)
    new = {c: F.lit(None).cast(kinds[c]) if rule == SET_NULL else _default(catalog, k.child, c, kinds[c]) for c in k.columns}
    return keys.distinct().select(*[F.col(c).alias(f"old_{c}") for c in k.columns], *[new[c].alias(f"new_{c}") for c in k.columns])


def _required(catalog: Catalog, k: ForeignKey) -> bool:
    return any(c.not_null for c in catalog.table(k.child).columns if c.name in k.columns)


def delete(tables: Tables, catalog: Catalog, rows: Mapping[str, DataFrame]) -> Outcome:
    """The tables without `rows` (by table), after the delete rules of all foreign keys.

    CASCADE takes referencing rows along, whatever cycle they lie on. SET NULL
    and SET DEFAULT change those that stay; a default that no parent has, or a
    null where none may be, blocks. NO ACTION blocks if a row that stays would
    reference one that goes, RESTRICT also if the row itself would go along.
    Foreign keys with a null refer to nothing. Repeated rows share their fate.
    """
    fks = [k for k in catalog.foreign_keys() if k.child in tables and k.parent in tables]
    gone = subset.closure(tables, catalog, rows, down=True, follow=lambda k: k.delete_rule == CASCADE)
    referenced = {n: sorted({c for k in fks if k.parent == n for c in k.parent_columns}) for n in gone}
    keys = {n: staged(gone[n].select(*cs).distinct(), "gone") for n, cs in referenced.items() if cs}
    of = lambda k: _renamed(keys[k.parent], k.parent_columns, k.columns).dropna()
    out = dict(tables)
    for name in rows:
        columns, seeds = subset.identity(catalog, name, rows[name])
        out[name] = _without(out[name], columns, seeds)
    unseeded = dict(out)
    for k in fks:
        if k.delete_rule == CASCADE and k.parent in keys:
            out[k.child] = out[k.child].join(of(k), list(k.columns), "left_anti").select(tables[k.child].columns)
    found, defaults = [], []
    for k in fks:
        if k.parent not in keys or k.delete_rule == CASCADE:
            continue
        rule = k.delete_rule
        left = unseeded[k.child] if rule == RESTRICT else out[k.child]
        if rule in (RESTRICT, NO_ACTION) or (rule == SET_NULL and _required(catalog, k)):
            found.append(_blocked(catalog, k.child, k.name, rule, left.join(of(k), list(k.columns), "left_semi")))
            continue
        moved = _emptied(catalog, k, rule, of(k), tables[k.child])
        out[k.child] = _mapped(out[k.child], k.columns, moved)
        defaults += [k] if rule == SET_DEFAULT else []
        found += _carry(tables, catalog, fks, out, k.child, k.columns, moved)
    for k in defaults:
        found.append(_blocked(catalog, k.child, k.name, SET_DEFAULT, integrity.orphans(out[k.child], k.columns, out[k.parent], k.parent_columns)))
    return Outcome(out, _all_blocked(tables, found))


def _carry(tables: Tables, catalog: Catalog, fks: list[ForeignKey], out: dict[str, DataFrame], table: str, columns: Sequence[str], moved: DataFrame) -> list[DataFrame]:
    """Carries changed values of a table's columns on to what references them, by the update rules; changes `out`, returns what is blocked."""
    found, left, todo, seen = [], [], [(table, tuple(columns), moved)], {}
    while todo:
        name, columns, moved = todo.pop(0)
        for k in fks:
            if k.parent != name or not set(k.parent_columns) & set(columns):
                continue
            touched = moved.filter(" OR ".join(f"NOT (`old_{c}` <=> `new_{c}`)" for c in columns))
            if not set(k.parent_columns) <= set(columns):
                # Other columns of the key come from the rows themselves.
                kept = tables[name].select(*{*columns, *k.parent_columns})
                touched = kept.join(touched, [F.col(c) == F.col(f"old_{c}") for c in columns])
            value = lambda c, age: F.col(f"{age}_{c}") if c in columns else F.col(c)  # noqa: B023, E731
            pairs = [(p, c) for p, c in zip(k.parent_columns, k.columns, strict=True)]
            mine = touched.select(*[value(p, age).alias(f"{age}_{c}") for p, c in pairs for age in ("old", "new")]).dropna(subset=[f"old_{c}" for _, c in pairs]).distinct()
            keys = mine.select(*[F.col(f"old_{c}").alias(c) for _, c in pairs])
            if k.update_rule == RESTRICT or (k.update_rule == SET_NULL and _required(catalog, k)):
                found.append(_blocked(catalog, k.child, k.name, k.update_rule, tables[k.child].join(keys, list(k.columns), "left_semi")))
                continue
            if k.update_rule in (NO_ACTION, SET_DEFAULT):
                left.append(k)
            if k.update_rule == NO_ACTION:
                continue
            new = mine if k.update_rule == CASCADE else _emptied(catalog, k, k.update_rule, keys, tables[k.child])
            before = seen.get((k.child, k.columns))
            if before is not None:
                new = new.join(before, [f"old_{c}" for c in k.columns], "left_anti")
            new = staged(new, "moved")
            if new.isEmpty():
                continue
            seen[k.child, k.columns] = new if before is None else before.unionByName(new)
            # Old values are those of the original rows, so that a swap of two keys is no chain.
            out[k.child] = _mapped(out[k.child], k.columns, new)
            todo.append((k.child, k.columns, new))
    for k in dict.fromkeys(left):
        found.append(_blocked(catalog, k.child, k.name, k.update_rule, integrity.orphans(out[k.child], k.columns, out[k.parent], k.parent_columns)))
    return found


def update_key(tables: Tables, catalog: Catalog, table: str, moved: DataFrame) -> Outcome:
    """The tables after rows of `table` change their key, and the update rules of all foreign keys that lead to it.

    moved: old_<column> and new_<column> of some columns, at most one new value
    for an old one (else ValueError); null old values change nothing. All change
    at once, so keys may be swapped. CASCADE carries the new value on, further
    than one table if need be, SET NULL and SET DEFAULT empty the references,
    RESTRICT blocks if there is one, NO ACTION and SET DEFAULT if one refers to
    nothing in the end. A primary key that comes to stand twice is blocked as well.
    """
    columns = [c.removeprefix("old_") for c in moved.columns if c.startswith("old_")]
    changes = staged(moved.select(*[f"old_{c}" for c in columns], *[f"new_{c}" for c in columns]).dropna(subset=[f"old_{c}" for c in columns]).distinct(), "moved")
    if not integrity.duplicates(changes, [f"old_{c}" for c in columns]).isEmpty():
        raise ValueError(f"{table}: one old value has several new ones")
    fks = [k for k in catalog.foreign_keys() if k.child in tables and k.parent in tables]
    out = dict(tables)
    out[table] = _mapped(out[table], columns, changes)
    found = _carry(tables, catalog, fks, out, table, columns, changes)
    if key := catalog.table(table).primary_key:
        twice = integrity.duplicates(out[table], key)
        found.append(_blocked(catalog, table, catalog.table(table).of(PRIMARY_KEY)[0].name, PRIMARY_KEY, twice))
    return Outcome(out, _all_blocked(tables, found))
