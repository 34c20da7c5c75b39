"""What changes one catalog into another: joins of their metadata, as ordered steps with warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.catalog import Catalog
from relweave.functions import types
from relweave.plans import metadata

# The order in which kinds of steps are safe to run.
ORDER = {"drop view": 0, "drop constraint": 1, "drop index": 1, "drop table": 2, "create table": 3, "add column": 4, "alter column": 5, "drop column": 6, "add index": 7, "add constraint": 8, "create view": 9}
# Type pairs of which the second holds every value of the first; a limit on the second is looked at apart.
WIDER = (("VARCHAR", "TEXT"), ("CIDR", "INET"), ("TEXT", "VARCHAR"))


def warning(old: Column, new: Column) -> Column:
    """What values may suffer when a column of the normalised type `old` becomes `new`; null if nothing.

    A type is a name, a first number (a limit of length or of digits, none if
    0) and a second (digits after the point). Values suffer by another name
    that isn't a wider type's, by a lower limit, and by other digits after the point.
    """
    number = lambda side, arg: F.coalesce(side[arg].try_cast("int"), F.lit(0))
    room = {side: F.when(number(c, "arg1") > 0, number(c, "arg1")) for side, c in (("old", old), ("new", new))}
    unlimited = old["type"] == "TEXT"
    tighter = room["new"].isNotNull() & (unlimited | (room["new"] < room["old"]))
    texts = old["type"].isin("TEXT", "VARCHAR") & new["type"].isin("TEXT", "VARCHAR")
    points = (old["type"] == "NUMERIC") & (number(new, "arg2") != 0) & (number(new, "arg2") != number(old, "arg2"))
    kept = (old["type"] == new["type"]) | reduce(Column.__or__, [(old["type"] == a) & (new["type"] == b) for a, b in WIDER])
    found = F.concat_ws(
        "; ",
        F.when(~kept, "values may not convert"),
        F.when(kept & points, "digits after the point are kept to another number"),
        F.when(kept & tighter & texts, "longer texts than the new limit don't fit"),
        F.when(kept & tighter & ~texts, "longer numbers than the new limit don't fit"),
    )
    # Types of one name other than these two say nothing about their numbers' meaning.
    known = texts | old["type"].isin("NUMERIC", "CIDR") | (old["type"] != new["type"])
    return F.when(old == new, None).when(known, F.when(found != "", found)).otherwise("values may not convert")


def column_changes(old: DataFrame, new: DataFrame, dialect: str = "postgres") -> DataFrame:
    """table, column, change (add, drop, alter, same), reasons (what differs) and warning, for columns of metadata.columns.

    Types and defaults are compared in their normalised spelling; NOT NULL is
    not compared for columns of the new primary key, which implies it.
    """
    traits = ("type", "default", "not_null", "identity", "collation", "is_primary_key")
    side = lambda df, p: df.select("table", "column", *[F.col(c).alias(f"{p}_{c}") for c in traits], F.lit(True).alias(f"{p}_is"))
    both = side(old, "old").join(side(new, "new"), ["table", "column"], "full")
    shape = lambda p: types.normalize_type(F.col(f"{p}_type"), dialect)
    differs = [
        F.when(shape("old") != shape("new"), "type"),
        F.when(types.normalize_default(F.col("old_default"), dialect) != types.normalize_default(F.col("new_default"), dialect), "default"),
        F.when((F.col("old_not_null") != F.col("new_not_null")) & ~F.col("new_is_primary_key"), "not null"),
        F.when((F.col("old_identity") == "") != (F.col("new_identity") == ""), "identity"),
        F.when(F.col("old_collation") != F.col("new_collation"), "collation"),
    ]
    out = both.withColumn("reasons", F.concat_ws(",", *differs))
    change = F.when(F.col("old_is").isNull(), "add").when(F.col("new_is").isNull(), "drop").when(F.col("reasons") != "", "alter").otherwise("same")
    required = F.col("new_not_null") & (F.col("new_default") == "") & (F.col("new_identity") == "")
    strict = F.when(F.col("new_not_null") & ~F.col("old_not_null") & ~F.col("new_is_primary_key"), "setting NOT NULL fails on rows that have none")
    altered = F.concat_ws("; ", warning(shape("old"), shape("new")), strict)
    caution = (
        F.when(change == "add", F.when(required, "adding NOT NULL without a default fails on rows that exist"))
        .when(change == "alter", F.when(altered != "", altered))
        .when(change == "drop", "dropping a column loses its values")
    )
    return out.select("table", "column", change.alias("change"), F.when(change == "alter", F.col("reasons")).otherwise(F.lit("")).alias("reasons"), caution.alias("warning"))


def _changes(old: DataFrame, new: DataFrame, on: list[str], shape: Column) -> DataFrame:
    """The columns `on`, and change (add, drop, replace, same) by whether the shapes agree."""
    o, n = old.select(*on, shape.alias("o")), new.select(*on, shape.alias("n"))
    change = F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "drop").when(F.col("o") != F.col("n"), "replace").otherwise("same")
    return o.join(n, on, "full").select(*on, change.alias("change"))


def constraint_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """table, name, change: constraints are the same if their kind, columns, references, rules, check and deferral are. No rule is NO ACTION."""
    rule = lambda c: F.when(F.col(c).isin("", "NO ACTION"), "").otherwise(F.upper(c))
    plain = F.regexp_replace(F.trim("check"), r"\s+", " ")
    return _changes(old, new, ["table", "name"], F.struct("kind", "columns", "references_table", "references_columns", plain, rule("update_rule"), rule("delete_rule"), "deferrable"))


def index_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """table, name, change: indexes are the same if their kind, uniqueness, columns, included columns and predicate are."""
    kind = F.when(F.col("kind") == "", "BTREE").otherwise(F.upper("kind"))
    return _changes(old, new, ["table", "name"], F.struct(kind, "unique", "columns", "include", F.regexp_replace(F.trim("predicate"), r"\s+", " ")))


def view_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """view, change: views are the same if their text, but for white space, and their kind are."""
    return _changes(old, new, ["view"], F.struct("materialized", F.regexp_replace(F.trim("sql"), r"\s+", " ")))


def wipe(spark: SparkSession, catalog: Catalog) -> DataFrame:
    """position, step, table, object: what empties a database of the catalog: views, routines, foreign keys, tables, enums and domains, in an order in which nothing still in use is dropped."""
    key = metadata.constraints(spark, catalog).filter(F.col("kind") == "FOREIGN KEY")
    one = lambda df, position, step, name: df.select(F.lit(position).alias("position"), F.lit(step).alias("step"), F.lit("").alias("table"), F.col(name).alias("object"))
    tables = metadata.columns(spark, catalog).select("table").distinct()
    parts = [
        one(metadata.views(spark, catalog), 1, "drop view", "view"),
        one(metadata.routines(spark, catalog), 2, "drop routine", "routine"),
        key.select(F.lit(3).alias("position"), F.lit("drop constraint").alias("step"), "table", F.col("name").alias("object")),
        tables.select(F.lit(4).alias("position"), F.lit("drop table").alias("step"), "table", F.col("table").alias("object")),
        one(metadata.enums(spark, catalog), 5, "drop enum", "enum"),
        one(metadata.domains(spark, catalog), 6, "drop domain", "domain"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("position", "table", "object")


def steps(spark: SparkSession, old: Catalog, new: Catalog, drop_objects: bool = False, dialect: str = "postgres") -> DataFrame:
    """position, step, table, object, warning: the changes in an order that is safe to run; drops only where asked for."""
    oc, nc = metadata.columns(spark, old), metadata.columns(spark, new)
    changes = column_changes(oc, nc, dialect)
    ot, nt = oc.select("table").distinct(), nc.select("table").distinct()
    made, gone = nt.join(ot, "table", "left_anti"), ot.join(nt, "table", "left_anti")
    kept = changes.join(ot.join(nt, "table"), "table", "left_semi").filter("change <> 'same'")
    cons = constraint_changes(metadata.constraints(spark, old), metadata.constraints(spark, new)).join(gone, "table", "left_anti")
    own = lambda c: metadata.plain_indexes(metadata.indexes(spark, c), metadata.constraints(spark, c))
    idx = index_changes(own(old), own(new)).join(gone, "table", "left_anti")
    seen = view_changes(metadata.views(spark, old), metadata.views(spark, new))
    row = lambda df, step, table, name, note: df.select(step.alias("step"), table.alias("table"), name.alias("object"), note.cast("string").alias("warning"))
    none = F.lit(None)
    parts = [
        row(made, F.lit("create table"), F.col("table"), F.col("table"), none),
        row(gone, F.lit("drop table"), F.col("table"), F.col("table"), F.lit("dropping a table loses its rows")),
        row(kept, F.concat("change", F.lit(" column")), F.col("table"), F.col("column"), F.col("warning")),
        row(cons.filter("change IN ('drop', 'replace')"), F.lit("drop constraint"), F.col("table"), F.col("name"), none),
        row(cons.filter("change IN ('add', 'replace')"), F.lit("add constraint"), F.col("table"), F.col("name"), none),
        row(idx.filter("change IN ('drop', 'replace')"), F.lit("drop index"), F.col("table"), F.col("name"), none),
        row(idx.filter("change IN ('add', 'replace')"), F.lit("add index"), F.col("table"), F.col("name"), none),
        row(seen.filter("change IN ('drop', 'replace')"), F.lit("drop view"), F.lit(""), F.col("view"), none),
        row(seen.filter("change IN ('add', 'replace')"), F.lit("create view"), F.lit(""), F.col("view"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    replaced = cons.unionByName(idx).filter("change = 'replace'").select("table", F.col("name").alias("object")).unionByName(seen.filter("change = 'replace'").select(F.lit("").alias("table"), F.col("view").alias("object")))
    if not drop_objects:
        drops = out.filter("step LIKE 'drop %'").join(replaced, ["table", "object"], "left_semi").select(out.columns)
        out = out.filter("step NOT LIKE 'drop %'").unionByName(drops)
    order = F.element_at(F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair]), F.col("step"))
    return out.withColumn("position", order).select("position", "step", "table", "object", "warning").orderBy("position", "table", "object")


def rebuilt(df: DataFrame, table, dialect: str = "postgres") -> DataFrame:
    """A table's rows under its new declaration: common columns cast, new ones null or their literal default, dropped ones gone."""
    spark = df.sparkSession
    named = spark.createDataFrame([(i, c.type) for i, c in enumerate(table.columns)], "i int, t string").select("i", types.normalize_type(F.col("t"), dialect).alias("n")).collect()
    kinds = {r["i"]: types.spark_type(*r["n"]) for r in named}
    return df.select(*[(F.col(c.name) if c.name in df.columns else F.expr(c.default) if c.default else F.lit(None)).cast(kinds[i]).alias(c.name) for i, c in enumerate(table.columns)])
