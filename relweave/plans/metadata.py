"""The catalog as DataFrames, one row per object, so that questions about it are ordinary queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.catalog import FOREIGN_KEY, PRIMARY_KEY, Catalog, Column, Table

_DECLARED = """name string, tables array<struct<name: string, ignore: boolean, columns: array<struct<name: string, type: string, ignore: boolean>>,
    constraints: array<struct<kind: string, name: string, columns: array<string>, references_table: string, references_columns: array<string>, ignore: boolean>>,
    indexes: array<struct<name: string, columns: array<string>, ignore: boolean>>>>"""


def columns(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(t.name, i, c.name, c.type, c.not_null, c.default, c.identity, c.collation, c.generated, c.is_primary_key, c.is_unique, c.references) for t in catalog.tables if not t.ignore for i, c in enumerate(t.columns, 1) if not c.ignore]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, not_null boolean, default string, identity string, collation string, generated string, is_primary_key boolean, is_unique boolean, references string")


def constraints(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(t.name, c.name, c.kind, c.columns, c.references_table, c.references_columns, c.check, c.update_rule, c.delete_rule, c.deferrable) for t in catalog.tables if not t.ignore for c in t.constraints if not c.ignore]
    return spark.createDataFrame(rows, "table string, name string, kind string, columns array<string>, references_table string, references_columns array<string>, check string, update_rule string, delete_rule string, deferrable boolean")


def indexes(spark: SparkSession, catalog: Catalog) -> DataFrame:
    rows = [(t.name, x.name, x.unique, x.columns, x.include, x.predicate, x.kind) for t in catalog.tables if not t.ignore for x in t.indexes if not x.ignore]
    return spark.createDataFrame(rows, "table string, name string, unique boolean, columns array<string>, include array<string>, predicate string, kind string")


def views(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame([(v.name, v.materialized, v.columns, v.sql) for v in catalog.views or [] if not v.ignore], "view string, materialized boolean, columns array<string>, sql string")


def routines(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame([(r.name, r.kind, r.sql) for r in catalog.routines or [] if not r.ignore], "routine string, kind string, sql string")


def enums(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame([(e.name, e.labels) for e in catalog.enums or [] if not e.ignore], "enum string, labels array<string>")


def domains(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame([(d.name, d.type, d.not_null, d.default, d.checks) for d in catalog.domains or [] if not d.ignore], "domain string, type string, not_null boolean, default string, checks array<string>")


def triggers(spark: SparkSession, catalog: Catalog) -> DataFrame:
    return spark.createDataFrame([(t.table, t.name, t.sql) for t in catalog.triggers or [] if not t.ignore], "table string, trigger string, sql string")


def frame_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, position (from 1), column, type of DataFrames, by their schemas alone."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, i, f.name, f.dataType.simpleString().upper()) for name, df in tables.items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def server(spark: SparkSession) -> DataFrame:
    """version, catalog, database, zone: where the session's queries run."""
    return spark.range(1).select(F.version().alias("version"), F.current_catalog().alias("catalog"), F.current_database().alias("database"), F.current_timezone().alias("zone"))


def of_kinds(cons: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """The constraints of some kinds, a branch for each; without any kind, no row but the same columns."""
    out = cons.filter(F.lit(False))
    for kind in kinds:
        out = out.unionByName(cons.filter(F.col("kind") == kind))
    return out


def declared(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns, constraints and indexes as a catalog's JSON declares them, right or wrong, for problems()."""
    one = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", _DECLARED, {"mode": "FAILFAST"}).alias("c"))
    of = one.select(F.explode("c.tables").alias("x")).filter("NOT coalesce(x.ignore, false)")
    each = lambda part: of.select(F.col("x.name").alias("table"), F.explode(f"x.{part}").alias("o")).filter("NOT coalesce(o.ignore, false)")
    named = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(""))
    cols = each("columns").select("table", F.col("o.name").alias("column"), F.col("o.type").alias("type"))
    cons = each("constraints").select("table", named("name").alias("name"), "o.kind", "o.columns", named("references_table").alias("references_table"), F.coalesce("o.references_columns", F.array().cast("array<string>")).alias("references_columns"))
    return cols, cons, each("indexes").select("table", named("name").alias("name"), "o.columns")


def problems(cols: DataFrame, cons: DataFrame, idx: DataFrame) -> DataFrame:
    """table, object, problem: all that is wrong with declarations, not only the first fault.

    cols has table and column; cons table, name, kind, columns, references_table
    and references_columns; idx table, name and columns. Names may be empty.
    """
    known, tables = cols.select("table", "column").distinct(), cols.select(F.col("table").alias("references_table")).distinct()
    says = lambda df, name, problem: df.select("table", F.col(name).alias("object"), problem.alias("problem"))
    used = cons.select("table", "name", "columns").unionByName(idx.select("table", "name", "columns"))
    absent = used.select("table", "name", F.explode("columns").alias("column")).join(known, ["table", "column"], "left_anti")
    keys = cons.filter(F.col("kind") == FOREIGN_KEY)
    wide = keys.filter(F.size("columns") != F.size("references_columns"))
    lost = keys.join(tables, "references_table", "left_anti")
    targets = keys.select("table", "name", "references_table", F.explode("references_columns").alias("column")).join(tables, "references_table", "left_semi")
    beyond = targets.join(known.withColumnRenamed("table", "references_table"), ["references_table", "column"], "left_anti")
    twice = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    parts = [
        says(twice(cols, "table", "column"), "column", F.concat(F.lit("declared "), F.col("n").cast("string"), F.lit(" times"))),
        *(says(twice(of.filter("name <> ''"), "table", "name"), "name", F.concat(F.lit("declared "), F.col("n").cast("string"), F.lit(" times"))) for of in (cons, idx)),
        says(twice(cons.filter(F.col("kind") == PRIMARY_KEY), "table").withColumn("name", F.lit("")), "name", F.lit("several primary keys")),
        says(used.filter(F.size("columns") < 1), "name", F.lit("no columns")),
        says(absent, "name", F.concat(F.lit("unknown column "), "column")),
        says(wide, "name", F.lit("as many columns must be referenced as refer")),
        says(lost, "name", F.concat(F.lit("unknown table "), "references_table")),
        says(beyond, "name", F.concat(F.lit("unknown column "), "references_table", F.lit("."), "column")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("table", "object", "problem")


def constraint_columns(cons: DataFrame) -> DataFrame:
    """table, name, kind, position (from 1), column, references_table, references_column: a row per column of a constraint."""
    pairs = F.posexplode(F.arrays_zip("columns", "references_columns"))
    return cons.select("table", "name", "kind", "references_table", pairs.alias("p", "z")).select("table", "name", "kind", (F.col("p") + 1).alias("position"), F.col("z.columns").alias("column"), "references_table", F.col("z.references_columns").alias("references_column"))


def plain_indexes(found: DataFrame, cons: DataFrame) -> DataFrame:
    """Indexes that back no constraint."""
    return found.join(cons.select("table", "name"), ["table", "name"], "left_anti")


def selected(found: DataFrame, column: str, include=(), exclude=()) -> DataFrame:
    """Rows by name: those of `include` if any are given, else all but those of `exclude`."""
    if include:
        return found.filter(F.col(column).isin(list(include)))
    return found.filter(~F.col(column).isin(list(exclude))) if exclude else found


def introspect(spark: SparkSession, database: str | None = None, known: Catalog | None = None) -> Catalog:
    """Tables and columns of a Spark database; constraints, indexes and comments come from a known catalog of the same names."""
    tables = []
    for t in spark.catalog.listTables(database):
        if t.tableType == "VIEW" or t.isTemporary:
            continue
        fields = spark.table(f"`{database}`.`{t.name}`" if database else f"`{t.name}`").schema.fields
        cols = [Column(f.name, f.dataType.simpleString().upper(), not_null=not f.nullable) for f in fields]
        old = next((x for x in known.tables if x.name == t.name), None) if known else None
        tables.append(Table(t.name, cols, old.constraints if old else [], old.indexes if old else []))
    return Catalog(spark.catalog.currentCatalog(), tables)
