"""Tables as CSV folders, and other connectors.

A dump is a folder with catalog.json and, per table, a folder <table>.csv of
parts that executors write side by side. Values are encoded by functions.codec,
so a field's text tells null from empty.
"""

from __future__ import annotations

import csv
import functools
import io
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.catalog import Catalog, Table
from relweave.functions import codec, types
from relweave.operators import dml
from relweave.plans import scripts
from relweave.sources import splits

# A quote inside a quoted field that isn't doubled is a quote, if no separator follows it.
_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "unescapedQuoteHandling": "STOP_AT_CLOSING_QUOTE"}
_NAME = re.compile(r"^(?:\d+_)?(?:(?P<schema>[^./]+)\.)?(?P<table>[^./]+)\.csv$")


def table_name(file: str) -> tuple[str, str]:
    """Schema (maybe empty) and table of a file name [NN_][schema.]table.csv; the number orders loads only."""
    m = _NAME.match(file)
    if not m:
        raise ValueError(f"not a table's file name: {file!r}")
    return m["schema"] or "", m["table"]


def scan(df: DataFrame, table: Table) -> DataFrame:
    """The table's stored columns, in the order of its key if it has one."""
    rows = df.select(*table.stored_columns())
    return rows.orderBy(*table.primary_key) if table.primary_key else rows


def encoded(df: DataFrame, null: str = codec.NULL, prefix: str = codec.PREFIX) -> DataFrame:
    return df.select(*[codec.encode(F.col(f.name), f.dataType, null, prefix).alias(f.name) for f in df.schema])


def _written(width: int, null: str) -> dict:
    # An empty field alone on its line would make a blank line, which no reader takes for a row.
    return {"quote": '"', "escape": '"', "emptyValue": '""' if width == 1 else "", "nullValue": null, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, null: str = codec.NULL, prefix: str = codec.PREFIX, compression: str | None = None) -> None:
    options = {"header": True, **_written(len(df.columns), null)} | ({"compression": compression} if compression else {})
    encoded(df, null, prefix).write.mode("errorifexists").options(**options).csv(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        if part.num_rows:
            lines = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([pc.binary_join(lines, "\n")], ["value"])


def write_csv_file(df: DataFrame, path: str, null: str = codec.NULL, prefix: str = codec.PREFIX) -> None:
    """A folder with one CSV file, its rows in the data frame's order: many tasks make the text, in blocks of lines, and one task copies the blocks."""
    rows = encoded(df, null, prefix)
    text = F.to_csv(F.struct(*rows.columns), {k: str(v).lower() if isinstance(v, bool) else v for k, v in _written(len(df.columns), null).items()})
    blocks = rows.select(text.alias("value")).mapInArrow(_blocks, "value string").withColumn("at", F.monotonically_increasing_id())
    header = io.StringIO()
    csv.writer(header, lineterminator="").writerow(df.columns)
    whole = blocks.unionByName(df.sparkSession.createDataFrame([(header.getvalue(), -1)], "value string, at bigint"))
    whole.repartition(1).sortWithinPartitions("at").select("value").write.mode("errorifexists").option("lineSep", "\n").text(path)


def fields_of(table: Table, dialect: str = "postgres") -> list[tuple[str, T.DataType]]:
    """Names and Spark types of the stored columns."""
    kept = [c for c in table.columns if not c.generated and not c.ignore]
    spark = SparkSession.active()
    named = spark.createDataFrame([(i, c.type) for i, c in enumerate(kept)], "i int, t string").select("i", types.normalize_type(F.col("t"), dialect).alias("n")).collect()
    at = {r["i"]: types.spark_type(*r["n"]) for r in named}
    return [(c.name, at[i]) for i, c in enumerate(kept)]


def read_csv(spark: SparkSession, path: str, fields: Iterable[tuple[str, T.DataType]], null: str | None = codec.NULL, prefix: str | None = codec.PREFIX, epochs: bool = False, split: bool = False, place: str | None = None) -> DataFrame:
    """Rows of a CSV file or folder, typed by `fields`, never by inference.

    The header must be these fields in this order. Rows of another width fail
    the read. An empty field is an empty string, not a null. A file is one task;
    with split, files are cut into ranges, if quotes inside their fields are
    doubled (see splits). place: name of a further column that goes up along
    each file, file by file in the order of their names.
    """
    fields = list(fields)
    text = T.StructType([T.StructField(n, T.StringType()) for n, _ in fields])
    # An unlikely null text: what the reader takes for null by itself is an unquoted empty field.
    options = {**_CSV, "mode": "FAILFAST", "nullValue": "\x00"}
    if split:
        few, rest = splits.records(spark, path)
        first = (F.col("block") == 0) & (F.col("seq") == 0)
        wrong = [r["record"] for r in few.filter(first).select("record").distinct().limit(1000).collect() if next(csv.reader([r["record"].removeprefix("\ufeff")]), []) != text.names]
        if wrong:
            raise ValueError(f"{path}: the header is {wrong[0]!r}, the fields are {text.names}")
        parsed = F.from_csv("record", text.json(), {k: str(v) for k, v in options.items()})
        raw = few.filter(~first).unionByName(rest).select(parsed.alias("row"), F.struct("file", "block", "seq").alias("_place")).select(F.col("row.*"), "_place")
    else:
        raw = spark.read.options(**options, enforceSchema=False).schema(text).csv(path)
        raw = raw.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq")).alias("_place")) if place else raw
    values = [codec.decode(F.coalesce(F.col(n), F.lit("")), t, null, prefix, epochs).alias(n) for n, t in fields]
    return raw.select(*values, *([F.col("_place").alias(place)] if place else []))


def side_by_side(spark: SparkSession, jobs: Mapping[str, Callable[[], None]], width: int = 4) -> None:
    """Runs Spark jobs from `width` threads, each in the scheduler pool of its name; the first failure cancels the others and is raised."""
    sc, tag = spark.sparkContext, f"side-{uuid.uuid4().hex}"

    def run(name: str, job: Callable[[], None]) -> None:
        sc.addJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", name)
        job()

    with ThreadPoolExecutor(max(1, width)) as threads:
        due = [threads.submit(run, name, job) for name, job in jobs.items()]
        done, rest = wait(due, return_when=FIRST_EXCEPTION)
        failed = next((f.exception() for f in due if f in done and not f.cancelled() and f.exception()), None)
        if failed:
            for f in rest:
                f.cancel()
            sc.cancelJobsWithTag(tag)
    if failed:
        raise failed


def dump(tables: Mapping[str, DataFrame], catalog: Catalog, path: str, width: int = 4, **options) -> None:
    """Writes a folder with the catalog and every table of it that is given, `width` tables side by side.

    A table's rows go by its key, in parts whose names follow the key's order.
    """
    spark = next(iter(tables.values())).sparkSession
    jobs = {t.name: functools.partial(write_csv, scan(tables[t.name], t), f"{path}/{t.name}.csv", **options) for t in catalog.tables if t.name in tables and not t.ignore}
    side_by_side(spark, jobs, width)
    spark.createDataFrame([(catalog.to_json(),)], "value string").coalesce(1).write.option("lineSep", "\x00").text(f"{path}/catalog.json")


def load(spark: SparkSession, path: str, **options) -> tuple[Catalog, dict[str, DataFrame]]:
    """The catalog and tables of a dumped folder. Rows are taken as they were dumped, where a key stood once."""
    catalog = Catalog.from_json(spark.read.text(f"{path}/catalog.json", wholetext=True).first()[0].rstrip("\x00"))
    return catalog, {t.name: read_csv(spark, f"{path}/{t.name}.csv", fields_of(t), **options) for t in catalog.tables if not t.ignore}


def load_table(spark: SparkSession, paths: list[str], table: Table, **options) -> DataFrame:
    """A table's rows in files that come one after the other. Of rows with one key the last stays, as if each replaced the one before; rows with a null in the key all do."""
    read = [read_csv(spark, p, fields_of(table), place="_place", **options).withColumn("_place", F.struct(F.lit(i).alias("turn"), "_place")) for i, p in enumerate(paths)]
    rows = reduce(DataFrame.unionByName, read)
    if not table.primary_key:
        return rows.drop("_place")
    unknown = reduce(Column.__or__, [F.col(k).isNull() for k in table.primary_key])
    return dml.latest(rows, table.primary_key, "_place").drop("_place").unionByName(rows.filter(unknown).drop("_place"))


def load_folder(spark: SparkSession, folder: str, catalog: Catalog, **options) -> dict[str, DataFrame]:
    """Tables of the files or part folders [NN_][schema.]table.csv of a folder, typed by the catalog, in the order of their names.

    A table of several files has the rows of all; of rows with one key the last
    one's stay, in a file as among files. Other files are left alone; a table
    that the catalog doesn't have is an error, found before any file is read.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))
    found: dict[str, list[str]] = {}
    for n in names:
        if _NAME.match(n):
            found.setdefault(catalog.table(table_name(n)[1]).name, []).append(f"{folder}/{n}")
    return {name: load_table(spark, paths, catalog.table(name), **options) for name, paths in found.items()}


def load_any(spark: SparkSession, source: str, catalog: Catalog | None = None, **options) -> dict[str, DataFrame]:
    """What a path holds, by its name: one table (.csv), the outcome of a script that is run (.sql), or else the tables of a folder.

    A folder's own catalog.json serves where no catalog is given.
    """
    name = source.rstrip("/").rpartition("/")[2]
    if re.search(r"\.(zip|tgz|tar\.gz)$", name):
        raise ValueError(f"{name}: archives pass whole through one process; unpack it to a folder")
    if name.endswith(".sql"):
        return {name: scripts.run_file(spark, source)}
    if name.endswith(".csv"):
        if catalog is None:
            raise ValueError(f"{name}: a single table needs a catalog for its types")
        t = catalog.table(table_name(name)[1])
        return {t.name: load_table(spark, [source], t, **options)}
    return load_folder(spark, source, catalog, **options) if catalog else load(spark, source, **options)[1]


# How connection strings of the usual databases begin, and their JDBC subprotocols.
_SCHEMES = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "sqlserver": "sqlserver", "sqlite": "sqlite", "oracle": "oracle"}


def jdbc_url(dsn: str) -> tuple[str, str]:
    """Dialect and JDBC address of a connection string scheme://host/db; a plain path to *.db or *.sqlite is SQLite."""
    scheme, found, rest = dsn.partition("://")
    if not found:
        if re.search(r"\.(db|sqlite3?)$", dsn):
            return "sqlite", f"jdbc:sqlite:{dsn}"
        raise ValueError(f"no scheme in {dsn!r}")
    if scheme not in _SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    dialect = {"postgresql": "postgres"}.get(scheme, scheme)
    rest = rest.rpartition("@")[2]  # credentials go in reader options, never in an address that plans print
    return dialect, f"jdbc:{_SCHEMES[scheme]}:{rest}" if scheme == "sqlite" else f"jdbc:{_SCHEMES[scheme]}://{rest}"


def read_jdbc(spark: SparkSession, dsn: str, table: Table, partitions: int = 16, bounds: tuple[int, int] | None = None, **options) -> DataFrame:
    """A database table by Spark's own reader, in parallel ranges of a numeric single-column key where bounds are given."""
    reader = spark.read.format("jdbc").option("url", jdbc_url(dsn)[1]).option("dbtable", table.name).options(**options)
    if bounds and len(table.primary_key) == 1:
        reader = reader.options(partitionColumn=table.primary_key[0], lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load().select(*table.stored_columns())
