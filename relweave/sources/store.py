"""A store of tables that change together: versions are manifests, and a batch of changes is published by one rename.

    root/data/<table>/<id>/part-*.parquet    rows, never changed once written
    root/files/<table>-<id>/                 a table's files: path, n_rows, least and greatest (of the key's first column)
    root/manifest/<version>                  JSON: of each table its list of files, key and schema

A reader takes the highest version and keeps it, whatever is published later. A
writer adds files, then renames a manifest into place under the next version: if
that version has come meanwhile, the rename is refused and the batch leaves
nothing behind. The file system's rename has to be atomic and to refuse a name
that is taken, as those of HDFS are.

An upsert is copy-on-write: files whose key range can't hold a sent key aren't
read, those that hold none aren't rewritten.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.operators import dml
from relweave.plans import history
from relweave.sources.staging import staged

#: Table of a store that keeps which scripts have run.
HISTORY = "migration_history"


class Conflict(RuntimeError):
    """Another batch was published since this one began."""


@dataclass
class Entry:
    """A table of a version: its list of files (a folder below root/files), key and schema."""

    files: str
    key: list[str]
    schema: str


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifest") if n.isdigit())

    def version(self) -> int:
        """The latest version; 0 for a store that has none yet."""
        return max(self.versions(), default=0)

    def entries(self, version: int | None = None) -> dict[str, Entry]:
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.root}/manifest/{version:020d}", wholetext=True).first()[0]
        return {n: Entry(**e) for n, e in json.loads(text).items()}

    def listing(self, entry: Entry) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/files/{entry.files}")

    def rows(self, entry: Entry, paths: list[str]) -> DataFrame:
        """Rows of some of a table's files. Their paths are at the driver, as those of any table that Spark reads."""
        schema = T.StructType.fromJson(json.loads(entry.schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the latest unless told otherwise."""
        found = self.entries(version)
        if name not in found:
            raise KeyError(f"no table {name!r} in version {self.version() if version is None else version}")
        return self.rows(found[name], sorted(r["path"] for r in self.listing(found[name]).select("path").collect()))

    @contextmanager
    def batch(self) -> Iterator[Batch]:
        """Changes that are published together when the block ends, or not at all if it raises."""
        made = Batch(self, self.version())
        try:
            yield made
            made.publish()
        except BaseException:
            made.abandon()
            raise

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last versions, and files that none of these has and that are older than the latest: a batch in progress keeps its own."""
        kept = self.versions()[-keep:]
        if not kept:
            return
        since = self._fs.getFileStatus(self._path(f"manifest/{kept[-1]:020d}")).getModificationTime()
        entries = [e for v in kept for e in self.entries(v).values()]
        lists = {e.files for e in entries}
        used = {r["path"] for name in lists for r in self.spark.read.parquet(f"{self.root}/files/{name}").select("path").collect()}
        for v in self.versions():
            if v not in kept:
                self._delete(f"manifest/{v:020d}")
        old = lambda name: self._fs.getFileStatus(self._path(name)).getModificationTime() < since
        for name in self._names("files"):
            if name not in lists and old(f"files/{name}"):
                self._delete(f"files/{name}")
        for table in self._names("data"):
            for run in self._names(f"data/{table}"):
                for file in self._names(f"data/{table}/{run}"):
                    path = f"data/{table}/{run}/{file}"
                    if path not in used and old(path):
                        self._delete(path)


@dataclass
class Batch:
    store: Store
    base: int
    changed: dict[str, Entry | None] = field(default_factory=dict)
    made: list[str] = field(default_factory=list)

    def entries(self) -> dict[str, Entry]:
        """The tables as this batch leaves them so far."""
        return {n: e for n, e in {**self.store.entries(self.base), **self.changed}.items() if e}

    def read(self, name: str) -> DataFrame:
        entry = self.entries()[name]
        return self.store.rows(entry, sorted(r["path"] for r in self.store.listing(entry).select("path").collect()))

    def _write(self, name: str, rows: DataFrame, key: Sequence[str]) -> DataFrame:
        """Writes rows in files of their own and returns what the list has of them."""
        run = f"data/{name}/{uuid.uuid4().hex}"
        self.made.append(run)
        rows.write.parquet(f"{self.store.root}/{run}")
        there = self.store.spark.read.schema(rows.schema).parquet(f"{self.store.root}/{run}")
        path = F.concat(F.lit(f"{run}/"), F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0))
        first = F.col(f"`{key[0]}`") if key else F.lit(None).cast("int")
        return there.select(path.alias("path"), first.alias("k")).groupBy("path").agg(F.count("*").alias("n_rows"), F.min("k").alias("least"), F.max("k").alias("greatest"))

    def _list(self, name: str, files: DataFrame, key: Sequence[str], schema: T.StructType) -> None:
        listing = f"{name}-{uuid.uuid4().hex}"
        self.made.append(f"files/{listing}")
        files.coalesce(1).write.parquet(f"{self.store.root}/files/{listing}")
        self.changed[name] = Entry(listing, list(key), json.dumps(schema.jsonValue()))

    def put(self, name: str, rows: DataFrame, key: Sequence[str] = (), files: int | None = None) -> None:
        """A table's new contents. With a key, files hold ranges of it, so that later upserts pass most of them by."""
        if key:
            rows = rows.repartitionByRange(*([files] if files else []), *key).sortWithinPartitions(*key)
        self._list(name, self._write(name, rows, key), key, rows.schema)

    def drop(self, name: str) -> None:
        if name not in self.entries():
            raise KeyError(f"no table {name!r} to drop")
        self.changed[name] = None

    def upsert(self, name: str, source: DataFrame, order: str | None = None) -> list[str]:
        """dml.upsert by the table's key, rewriting only files that hold a sent key; returns the paths of those that stay as they are."""
        entry = self.entries()[name]
        columns = T.StructType.fromJson(json.loads(entry.schema)).names
        sent = staged(dml.latest(source, entry.key, order), "sent")
        rows = sent.drop(order) if order and order not in columns else sent
        return self._rewrite(name, entry, sent, lambda old: dml.upsert(old, rows, entry.key))

    def delete(self, name: str, keys: DataFrame) -> list[str]:
        """Deletes the rows of given keys, rewriting only files that hold one; returns the paths of those that stay as they are."""
        entry = self.entries()[name]
        sent = staged(keys.select(*entry.key).dropna().distinct(), "sent")
        return self._rewrite(name, entry, sent, lambda old: old.join(sent, entry.key, "left_anti").select(old.columns))

    def _rewrite(self, name: str, entry: Entry, sent: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[str]:
        if not entry.key:
            raise ValueError(f"{name!r} has no key to change rows by")
        ends = sent.agg(F.min(entry.key[0]).alias("a"), F.max(entry.key[0]).alias("b")).first()
        listing = self.store.listing(entry)
        reach = F.coalesce((F.col("greatest") >= F.lit(ends["a"])) & (F.col("least") <= F.lit(ends["b"])), F.lit(False))
        paths = {r["path"]: r["near"] for r in listing.select("path", reach.alias("near")).collect()}
        near, hit = sorted(p for p, x in paths.items() if x), []
        if near:
            tail = F.regexp_extract(F.col("_metadata.file_path"), r"data/[^/]*/[^/]*/[^/]*$", 0)
            keys = self.store.rows(entry, near).select(*entry.key, tail.alias("_path"))
            hit = sorted(r["_path"] for r in keys.join(sent, entry.key, "left_semi").select("_path").distinct().collect())
        rows = change(self.store.rows(entry, hit))
        new = self._write(name, rows, entry.key)
        left = listing.filter(~F.col("path").isin(hit)) if hit else listing
        self._list(name, left.unionByName(new), entry.key, rows.schema)
        return sorted(set(paths) - set(hit))

    def publish(self) -> None:
        """Renames the manifest into place. Raises Conflict if another batch was faster."""
        if not self.changed:
            return
        jvm, store = self.store.spark._jvm, self.store
        text = json.dumps({n: vars(e) for n, e in self.entries().items()}, indent=1)
        ready = f"manifest/.{uuid.uuid4().hex}"
        self.made.append(ready)
        stream = store._fs.create(store._path(ready))
        stream.write(bytearray(text.encode()))
        stream.close()
        target = store._path(f"manifest/{self.base + 1:020d}")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store._fs.makeQualified(target).toUri(), store.spark._jsc.hadoopConfiguration())
        refuse = store.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        refuse[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            files.rename(store._fs.makeQualified(store._path(ready)), store._fs.makeQualified(target), refuse)
        except Exception as e:
            if store.version() > self.base:
                raise Conflict(f"version {self.base + 1} was published meanwhile") from e
            raise
        self.made.clear()

    def abandon(self) -> None:
        """Deletes what this batch wrote; nothing refers to it."""
        for name in self.made:
            self.store._delete(name)
        self.made.clear()
        self.changed.clear()


def migrate(store: Store, files: DataFrame, run: Callable[[Batch, str], None], one_batch: bool = False) -> Exception | None:
    """Runs pending scripts (filename, text) as batches: run(batch, text) changes tables, and the history changes with them.

    A script's tables and its row of the history are published together, or
    neither. With one_batch all scripts are one batch. The script that failed is
    recorded as failed in a batch of its own; those before it stay (with
    one_batch: none does). Returns the failure.
    """
    spark = store.spark
    empty = spark.createDataFrame([], history.SCHEMA)
    past = lambda source: source.read(HISTORY) if HISTORY in source.entries() else empty
    due = [(r["filename"], r["checksum"]) for r in history.pending(files, past(store)).collect()]
    texts = {r["filename"]: r["text"] for r in files.filter(F.col("filename").isin([n for n, _ in due])).collect()}

    def note(batch: Batch, name: str, checksum: str, began: int, success: bool) -> None:
        kept = checksum if name.startswith("repeatable/") else None
        row = spark.createDataFrame([(name, kept, began // 1000, time.time_ns() - began, success)], "filename string, checksum string, at bigint, time_taken_ns bigint, success boolean")
        row = row.select("filename", "checksum", F.timestamp_micros("at").alias("started_at"), "time_taken_ns", "success")
        batch.put(HISTORY, history.record(past(batch), row), ["filename"])

    for group in [due] if one_batch else [[x] for x in due]:
        at, began = group[0] if group else None, time.time_ns()
        try:
            with store.batch() as batch:
                for at in group:
                    began = time.time_ns()
                    run(batch, texts[at[0]])
                    note(batch, *at, began, True)
        except Exception as e:  # whatever a script raises is recorded
            with store.batch() as batch:
                note(batch, *at, began, False)
            return e
    return None
