"""Catalogs, names, types, diffs, history, the registry."""

import os
import shutil
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from relweave.catalog import FOREIGN_KEY, Catalog, Column, Constraint, Enum, Index, Table, Trigger, View, generate_name, sample_catalog, strongly_connected
from relweave.functions import types
from relweave.plans import diff, history, metadata, scripts


def test_catalog_json_round_trip():
    catalog = sample_catalog()
    catalog.views, catalog.enums = [View("v", "SELECT 1")], [Enum("e", ["a", "b"])]
    catalog.triggers = [Trigger("touched", "region", "SELECT 1")]
    catalog.tables[0].indexes.append(Index(["r_name"], "region_r_name_idx", unique=True))
    again = Catalog.from_json(catalog.to_json())
    assert again == catalog and again.domains is None and again.routines == []
    assert catalog.table("orders").columns[1].references == "customer.c_custkey" and catalog.table("lineitem").primary_key == []


def test_merge_is_deep_and_soft_deletes_hide():
    catalog = sample_catalog()
    both = catalog.merged(Catalog("x", [Table("region", [Column("z", "INT")])]))
    both.table("nation").columns.clear()
    assert [c.name for c in both.table("region").columns] == ["z"] and catalog.table("nation").columns
    catalog.table("region").ignore = True
    with pytest.raises(KeyError):
        catalog.table("region")
    with pytest.raises(ValueError, match="unknown columns"):
        Table("t", [Column("a", "INT")], [Constraint("UNIQUE", ["b"])])


@pytest.mark.parametrize(
    ("kind", "table", "columns", "want"),
    [("PRIMARY KEY", "film actor", ["actor_id", "film id"], "film_actor_actor_id_film_id_pkey"), ("INDEX", "t", ["c"], "t_c_idx"), ("UNIQUE", "t" * 80, ["c"], "t" * 59 + "_key"), ("CHECK", "é" * 40, [], "é" * 28 + "_check")],
)
def test_names(kind, table, columns, want):
    assert generate_name(kind, table, columns) == want and len(want.encode()) <= 63


def test_groups_come_before_what_they_lead_to():
    groups = list(strongly_connected(list("abcde"), [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "e")]))
    assert [g for g in groups if len(g) > 1] == [["b", "c"]]
    order = {n: i for i, g in enumerate(groups) for n in g}
    assert order["a"] < order["b"] < order["d"]


@pytest.mark.parametrize(
    ("dialect", "declared", "want"),
    [
        ("mysql", "int(11) unsigned", ("INT", "", "")), ("mysql", "INT UNSIGNED", ("INT UNSIGNED", "", "")), ("mysql", "bool", ("TINYINT", "1", "")), ("mysql", "tinyint(4)", ("TINYINT", "", "")), ("mysql", "DEC(5,2)", ("NUMERIC", "5", "2")),
        ("mysql", "bigint signed", ("BIGINT", "", "")), ("sqlserver", "national character varying(10)", ("NVARCHAR", "10", "")), ("sqlserver", "nvarchar(max)", ("NVARCHAR", "MAX", "")), ("sqlite", " integer ", ("INTEGER", "", "")), ("postgres", "time(3) with time zone", ("TIMETZ", "3", "")),
        ("postgres", "numeric(10,2)", ("NUMERIC", "10", "2")), ("postgres", "int[]", ("INT[]", "", "")),
    ],
)
def test_types_of_dialects(spark, dialect, declared, want):
    assert tuple(spark.range(1).select(types.normalize_type(F.lit(declared), dialect).alias("n")).first()["n"]) == want


def test_spark_types():
    named = {"BIGINT UNSIGNED": "decimal(20,0)", "INT[]": "array<int>", "TIMESTAMPTZ": "timestamp", "DATETIME": "timestamp_ntz", "UUID": "string", "BYTEA": "binary", "TINYINT UNSIGNED": "smallint"}
    assert {k: types.spark_type(k).simpleString() for k in named} == named and types.spark_type("NUMERIC", "9", "4").simpleString() == "decimal(9,4)"


@pytest.mark.parametrize(("dialect", "declared", "want"), [("sqlite", "datetime('now')", "CURRENT_TIMESTAMP"), ("sqlserver", "GETDATE()", "CURRENT_TIMESTAMP"), ("mysql", "NOW()", "CURRENT_TIMESTAMP"), ("mysql", "a::b", "a::b"), ("postgres", "'a'::text", "'a'")])
def test_defaults_of_dialects(spark, dialect, declared, want):
    assert spark.range(1).select(types.normalize_default(F.lit(declared), dialect).alias("n")).first()["n"] == want


def test_identifiers(spark):
    rows = spark.createDataFrame([("plain_1",), ("1st",), ("Mixed",), ("a`b",), ("order",)], "n string").select(types.identifier(F.col("n"), ["order"])).collect()
    assert [r[0] for r in rows] == ["plain_1", "`1st`", "`Mixed`", "`a``b`", "`order`"]


def test_plan_without_drops_and_rebuilding_a_table(spark, small):
    old, new = sample_catalog(), sample_catalog()
    new.table("region").columns = [Column("r_regionkey", "BIGINT", not_null=True, is_primary_key=True), Column("r_note", "TEXT", default="'none'"), Column("r_rank", "INT", not_null=True)]
    plan = [(r["step"], r["object"]) for r in diff.steps(spark, old, new).collect()]
    assert plan == [("add column", "r_note"), ("add column", "r_rank"), ("alter column", "r_regionkey")]
    warned = {r["object"]: r["warning"] for r in diff.steps(spark, old, new, drop_objects=True).collect()}
    assert warned["r_name"] and warned["r_rank"] and not warned["r_note"]
    assert diff.steps(spark, old, old, drop_objects=True).count() == 0
    rebuilt = diff.rebuilt(spark.read.parquet(f"{small}/region.parquet"), new.table("region"))
    assert rebuilt.schema.simpleString() == "struct<r_regionkey:bigint,r_note:string,r_rank:int>" and {r["r_note"] for r in rebuilt.collect()} == {"none"}


def test_introspection(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS relweave_test")
    spark.range(3).write.mode("overwrite").saveAsTable("relweave_test.numbers")
    try:
        catalog = metadata.introspect(spark, "relweave_test")
        assert [(t.name, [c.type for c in t.columns]) for t in catalog.tables] == [("numbers", ["BIGINT"])]
    finally:
        spark.sql("DROP DATABASE relweave_test CASCADE")


def empty_history(spark):
    return spark.createDataFrame([], history.SCHEMA)


def test_scripts_are_found_and_ordered(spark, tmp_path):
    (tmp_path / "repeatable" / "views").mkdir(parents=True)
    for n in ("02_b.sql", "01_a.sql", "01_a.undo.sql", "schema.sql", "notes.txt", "repeatable/views/v.sql"):
        (tmp_path / n).write_bytes(b"SELECT 1;\r\nSELECT 2;\n")
    files = history.scripts(spark, str(tmp_path))
    assert {r["text"] for r in files.collect()} == {"SELECT 1;\r\nSELECT 2;\n"}
    assert [r["filename"] for r in history.pending(files, empty_history(spark)).collect()] == ["01_a.sql", "02_b.sql", "repeatable/views/v.sql"]


def test_migrate_stops_at_a_failure_undoes_it_and_resumes(spark):
    files = spark.createDataFrame([("01.sql", "ok1"), ("02.sql", "bad"), ("03.sql", "ok3"), ("repeatable/r.sql", "rep")], "filename string, text string")
    ran, undone = [], []

    def run(text):
        ran.append(text)
        if text == "bad":
            raise RuntimeError(text)

    first, failure = history.migrate(spark, files, empty_history(spark), run, undone.append)
    first = spark.createDataFrame(first.collect(), history.SCHEMA)
    assert ran == ["ok1", "bad"] and undone == ["02.sql"] and isinstance(failure, RuntimeError)
    assert {r["filename"]: r["success"] for r in first.collect()} == {"01.sql": True, "02.sql": False}
    fixed = files.withColumn("text", F.replace("text", F.lit("bad"), F.lit("good")))
    second, failure = history.migrate(spark, fixed, first, run)
    second = spark.createDataFrame(second.collect(), history.SCHEMA)
    assert failure is None and ran[2:] == ["good", "ok3", "rep"]
    assert history.pending(fixed, second).count() == 0
    changed = fixed.withColumn("text", F.concat("text", F.lit("!")))
    assert [r["filename"] for r in history.pending(changed, second).collect()] == ["repeatable/r.sql"]


def test_retries(spark):
    files = spark.createDataFrame([("01.sql", "x")], "filename string, text string")
    tries = []

    def run(text):
        tries.append(text)
        if len(tries) < 3:
            raise TimeoutError

    done, failure = history.migrate(spark, files, empty_history(spark), run, attempts=5, retry=(TimeoutError,), delay=0.01)
    assert len(tries) == 3 and failure is None and done.collect()[0]["success"]


def test_every_query_gives_its_sql_rows(spark, small):
    """All registered queries but those of the pipeline subpackage, against DuckDB on the same tables."""
    import duckdb

    from relweave import queries as registry

    registry.load_all()
    con = duckdb.connect()
    for t in (*registry.SAMPLE, "documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for name, run in registry.QUERIES.items():
        df = run(spark, small)
        names = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
        found = con.execute(registry.ORACLES[name])
        at = [c[0] for c in found.description]
        want = sorted(repr([plain(r[at.index(c)]) for c in names]) for r in found.fetchall())
        assert sorted(at) == names and got == want, name


def test_entry_module_works_without_the_pipeline_subpackage():
    code = "import sys; sys.modules['relweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'sales_by_nation' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True, timeout=120)


def test_generated_names_agree_with_the_catalog(spark):
    df = spark.range(1).select(types.generated_name(F.lit("film actor"), F.array(F.lit("a b"), F.lit("x" * 70)), FOREIGN_KEY))
    assert df.first()[0] == generate_name(FOREIGN_KEY, "film actor", ["a b", "x" * 70])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_stamps_are_utc_in_any_session(spark, zone):
    """Clock times, offsets, Unix times and instants, out and back, with sessions of other zones."""
    from pyspark.sql import types as T

    from relweave.functions import codec

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-01-01 00:00:00+02:00", "2024-01-01T12:30Z", "2024-03-10 02:30:00", "2024-01-01", "2024-01-01 00:00:00.25-05:30", ""]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r[0] for r in df.select(codec.parse_timestamp(F.col("t")).cast("string")).collect()]
        assert got == ["2023-12-31 22:00:00", "2024-01-01 12:30:00", "2024-03-10 02:30:00", "2024-01-01 00:00:00", "2024-01-01 05:30:00.25", None]
        epochs = spark.createDataFrame([(0,), (1_700_000_000,), (1_700_000_000_000,)], "n bigint").select(codec.epoch_timestamp(F.col("n")).cast("string"))
        assert [r[0] for r in epochs.collect()] == ["1970-01-01 00:00:00", "2023-11-14 22:13:20", "2023-11-14 22:13:20"]
        instant = spark.range(1).select(F.timestamp_seconds(F.lit(1_700_000_000)).alias("x"))
        field = instant.select(codec.encode(F.col("x"), T.TimestampType()).alias("f"))
        assert field.first()[0] == "2023-11-14 22:13:20"
        assert field.select(F.unix_seconds(codec.decode(F.col("f"), T.TimestampType()))).first()[0] == 1_700_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_module_works_where_the_subpackage_is_deleted(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (copy / "relweave" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sales_by_nation' in q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)


def test_the_package_is_shipped_to_clusters_as_an_archive():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    class Context:
        master, applicationId, files = "spark://somewhere:7077", "app-1", []
        addPyFile = files.append

    class Session:
        sparkContext = Context()

    for _ in range(2):
        entry._ship(Session())
    (archive,) = Context.files
    assert {"relweave/catalog.py", "relweave/__init__.py"} <= set(zipfile.ZipFile(archive).namelist())


def test_indexes_checks_rules_and_views_count_in_diffs(spark):
    table = lambda **k: Table("t", [Column("a", "INT"), Column("b", "INT")], k.get("cons", []), k.get("idx", []))
    check = lambda text: Constraint("CHECK", ["a"], "t_check", check=text)
    parent = Table("p", [Column("a", "INT")])
    ref = lambda **k: Constraint(FOREIGN_KEY, ["a"], "fk", references_table="p", references_columns=["a"], **k)
    cases = [
        ({"cons": [check("a > 0")]}, {"cons": [check(" a  > 0")]}, []),
        ({"cons": [check("a > 0")]}, {"cons": [check("a > 1")]}, ["drop constraint", "add constraint"]),
        ({"cons": [ref()]}, {"cons": [ref(delete_rule="NO ACTION")]}, []),
        ({"cons": [ref()]}, {"cons": [ref(delete_rule="CASCADE")]}, ["drop constraint", "add constraint"]),
        ({"cons": [ref()]}, {"cons": [ref(deferrable=True)]}, ["drop constraint", "add constraint"]),
        ({"idx": [Index(["a"], "i")]}, {"idx": [Index(["a"], "i", kind="btree")]}, []),
        ({"idx": [Index(["a"], "i")]}, {"idx": [Index(["b"], "i")]}, ["drop index", "add index"]),
        ({"idx": [Index(["a"], "i")]}, {}, []),  # drops only where asked for
    ]
    for old, new, want in cases:
        steps = diff.steps(spark, Catalog("c", [table(**old), parent]), Catalog("c", [table(**new), parent]))
        assert [r["step"] for r in steps.collect()] == want
    assert [r["step"] for r in diff.steps(spark, Catalog("c", views=[View("v", "x")]), Catalog("c", views=[View("v", "y")])).collect()] == ["drop view", "create view"]


def test_not_null_on_an_old_column_is_warned_of(spark):
    old, new = (metadata.columns(spark, Catalog("c", [Table("t", [Column("a", "INT", not_null=n)])])) for n in (False, True))
    (row,) = diff.column_changes(old, new).collect()
    assert row["change"] == "alter" and row["warning"] == "setting NOT NULL fails on rows that have none"


def test_scripts_run_up_to_their_first_failure(spark, tmp_path):
    good = tmp_path / "good.sql"
    good.write_text("CREATE OR REPLACE TEMPORARY VIEW script_view AS SELECT 1 AS x;\n-- a comment; with a semicolon\nSELECT 'a;b' FROM script_view;\nCREATE OR REPLACE TEMPORARY VIEW script_view AS SELECT 2 AS x")
    (row,) = scripts.run_file(spark, str(good)).collect()
    assert row["script"] == "good.sql" and row["success"] and row["error"] is None and row["time_taken_ns"] > 0
    assert spark.table("script_view").first()["x"] == 2
    (row,) = scripts.run(spark, "CREATE OR REPLACE TEMPORARY VIEW script_view AS SELECT 3 AS x; SELECT raise_error('boom'); CREATE OR REPLACE TEMPORARY VIEW script_view AS SELECT 4 AS x;").collect()
    assert not row["success"] and "boom" in row["error"] and spark.table("script_view").first()["x"] == 3
    assert not scripts.run(spark, "SELEC 1;").first()["success"] and scripts.run(spark, " \n").first()["success"]
    empty = tmp_path / "empty.sql"
    empty.write_text("")
    assert scripts.run_file(spark, str(empty)).first()["success"]


def test_all_problems_of_a_declared_catalog(spark):
    bad = """{"tables": [
      {"name": "a", "columns": [{"name": "x", "type": "INT"}, {"name": "x", "type": "INT"}, {"name": "y", "type": "INT"}],
       "constraints": [{"kind": "PRIMARY KEY", "columns": ["x"], "name": "a_pkey"}, {"kind": "PRIMARY KEY", "columns": ["q"]}, {"kind": "FOREIGN KEY", "columns": ["x", "y"], "name": "f1", "references_table": "b", "references_columns": ["z"]},
        {"kind": "FOREIGN KEY", "columns": ["x"], "name": "f2", "references_table": "c", "references_columns": ["z"]}, {"kind": "FOREIGN KEY", "columns": ["x"], "name": "f3", "references_table": "b", "references_columns": ["w"]}, {"kind": "UNIQUE", "columns": [], "name": "u"}],
       "indexes": [{"name": "i", "columns": ["y", "nope"]}, {"name": "a_pkey", "columns": ["x"]}, {"name": "gone", "columns": ["nope"], "ignore": true}]},
      {"name": "b", "columns": [{"name": "z", "type": "INT"}]}, {"name": "c", "ignore": true, "columns": [{"name": "z", "type": "INT"}]}]}"""
    got = [tuple(r) for r in metadata.problems(*metadata.declared(spark, bad)).collect()]
    assert got == sorted([
        ("a", "", "several primary keys"), ("a", "", "unknown column q"), ("a", "x", "declared 2 times"), ("a", "f1", "as many columns must be referenced as refer"),
        ("a", "f2", "unknown table c"), ("a", "f3", "unknown column b.w"), ("a", "i", "unknown column nope"), ("a", "u", "no columns"),
    ])
    assert metadata.problems(*metadata.declared(spark, sample_catalog().to_json())).collect() == []
    assert metadata.problems(*metadata.declared(spark, '{"tables": []}')).collect() == []


def test_server(spark):
    (row,) = metadata.server(spark).collect()
    assert row["version"].startswith(spark.version) and (row["catalog"], row["database"], row["zone"]) == ("spark_catalog", "default", "UTC")


def test_type_modifiers(spark):
    rows = spark.createDataFrame([(-1,), (4,), (24,), ((10 << 16 | 2) + 4,)], "m int").select(types.typmod_numeric(F.col("m")).alias("n"), types.typmod_size(F.col("m")).alias("s"), types.typmod_size(F.col("m"), bits=True).alias("b")).collect()
    assert [(*r["n"], r["s"], r["b"]) for r in rows] == [(None, None, None, None), (0, 0, 0, 4), (0, 20, 20, 24), (10, 2, 655362, 655366)]
