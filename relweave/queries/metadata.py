"""Questions about catalogs, types, names, diffs and migration history."""

from __future__ import annotations

import copy
import itertools

from pyspark.sql import functions as F

from relweave.catalog import FOREIGN_KEY, PRIMARY_KEY, UNIQUE, Column, Constraint, Domain, Enum, Index, Routine, Trigger, View, sample_catalog
from relweave.functions import types
from relweave.plans import diff, history, metadata
from relweave.queries import SAMPLE, query, sample, table


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


OLD = sample_catalog()
OLD.table("customer").indexes.append(Index(["c_mktsegment"], "customer_seg_idx"))
OLD.table("customer").indexes.append(Index(["c_custkey"], "customer_c_custkey_pkey", unique=True))

_COLUMNS = _values([(t.name, i, c.name, c.type, c.not_null, c.references) for t in OLD.tables for i, c in enumerate(t.columns, 1)])
_CONS = _values([(t.name, c.name, c.kind, ",".join(c.columns), c.references_table, ",".join(c.references_columns)) for t in OLD.tables for c in t.constraints])
_INDEXES = _values([(t.name, x.name, x.unique, ",".join(x.columns), x.predicate) for t in OLD.tables for x in t.indexes])


@query(f"SELECT * FROM {_COLUMNS} AS t(\"table\", position, \"column\", type, not_null, \"references\") WHERE \"table\" IN ('orders', 'lineitem')")
def catalog_columns(spark, d):
    return metadata.selected(metadata.columns(spark, OLD), "table", include=["orders", "lineitem"]).select("table", "position", "column", "type", "not_null", "references")


@query(f"SELECT \"table\", count(*) AS n_columns, count(*) FILTER (WHERE not_null) AS n_required FROM {_COLUMNS} AS t(\"table\", position, \"column\", type, not_null, \"references\") WHERE \"table\" NOT IN ('events') GROUP BY 1")
def catalog_tables(spark, d):
    return metadata.selected(metadata.columns(spark, OLD), "table", exclude=["events"]).groupBy("table").agg(F.count("*").alias("n_columns"), F.count(F.when(F.col("not_null"), 1)).alias("n_required"))


@query(f"SELECT \"table\", kind, count(*) AS n, string_agg(name, ';' ORDER BY name) AS names FROM {_CONS} AS t(\"table\", name, kind, cols, rt, rc) GROUP BY 1, 2")
def union_constraints(spark, d):
    """Keys and foreign keys of all tables, gathered kind by kind."""
    cons = metadata.constraints(spark, OLD)
    kinds = [cons.filter(F.col("kind") == k) for k in (PRIMARY_KEY, UNIQUE, FOREIGN_KEY)]
    both = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return both.groupBy("table", "kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ";").alias("names"))


@query(f"SELECT \"table\", name, 1 AS position, cols AS \"column\", rt AS references_table, rc AS references_column FROM {_CONS} AS t(\"table\", name, kind, cols, rt, rc) WHERE kind = 'FOREIGN KEY'")
def zip_fk_columns(spark, d):
    return metadata.constraint_columns(metadata.constraints(spark, OLD)).filter("kind = 'FOREIGN KEY'").drop("kind")


@query(f"SELECT i.* FROM (SELECT \"table\", name FROM {_INDEXES} AS t(\"table\", name, u, c, p)) i ANTI JOIN {_CONS} AS c(\"table\", name, kind, cols, rt, rc) ON i.\"table\" = c.\"table\" AND i.name = c.name")
def anti_join_indexes(spark, d):
    return metadata.plain_indexes(metadata.indexes(spark, OLD), metadata.constraints(spark, OLD)).select("table", "name")


# --- types, defaults, names: the same rules as CASE and regular expressions

_PG = ["integer", " INT4 ", "bigserial", "Decimal(10, 2)", "character varying(20)", "character(3)", "timestamp with time zone", "timestamp (3) with time zone", "time without time zone", "int8[]", "float8", "bit varying(5)", "bool", "text", "numeric", "varchar(5)[]"]


@query(
    f"""WITH t AS (SELECT declared, upper(trim(declared)) AS u FROM {_values([(x,) for x in _PG])} AS v(declared)),
    a AS (SELECT declared, trim(regexp_replace(u, '\\(.*', '')) AS base, CASE WHEN contains(u, '(') THEN trim(regexp_extract(u, '\\((.*)\\)', 1)) ELSE '' END AS args, replace(regexp_extract(u, '\\)(.*)$', 1), ' ', '') AS tail FROM t),
    b AS (SELECT declared, args, tail, regexp_matches(base, '\\[\\]$') AS arr, replace(regexp_replace(base, '\\[\\]$', ''), ' ', '') AS k, regexp_replace(base, '\\[\\]$', '') AS base FROM a)
    SELECT declared, CASE WHEN k IN ('INTEGER', 'INT4') THEN 'INT' WHEN k IN ('BIGSERIAL', 'INT8') THEN 'BIGINT' WHEN k = 'DECIMAL' THEN 'NUMERIC' WHEN k = 'CHARACTERVARYING' THEN 'VARCHAR' WHEN k = 'CHARACTER' THEN 'CHAR'
      WHEN k = 'TIMESTAMPWITHTIMEZONE' OR (k = 'TIMESTAMP' AND tail = 'WITHTIMEZONE') THEN 'TIMESTAMPTZ' WHEN k = 'TIMEWITHOUTTIMEZONE' THEN 'TIME' WHEN k = 'FLOAT8' THEN 'DOUBLE PRECISION' WHEN k = 'BITVARYING' THEN 'VARBIT' WHEN k = 'BOOL' THEN 'BOOLEAN' ELSE base END
      || CASE WHEN arr OR tail = '[]' THEN CASE WHEN arr THEN '[]' ELSE '' END ELSE '' END AS type, trim(split_part(args, ',', 1)) AS arg1, trim(split_part(args, ',', 2)) AS arg2 FROM b"""
)
def normalize_type(spark, d):
    declared = spark.createDataFrame([(x,) for x in _PG], "declared string")
    return declared.select("declared", types.normalize_type(F.col("declared"), "postgres").alias("n")).select("declared", "n.*")


_DEFAULTS = ["1", "true", " FALSE", "0", "now()", "'x'::text", "current_date", "null", "", "'1'", "nextval('s'::regclass)"]


@query(
    f"""SELECT declared, CASE WHEN trim(declared) = '' THEN '' WHEN upper(trim(declared)) IN ('1', 'TRUE') THEN '''1''' WHEN upper(trim(declared)) IN ('0', 'FALSE') THEN '''0'''
    WHEN upper(trim(declared)) IN ('CURRENT_DATE', 'CURRENT_TIME', 'CURRENT_TIMESTAMP', 'NULL') THEN upper(trim(declared)) WHEN upper(trim(declared)) = 'NOW()' THEN 'CURRENT_TIMESTAMP' ELSE split_part(trim(declared), '::', 1) END AS "default"
    FROM {_values([(x,) for x in _DEFAULTS])} AS v(declared)"""
)
def normalize_default(spark, d):
    declared = spark.createDataFrame([(x,) for x in _DEFAULTS], "declared string")
    return declared.select("declared", types.normalize_default(F.col("declared"), "postgres").alias("default"))


@query("SELECT p_partkey, left(replace(p_type || '_' || p_name || '_' || p_brand || '_' || p_type || '_' || p_name, ' ', '_'), 58) || '_fkey' AS name FROM part")
def generate_name(spark, d):
    return table(spark, d, "part").select("p_partkey", types.generated_name(F.col("p_type"), F.array("p_name", "p_brand", "p_type", "p_name"), FOREIGN_KEY).alias("name"))


_LITERALS = ["'a'", "1", "-2.5e3", "TRUE", "now()", "null", "'", "abc", "current_timestamp"]


@query(f"SELECT v, regexp_matches(v, '^''.*''$') OR upper(v) IN ('TRUE', 'FALSE', 'NULL', 'CURRENT_DATE', 'CURRENT_TIME', 'CURRENT_TIMESTAMP') OR try_cast(v AS DOUBLE) IS NOT NULL AS literal FROM {_values([(x,) for x in _LITERALS])} AS t(v)")
def literals(spark, d):
    return spark.createDataFrame([(x,) for x in _LITERALS], "v string").select("v", types.is_literal(F.col("v")).alias("literal"))


# --- diff

NEW = copy.deepcopy(OLD)
NEW.tables = [t for t in NEW.tables if t.name != "events"]
_customer = NEW.table("customer")
_customer.columns = [c for c in _customer.columns if c.name != "c_acctbal"]
_customer.columns += [Column("c_email", "VARCHAR(50)"), Column("c_since", "DATE", not_null=True)]
next(c for c in _customer.columns if c.name == "c_mktsegment").type = "VARCHAR(10)"
next(c for c in _customer.columns if c.name == "c_name").type = "character varying"
NEW.table("region").columns[1].not_null = True
NEW.table("supplier").constraints.append(Constraint(UNIQUE, ["s_name"], "supplier_s_name_key"))
NEW.table("orders").constraints = [c for c in NEW.table("orders").constraints if c.kind != FOREIGN_KEY]
NEW.table("nation").constraints[-1].delete_rule = "CASCADE"
_customer.indexes = [Index(["c_mktsegment"], "customer_seg_idx", predicate="c_custkey > 0"), Index(["c_name"]), Index(["c_custkey"], "customer_c_custkey_pkey", unique=True)]
NEW.table("part").indexes = [Index(["p_size"])]
OLD.views = [View("big", "SELECT 1"), View("old", "SELECT 2"), View("same", "SELECT 3")]
NEW.views = [View("big", "SELECT 1 + 1"), View("new", "SELECT 4"), View("same", "SELECT  3")]
OLD.enums, OLD.routines, OLD.domains = [Enum("mood", ["good", "bad"])], [Routine("f", "SELECT 1")], [Domain("posint", "INT", checks=["VALUE > 0"])]
OLD.triggers = [Trigger("touched", "orders", "UPDATE orders SET o_totalprice = o_totalprice")]

_NEW_COLUMNS = _values([(t.name, c.name, c.type, c.not_null) for t in NEW.tables for c in t.columns])
_NEW_CONS = _values([(t.name, c.name, c.kind, ",".join(c.columns), c.references_table, ",".join(c.references_columns), c.delete_rule) for t in NEW.tables for c in t.constraints])
_NEW_INDEXES = _values([(t.name, x.name, x.unique, ",".join(x.columns), x.predicate) for t in NEW.tables for x in t.indexes])


@query(
    f"""SELECT coalesce(o."table", n."table") AS "table", coalesce(o."column", n."column") AS "column",
    CASE WHEN o."column" IS NULL THEN 'add' WHEN n."column" IS NULL THEN 'drop' WHEN o.type <> n.type OR o.nn <> n.nn THEN 'alter' ELSE 'same' END AS change
    FROM (SELECT "table", "column", type, not_null AS nn FROM {_COLUMNS} AS t("table", position, "column", type, not_null, r)) o FULL JOIN {_NEW_COLUMNS} AS n("table", "column", type, nn) ON o."table" = n."table" AND o."column" = n."column" """
)
def diff_columns(spark, d):
    return diff.column_changes(metadata.columns(spark, OLD), metadata.columns(spark, NEW)).select("table", "column", "change")


@query(
    f"""SELECT coalesce(o.t, n.t) AS "table", coalesce(o.name, n.name) AS name, CASE WHEN o.t IS NULL THEN 'add' WHEN n.t IS NULL THEN 'drop' WHEN (o.k, o.c, o.rt, o.rc, '') <> (n.k, n.c, n.rt, n.rc, n.dr) THEN 'replace' ELSE 'same' END AS change
    FROM {_CONS} AS o(t, name, k, c, rt, rc) FULL JOIN {_NEW_CONS} AS n(t, name, k, c, rt, rc, dr) ON o.t = n.t AND o.name = n.name"""
)
def diff_constraints(spark, d):
    return diff.constraint_changes(metadata.constraints(spark, OLD), metadata.constraints(spark, NEW))


_DIFF_INDEXES = f"""SELECT coalesce(o.t, n.t) AS "table", coalesce(o.name, n.name) AS name, CASE WHEN o.t IS NULL THEN 'add' WHEN n.t IS NULL THEN 'drop' WHEN (o.u, o.c, o.p) <> (n.u, n.c, n.p) THEN 'replace' ELSE 'same' END AS change
    FROM {_INDEXES} AS o(t, name, u, c, p) FULL JOIN {_NEW_INDEXES} AS n(t, name, u, c, p) ON o.t = n.t AND o.name = n.name"""


@query(_DIFF_INDEXES)
def diff_indexes(spark, d):
    return diff.index_changes(metadata.indexes(spark, OLD), metadata.indexes(spark, NEW))


_OLD_VIEWS, _NEW_VIEWS = (_values([(v.name, v.sql) for v in c.views]) for c in (OLD, NEW))


@query(f"""SELECT coalesce(o.v, n.v) AS "view", CASE WHEN o.v IS NULL THEN 'add' WHEN n.v IS NULL THEN 'drop' WHEN regexp_replace(o.q, '\\s+', ' ', 'g') <> regexp_replace(n.q, '\\s+', ' ', 'g') THEN 'replace' ELSE 'same' END AS change
    FROM {_OLD_VIEWS} AS o(v, q) FULL JOIN {_NEW_VIEWS} AS n(v, q) ON o.v = n.v""")
def diff_views(spark, d):
    return diff.view_changes(metadata.views(spark, OLD), metadata.views(spark, NEW))


@query(
    f"""SELECT 1 AS position, 'drop view' AS step, '' AS "table", v AS object FROM {_OLD_VIEWS} AS t(v, q) UNION ALL SELECT 2, 'drop routine', '', 'f' UNION ALL
    SELECT 3, 'drop constraint', t, name FROM {_CONS} AS c(t, name, k, c, rt, rc) WHERE k = 'FOREIGN KEY' UNION ALL SELECT DISTINCT 4, 'drop table', t, t FROM {_COLUMNS} AS c(t, p, c, ty, nn, r) UNION ALL
    SELECT 5, 'drop enum', '', 'mood' UNION ALL SELECT 6, 'drop domain', '', 'posint'"""
)
def wipe_plan(spark, d):
    return diff.wipe(spark, OLD)


@query("SELECT 'view' AS kind, unnest(['big', 'old']) AS name UNION ALL SELECT 'routine', 'f' UNION ALL SELECT 'enum', 'mood:good,bad' UNION ALL SELECT 'domain', 'posint INT VALUE > 0' UNION ALL SELECT 'trigger', 'orders.touched'")
def catalog_objects(spark, d):
    """Views (but for one), routines, enums, domains and triggers as relations."""
    views = metadata.selected(metadata.views(spark, OLD), "view", exclude=["same"]).select(F.lit("view").alias("kind"), F.col("view").alias("name"))
    routines = metadata.routines(spark, OLD).select(F.lit("routine").alias("kind"), F.col("routine").alias("name"))
    enums = metadata.enums(spark, OLD).select(F.lit("enum").alias("kind"), F.concat("enum", F.lit(":"), F.concat_ws(",", "labels")).alias("name"))
    domains = metadata.domains(spark, OLD).select(F.lit("domain").alias("kind"), F.concat_ws(" ", "domain", "type", F.concat_ws(",", "checks")).alias("name"))
    triggers = metadata.triggers(spark, OLD).select(F.lit("trigger").alias("kind"), F.concat_ws(".", "table", "trigger").alias("name"))
    return views.unionByName(routines).unionByName(enums).unionByName(domains).unionByName(triggers)


_DECLARED = ["VARCHAR(20)", "VARCHAR(10)", "VARCHAR", "TEXT", "NUMERIC(10,2)", "NUMERIC(10,3)", "NUMERIC(8,2)", "NUMERIC", "INT", "BIGINT", "int4", "INTEGER", "CIDR", "INET"]
_MOVES = list(itertools.product(_DECLARED, _DECLARED))


@query(
    f"""WITH t AS (SELECT d, CASE WHEN b IN ('INT4', 'INTEGER') THEN 'INT' ELSE b END AS b, coalesce(try_cast(regexp_extract(d, '\\((\\d+)', 1) AS INT), 0) AS a1, coalesce(try_cast(regexp_extract(d, ',(\\d+)', 1) AS INT), 0) AS a2
      FROM (SELECT d, upper(split_part(d, '(', 1)) AS b FROM {_values([(x,) for x in _DECLARED])} AS v(d)))
    SELECT o.d AS old, n.d AS new, CASE WHEN (o.b, o.a1, o.a2) = (n.b, n.a1, n.a2) OR (o.b || '>' || n.b) IN ('CIDR>INET', 'VARCHAR>TEXT') THEN NULL
      WHEN o.b || '>' || n.b = 'TEXT>VARCHAR' THEN CASE WHEN n.a1 > 0 THEN 'longer texts than the new limit don''t fit' END WHEN o.b <> n.b THEN 'values may not convert'
      WHEN o.b = 'VARCHAR' THEN CASE WHEN n.a1 BETWEEN 1 AND o.a1 - 1 THEN 'longer texts than the new limit don''t fit' END
      ELSE nullif(concat_ws('; ', CASE WHEN o.a2 <> n.a2 AND n.a2 > 0 THEN 'digits after the point are kept to another number' END, CASE WHEN n.a1 BETWEEN 1 AND o.a1 - 1 THEN 'longer numbers than the new limit don''t fit' END), '') END AS warning FROM t o, t n"""
)
def unsafe_type_changes(spark, d):
    """Every change between some declared types."""
    moves = spark.createDataFrame(_MOVES, "old string, new string")
    return moves.select("old", "new", diff.warning(types.normalize_type(F.col("old"), "postgres"), types.normalize_type(F.col("new"), "postgres")).alias("warning"))


_PLAN = f"""WITH o AS (SELECT t AS "table", c AS "column", ty, nn FROM {_COLUMNS} AS x(t, p, c, ty, nn, r)), n AS (SELECT * FROM {_NEW_COLUMNS} AS x("table", "column", ty, nn)),
    gone AS (SELECT DISTINCT "table" FROM o EXCEPT SELECT "table" FROM n), made AS (SELECT DISTINCT "table" FROM n EXCEPT SELECT "table" FROM o),
    cols AS (SELECT coalesce(o."table", n."table") AS "table", coalesce(o."column", n."column") AS "column", CASE WHEN o.ty IS NULL THEN 'add' WHEN n.ty IS NULL THEN 'drop' WHEN o.ty <> n.ty OR o.nn <> n.nn THEN 'alter' END AS change
      FROM o FULL JOIN n ON o."table" = n."table" AND o."column" = n."column"),
    cons AS (SELECT coalesce(a.t, b.t) AS "table", coalesce(a.name, b.name) AS name, a.t IS NOT NULL AS had, b.t IS NOT NULL AS has
      FROM {_CONS} AS a(t, name, k, c, rt, rc) FULL JOIN {_NEW_CONS} AS b(t, name, k, c, rt, rc, dr) ON a.t = b.t AND a.name = b.name WHERE (a.k, a.c, a.rt, a.rc, '') IS DISTINCT FROM (b.k, b.c, b.rt, b.rc, b.dr)),
    idx AS (SELECT * FROM ({_DIFF_INDEXES}) WHERE name NOT IN (SELECT name FROM {_CONS} AS c(t, name, k, c, rt, rc))),
    vs AS (SELECT coalesce(a.v, b.v) AS v, a.v IS NOT NULL AS had, b.v IS NOT NULL AS has FROM {_OLD_VIEWS} AS a(v, q) FULL JOIN {_NEW_VIEWS} AS b(v, q) ON a.v = b.v WHERE replace(a.q, '  ', ' ') IS DISTINCT FROM replace(b.q, '  ', ' '))
    SELECT 0 AS position, 'drop view' AS step, '' AS "table", v AS object FROM vs WHERE had UNION ALL SELECT 9, 'create view', '', v FROM vs WHERE has UNION ALL
    SELECT 1, 'drop constraint', "table", name FROM cons WHERE had AND "table" NOT IN (SELECT "table" FROM gone) UNION ALL SELECT 8, 'add constraint', "table", name FROM cons WHERE has UNION ALL
    SELECT 1, 'drop index', "table", name FROM idx WHERE change IN ('drop', 'replace') UNION ALL SELECT 7, 'add index', "table", name FROM idx WHERE change IN ('add', 'replace') UNION ALL
    SELECT 2, 'drop table', "table", "table" FROM gone UNION ALL SELECT 3, 'create table', "table", "table" FROM made UNION ALL
    SELECT CASE change WHEN 'add' THEN 4 WHEN 'alter' THEN 5 ELSE 6 END, change || ' column', "table", "column" FROM cols WHERE change IS NOT NULL AND "table" NOT IN (SELECT "table" FROM gone UNION SELECT "table" FROM made)"""


@query(_PLAN)
def change_plan(spark, d):
    return diff.steps(spark, OLD, NEW, drop_objects=True).select("position", "step", "table", "object")


# --- what the tables' own schemas say, and what is wrong with declarations about them

_TYPES = "CASE column_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' ELSE column_type END"
_FRAMES = "(" + " UNION ALL ".join(f"SELECT '{t}' AS t, column_name AS c, {_TYPES} AS ty FROM (DESCRIBE SELECT * FROM {t})" for t in SAMPLE) + ")"


@query(f'SELECT t AS "table", c AS "column", ty AS type FROM {_FRAMES}')
def frame_columns(spark, d):
    return metadata.frame_columns(sample(spark, d)).select("table", "column", "type")


# table, name, kind, column, referenced table, referenced column: right ones, and one of each fault.
_CLAIMS = [
    ("orders", "orders_pkey", PRIMARY_KEY, "o_orderkey", "", ""), ("orders", "orders_customer", FOREIGN_KEY, "o_custkey", "customer", "c_custkey"), ("orders", "orders_clerk", FOREIGN_KEY, "o_clerk", "customer", "c_custkey"),
    ("nation", "nation_region", FOREIGN_KEY, "n_regionkey", "region", "r_key"), ("nation", "nation_planet", FOREIGN_KEY, "n_regionkey", "planet", "p_key"), ("part", "part_pkey", PRIMARY_KEY, "p_partkey", "", ""), ("part", "part_other", PRIMARY_KEY, "p_name", "", ""),
    ("supplier", "supplier_name", UNIQUE, "s_name", "", ""), ("supplier", "supplier_name", UNIQUE, "s_acctbal", "", ""),
]


@query(
    f"""WITH f AS {_FRAMES}, k AS (SELECT * FROM {_values(_CLAIMS)} AS v(t, name, kind, c, rt, rc))
    SELECT t AS "table", name AS object, 'unknown column ' || c AS problem FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.t = k.t AND f.c = k.c)
    UNION ALL SELECT t, name, 'unknown table ' || rt FROM k WHERE kind = 'FOREIGN KEY' AND rt NOT IN (SELECT t FROM f)
    UNION ALL SELECT t, name, 'unknown column ' || rt || '.' || rc FROM k WHERE kind = 'FOREIGN KEY' AND rt IN (SELECT t FROM f) AND (rt, rc) NOT IN (SELECT (t, c) FROM f)
    UNION ALL SELECT t, name, 'declared ' || count(*) || ' times' FROM k GROUP BY t, name HAVING count(*) > 1 UNION ALL SELECT t, '', 'several primary keys' FROM k WHERE kind = 'PRIMARY KEY' GROUP BY t HAVING count(*) > 1"""
)
def catalog_problems(spark, d):
    """All faults of declarations about the tables as they are."""
    one = lambda c: F.array(F.col(c))
    claims = spark.createDataFrame(_CLAIMS, "table string, name string, kind string, c string, references_table string, rc string")
    cons = claims.select("table", "name", "kind", one("c").alias("columns"), "references_table", F.when(F.col("rc") == "", F.array().cast("array<string>")).otherwise(one("rc")).alias("references_columns"))
    return metadata.problems(metadata.frame_columns(sample(spark, d)), cons, cons.select("table", "name", "columns").filter(F.lit(False)))


@query(f"SELECT \"table\", name, kind FROM {_CONS} AS t(\"table\", name, kind, cols, rt, rc) WHERE kind IN ('PRIMARY KEY', 'UNIQUE') UNION ALL SELECT \"table\", name, kind FROM {_CONS} AS t(\"table\", name, kind, cols, rt, rc) WHERE FALSE")
def gated_constraints(spark, d):
    """Two kinds of constraints, and none of those not asked for: the branch without kinds is empty."""
    cons = metadata.constraints(spark, OLD)
    return metadata.of_kinds(cons, [PRIMARY_KEY, UNIQUE]).unionByName(metadata.of_kinds(cons, [])).select("table", "name", "kind")


@query("SELECT p_partkey, ((m - 4) >> 16) & 65535 AS \"precision\", (m - 4) & 65535 AS scale, CASE WHEN p_size >= 0 THEN p_size - 4 END AS length FROM (SELECT p_partkey, p_size, p_partkey * 65536 + p_size + 4 AS m FROM part)")
def typmod_parts(spark, d):
    """Type modifiers taken apart by shifts and masks."""
    parts = table(spark, d, "part").select("p_partkey", "p_size", types.typmod_numeric(F.col("p_partkey") * 65536 + F.col("p_size") + 4).alias("n"))
    return parts.select("p_partkey", "n.precision", "n.scale", types.typmod_size(F.col("p_size")).alias("length"))


# --- history: documents are the scripts, labelled ones have run, benchmark items are runs whose scripts are gone

_NAME = "CASE WHEN doc_id % 3 = 0 THEN 'repeatable/' ELSE '' END || doc_id || '.sql'"
_SUM = "sha256(replace(text, chr(13) || chr(10), chr(10)))"
_RUNS = f"""f AS (SELECT {_NAME} AS filename, {_SUM} AS now, doc_id % 3 = 0 AS again FROM documents),
    h AS (SELECT {_NAME} AS filename, CASE WHEN toxic = 1 THEN 'old' ELSE {_SUM} END AS checksum, NOT (quality = 0 AND toxic = 1) AS started, quality = 1 AS success FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 'gone/' || item_id || '.sql', NULL, true, true FROM benchmark),
    p AS (SELECT f.filename, now, again FROM f LEFT JOIN h ON f.filename = h.filename WHERE NOT coalesce(success, false) OR (again AND now IS DISTINCT FROM checksum))"""


def _named(df):
    return df.withColumn("filename", F.concat(F.when(F.col("doc_id") % 3 == 0, "repeatable/").otherwise(""), F.col("doc_id").cast("string"), F.lit(".sql")))


def _scripts(spark, d):
    return _named(table(spark, d, "documents")).select("filename", "text")


def _history(spark, d):
    row = lambda name, checksum, started, success: [name.alias("filename"), checksum.cast("string").alias("checksum"), F.when(started, F.lit("2024-01-01").cast("timestamp")).alias("started_at"), F.lit(5).cast("bigint").alias("time_taken_ns"), success.alias("success")]
    runs = _named(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"))
    done = runs.select(*row(F.col("filename"), F.when(F.col("toxic") == 1, "old").otherwise(history.checksum(F.col("text"))), ~((F.col("quality") == 0) & (F.col("toxic") == 1)), F.col("quality") == 1))
    gone = table(spark, d, "benchmark").select(*row(F.concat(F.lit("gone/"), F.col("item_id").cast("string"), F.lit(".sql")), F.lit(None), F.lit(True), F.lit(True)))
    return done.unionByName(gone)


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS checksum FROM documents")
def sha256_checksum_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", history.checksum(F.col("text")).alias("checksum"))


@query(
    f"""WITH {_RUNS} SELECT coalesce(f.filename, h.filename) AS filename, CASE WHEN f.filename IS NULL THEN 'missing' WHEN h.filename IS NULL OR NOT started THEN 'pending' WHEN NOT success THEN 'failed'
    WHEN again AND now IS DISTINCT FROM checksum THEN 'pending' ELSE 'applied' END AS status FROM f FULL JOIN h ON f.filename = h.filename"""
)
def migration_status(spark, d):
    return history.status(_scripts(spark, d), _history(spark, d))


@query(f"WITH {_RUNS} SELECT filename, now AS checksum FROM p")
def pending_migrations(spark, d):
    return history.pending(_scripts(spark, d), _history(spark, d))


@query(f"WITH {_RUNS} SELECT filename, CASE WHEN again THEN now END AS checksum, true AS success FROM p UNION ALL SELECT filename, checksum, success FROM h WHERE filename NOT IN (SELECT filename FROM p)")
def history_upsert(spark, d):
    """All that is pending counts as applied."""
    files, runs = _scripts(spark, d), _history(spark, d)
    return history.touch(runs, files.join(history.pending(files, runs), "filename", "left_semi")).select("filename", "checksum", "success")


@query(f"WITH {_RUNS} SELECT CASE filename WHEN 'gone/0.sql' THEN 'gone/moved.sql' ELSE filename END AS filename, success FROM h WHERE filename NOT IN ('gone/1.sql', 'nowhere.sql')")
def history_move_and_remove(spark, d):
    return history.remove(history.move(_history(spark, d), "gone/0.sql", "gone/moved.sql"), ["gone/1.sql", "nowhere.sql"]).select("filename", "success")
