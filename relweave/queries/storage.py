"""Published batches, copy-on-write, numbers for new rows and upserts by any key on the sample tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from relweave.catalog import PRIMARY_KEY, Catalog, Column, Constraint, Table, sample_catalog
from relweave.operators import changes, dml
from relweave.queries import query, table
from relweave.sources import files
from relweave.sources.staging import shared_dir, staged
from relweave.sources.store import Store


def _store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


class _Broken(RuntimeError):
    pass


@query(
    """SELECT c.c_custkey, c.c_mktsegment || '!' AS c_mktsegment, count(o_orderkey) AS n_orders, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0)::BIGINT AS n_closed
    FROM customer c LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 <> 0 GROUP BY 1, 2"""
)
def publish_batch(spark, d):
    """Two tables change together; a batch that fails half-way leaves no trace."""
    store = _store(spark)
    with store.batch() as batch:
        batch.put("customer", table(spark, d, "customer"), ["c_custkey"])
        batch.put("orders", table(spark, d, "orders"), ["o_orderkey"])
    with store.batch() as batch:
        batch.put("customer", batch.read("customer").withColumn("c_mktsegment", F.concat("c_mktsegment", F.lit("!"))), ["c_custkey"])
        batch.put("orders", batch.read("orders").filter("o_orderkey % 3 <> 0"), ["o_orderkey"])
    try:
        with store.batch() as batch:
            batch.put("customer", batch.read("customer").limit(0), ["c_custkey"])
            raise _Broken
    except _Broken:
        pass
    orders = store.read("orders").withColumnRenamed("o_custkey", "c_custkey")
    return store.read("customer").join(orders, "c_custkey", "left").groupBy("c_custkey", "c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"), F.coalesce(F.sum((F.col("o_orderstatus") == "F").cast("bigint")), F.lit(0)).alias("n_closed"))


@query(
    """WITH s AS (SELECT c_custkey + 700 AS c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal * 2 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0)
    SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT * FROM s"""
)
def upsert_customer_by_files(spark, d):
    """upsert_customer on a stored table, of which only files with hit keys are written anew."""
    store, customers = _store(spark), table(spark, d, "customer")
    with store.batch() as batch:
        batch.put("customer", customers, ["c_custkey"], files=16)
    sent = customers.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 700).alias("c_custkey"), F.upper("c_name").alias("c_name"), "c_nationkey", (F.col("c_acctbal") * 2).alias("c_acctbal"), "c_mktsegment")
    with store.batch() as batch:
        batch.upsert("customer", sent)
    return store.read("customer")


@query(
    """SELECT s_suppkey, coalesce(k, (SELECT max(c_custkey) FROM customer) + row_number() OVER (PARTITION BY k IS NULL ORDER BY s_nationkey, s_acctbal DESC, s_suppkey)) AS c_custkey
    FROM (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey END AS k FROM supplier)"""
)
def identity_new_rows(spark, d):
    """Suppliers as customers: those without a number get the next ones."""
    suppliers = table(spark, d, "supplier")
    new = suppliers.withColumn("c_custkey", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey")))
    return dml.with_identity(table(spark, d, "customer"), new, "c_custkey", ["s_nationkey", F.col("s_acctbal").desc(), "s_suppkey"]).select("s_suppkey", "c_custkey")


@query(
    """WITH RECURSIVE s AS (
      SELECT row_number() OVER (ORDER BY s_suppkey) AS i, (SELECT max(c_custkey) FROM customer) - 5 + s_suppkey % 37 AS k, CASE WHEN s_suppkey % 7 <> 0 THEN 'Customer#' || lpad((s_suppkey % 23 * 3)::VARCHAR, 9, '0') END AS n, s_acctbal AS v FROM supplier
    ),
    step AS (
      SELECT 0::BIGINT AS i, []::BIGINT[] AS ks, []::VARCHAR[] AS ns, NULL::VARCHAR AS hit, NULL::BIGINT AS k, NULL::VARCHAR AS n, NULL::DOUBLE AS v
      UNION ALL
      SELECT s.i, CASE WHEN h = 'new' THEN list_append(ks, s.k) ELSE ks END, CASE WHEN h = 'new' THEN list_append(ns, coalesce(s.n, '-')) ELSE ns END, h, s.k, s.n, s.v
      FROM (
        SELECT step.ks, step.ns, s.*, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = s.k) OR list_contains(ks, s.k) THEN 'k' WHEN EXISTS (SELECT 1 FROM customer WHERE c_name = s.n) OR list_contains(ns, s.n) THEN 'n' ELSE 'new' END AS h
        FROM step JOIN s ON s.i = step.i + 1
      ) s
    ),
    there AS (SELECT 0 AS i, c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT i, k, n, v FROM step WHERE hit = 'new'),
    found AS (
      SELECT c_custkey, arg_max(u.v, u.i) AS v FROM there t JOIN step u ON u.i > t.i AND ((u.hit = 'k' AND u.k = t.c_custkey) OR (u.hit = 'n' AND u.n = t.c_name)) GROUP BY 1
    )
    SELECT c_custkey, c_name, coalesce(v, c_acctbal) AS c_acctbal FROM there LEFT JOIN found USING (c_custkey)"""
)
def upsert_any_key(spark, d):
    """Suppliers sent as customers whose number or name may be taken, by a customer or by one another."""
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    last = customers.agg(F.max("c_custkey")).scalar()
    k = F.col("s_suppkey")
    name = F.when(k % 7 != 0, F.concat(F.lit("Customer#"), F.lpad((k % 23 * 3).cast("string"), 9, "0")))
    sent = table(spark, d, "supplier").select((last - 5 + k % 37).alias("c_custkey"), name.alias("c_name"), F.col("s_acctbal").alias("c_acctbal"), k.alias("at"))
    order = ["at"]
    return dml.upsert_any_key(customers, sent, [["c_custkey"], ["c_name"]], order)


# --- change feeds and views kept up to date

_AFTER = """customer2 AS (
      SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 17 <> 0
      UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal, NULL FROM supplier
    )"""


def _customers_after(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    k = F.col("c_custkey")
    moved = F.when(k % 11 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")).cast("int")
    kept = c.filter(k % 17 != 0).withColumn("c_nationkey", moved).withColumn("c_acctbal", F.when(k % 13 != 0, F.col("c_acctbal")))
    new = s.select((F.col("s_suppkey") + 1_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return kept.unionByName(new)


@query(
    f"""WITH {_AFTER}
    SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'insert' WHEN a.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS op, b.c_nationkey::VARCHAR AS old_nation, a.c_nationkey::VARCHAR AS new_nation, b.c_acctbal AS old_balance, a.c_acctbal AS new_balance
    FROM customer b FULL JOIN customer2 a ON a.c_custkey = b.c_custkey
    WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_nationkey IS DISTINCT FROM b.c_nationkey OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment OR a.c_name IS DISTINCT FROM b.c_name"""
)
def change_feed_customer(spark, d):
    """Inserted, updated and deleted customers with their old and new images."""
    found = changes.feed(table(spark, d, "customer"), _customers_after(spark, d), ["c_custkey"])
    image = lambda c, age, name: F.col(f"{age}.{c}").alias(name)
    return found.select("c_custkey", "op", image("c_nationkey", "before", "old_nation").cast("string"), image("c_nationkey", "after", "new_nation").cast("string"), image("c_acctbal", "before", "old_balance"), image("c_acctbal", "after", "new_balance"))


@query(
    f"""WITH {_AFTER}
    SELECT a.c_custkey, CASE WHEN b.c_custkey IS NULL OR a.c_nationkey <> b.c_nationkey OR a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN TIMESTAMP '2024-05-01 12:00:00' ELSE TIMESTAMP '2020-01-01' END AS last_update
    FROM customer2 a LEFT JOIN customer b USING (c_custkey)"""
)
def stamp_changed_customers(spark, d):
    """The stamp of a trigger on every inserted or updated row: rows written as they were keep theirs."""
    old = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    before, after = (t.withColumn("last_update", old) for t in (table(spark, d, "customer"), _customers_after(spark, d)))
    return changes.stamped(before, after, ["c_custkey"], "last_update", F.lit("2024-05-01 12:00:00").cast("timestamp_ntz")).select("c_custkey", "last_update")


def _addresses(t):
    return t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "n_nationkey", "c_custkey", "r_name", "n_name", "c_name")


_NATIONS = "nation2 AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_nationkey = 4 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 6)"


@query(f"WITH {_AFTER}, {_NATIONS} SELECT r_regionkey, n_nationkey, c_custkey, r_name, n_name, c_name FROM customer2 JOIN nation2 ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def refresh_full_address(spark, d):
    """The stored view full_address after customers and nations changed, by its own changes alone, file by file."""
    before = {n: table(spark, d, n) for n in ("customer", "nation", "region")}
    k = F.col("n_nationkey")
    nations = before["nation"].filter(k != 6).withColumn("n_name", F.when(k % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name"))).withColumn("n_regionkey", F.when(k == 4, 0).otherwise(F.col("n_regionkey")).cast("int"))
    store = _store(spark)
    with store.batch() as batch:
        batch.put("full_address", _addresses(before), ["c_custkey"], files=16)
    made = {"customer": changes.feed(before["customer"], _customers_after(spark, d), ["c_custkey"]), "nation": changes.feed(before["nation"], nations, ["n_nationkey"])}
    changed = staged(changes.view_changes(_addresses, before, {n: staged(c, "feed") for n, c in made.items()}), "view")
    with store.batch() as batch:
        batch.delete("full_address", changed.filter("n < 0"))
        batch.upsert("full_address", changed.filter("n > 0").drop("n"))
    return store.read("full_address")


@query(f"WITH {_AFTER} SELECT c_mktsegment, c_nationkey FROM customer2 WHERE c_nationkey < 20")
def refresh_without_key(spark, d):
    """A stored view whose rows repeat: changes are counted."""
    view = lambda t: t["customer"].filter("c_nationkey < 20").select("c_mktsegment", "c_nationkey")
    before = {"customer": table(spark, d, "customer")}
    stored = staged(view(before), "view")
    change = changes.feed(before["customer"], _customers_after(spark, d), ["c_custkey"])
    return changes.refreshed(stored, changes.view_changes(view, before, {"customer": change}))


# --- CSV: dumped and loaded, and one file cut into ranges


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, date_trunc('second', o_orderdate) AS o_orderdate, o_orderpriority, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def dump_and_load(spark, d):
    """Two tables written as CSV side by side, in the order of their keys, and read back."""
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    catalog = Catalog("two", [t for t in sample_catalog().tables if t.name in ("customer", "orders")])
    files.dump({n: table(spark, d, n) for n in ("customer", "orders")}, catalog, path)
    _, t = files.load(spark, path)
    return t["orders"].join(t["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_name")


_LINES = "SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'said \"' || l_returnflag || '\",' || chr(10) || chr(10) || 'then \"\"' || chr(10) WHEN 2 THEN '' ELSE 'plain, ' || l_linestatus END AS note, count(*) AS n_rows FROM lineitem GROUP BY ALL"


@query(_LINES)
def csv_one_file_in_ranges(spark, d):
    """Lines in one file, with line ends and quotes in a field, read range by range."""
    from pyspark.sql import types as T

    n = F.col("l_linenumber") % 4
    note = F.when(n == 1, F.concat(F.lit('said "'), "l_returnflag", F.lit('",\n\nthen ""\n'))).when(n == 2, "").when(n == 3, F.concat(F.lit("plain, "), "l_linestatus"))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}.csv"
    files.write_csv_file(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", note.alias("note")), path)
    fields = [("l_orderkey", T.LongType()), ("l_linenumber", T.IntegerType()), ("l_quantity", T.DoubleType()), ("note", T.StringType())]
    return files.read_csv(spark, path, fields, split=True).groupBy("l_orderkey", "l_linenumber", "l_quantity", "note").agg(F.count("*").alias("n_rows"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'third' WHEN p_partkey % 3 = 0 THEN 'second' ELSE p_name END AS p_name FROM part")
def csv_last_row_of_a_key(spark, d):
    """Three files of one table: of rows with one key the last stays."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    again = lambda k, name: parts.filter(F.col("p_partkey") % k == 0).withColumn("p_name", F.lit(name))
    files.write_csv(parts.unionByName(again(3, "second")).coalesce(1), f"{folder}/01_part.csv")
    files.write_csv(again(5, "third"), f"{folder}/02_part.csv")
    slim = Catalog("slim", [Table("part", [Column("p_partkey", "BIGINT"), Column("p_name", "TEXT")], [Constraint(PRIMARY_KEY, ["p_partkey"])])])
    return files.load_folder(spark, folder, slim)["part"]
