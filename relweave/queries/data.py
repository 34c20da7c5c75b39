"""Scans, subsets, DML and integrity checks on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog import CHECK, FOREIGN_KEY, PRIMARY_KEY, Catalog, Column, Constraint, Table, sample_catalog
from relweave.functions import codec
from relweave.operators import dml, integrity, subset
from relweave.queries import query, sample, table
from relweave.sources import files

CATALOG = sample_catalog()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey")
def table_scan_pk_order(spark, d):
    return files.scan(table(spark, d, "nation"), CATALOG.table("nation"))


# --- subsets: ten first orders upstream, some nations extended

_TOP = "o AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c))"


def _upstream(name):
    def run(spark, d):
        tables = sample(spark, d)
        _, rows = subset.seed(spark, "SELECT {*} FROM {orders} ORDER BY o_orderkey LIMIT 10", tables, CATALOG)
        return subset.subset(tables, CATALOG, {"orders": rows})[name]

    return run


for _name, _sql in {
    "orders": f"WITH {_TOP} SELECT * FROM o",
    "customer": f"WITH {_TOP} SELECT * FROM c",
    "nation": f"WITH {_TOP} SELECT * FROM n",
    "region": f"WITH {_TOP} SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)",
}.items():
    query(_sql, f"subset_orders__{_name}")(_upstream(_name))


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey <= 20) OR c_custkey IN (SELECT user_id FROM events WHERE event_id < 15)")
def subset_multi__customer(spark, d):
    tables = sample(spark, d)
    seeds = {"orders": tables["orders"].filter("o_orderkey <= 20"), "events": tables["events"].filter("event_id < 15")}
    return subset.subset(tables, CATALOG, seeds)["customer"]


_EXTENDED = """WITH n0 AS (SELECT * FROM nation WHERE n_nationkey < 1),
c0 AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n0)), s0 AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n0)),
o0 AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c0)), e AS (SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM c0)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o0) OR l_suppkey IN (SELECT s_suppkey FROM s0)),
o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM o0) OR o_orderkey IN (SELECT l_orderkey FROM l)),
s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM s0) OR s_suppkey IN (SELECT l_suppkey FROM l)),
p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)),
c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT c_custkey FROM c0) OR c_custkey IN (SELECT o_custkey FROM o) OR c_custkey IN (SELECT user_id FROM e)),
n AS (SELECT * FROM nation WHERE n_nationkey < 1 OR n_nationkey IN (SELECT c_nationkey FROM c) OR n_nationkey IN (SELECT s_nationkey FROM s)),
r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)) SELECT * FROM """


def _extended(name):
    def run(spark, d):
        tables = sample(spark, d)
        return subset.subset(tables, CATALOG, {"nation": tables["nation"].filter("n_nationkey < 1")}, extended=True)[name]

    return run


for _name, _cte in {"nation": "n", "customer": "c", "supplier": "s", "orders": "o", "lineitem": "l", "events": "e", "part": "p", "region": "r"}.items():
    query(_EXTENDED + _cte, f"extended_subset_nation__{_name}")(_extended(_name))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 1000 <= 700 AND (o_orderkey - o_orderkey % 1000 + 700) IN (SELECT o_orderkey FROM orders)")
def subset_chain_orders(spark, d):
    """Chains of a thousand orders, each after another: all that lead up to some, in ten rounds."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(k, F.when(k % 1000 != 0, k - 1).alias("o_before"), "o_custkey")
    chain = Table("orders", [Column("o_orderkey", "BIGINT"), Column("o_before", "BIGINT"), Column("o_custkey", "BIGINT")], [Constraint(PRIMARY_KEY, ["o_orderkey"]), Constraint(FOREIGN_KEY, ["o_before"], references_table="orders", references_columns=["o_orderkey"])])
    return subset.subset({"orders": orders}, Catalog("chains", [chain]), {"orders": orders.filter(k % 1000 == 700)})["orders"].drop("o_before")


# --- DML

@query(
    """WITH s AS (SELECT c_custkey + 700 AS c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal * 2 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0)
    SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT * FROM s"""
)
def upsert_customer(spark, d):
    customers = table(spark, d, "customer")
    sent = customers.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 700).alias("c_custkey"), F.upper("c_name").alias("c_name"), "c_nationkey", (F.col("c_acctbal") * 2).alias("c_acctbal"), "c_mktsegment")
    return dml.upsert(customers, sent, ["c_custkey"])


@query(
    """WITH e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id)
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN user_id IS NULL THEN c_mktsegment ELSE t END AS c_mktsegment FROM customer LEFT JOIN e ON user_id = c_custkey"""
)
def upsert_partial_columns(spark, d):
    """A customer's last event becomes its segment: of several rows of a key the last wins, columns not sent keep their values."""
    events = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), F.struct("ts", "event_id").alias("at"))
    customers = table(spark, d, "customer")
    return dml.update_from(customers, dml.latest(events, ["c_custkey"], "at").drop("at"), ["c_custkey"])


@query(
    """WITH s AS (SELECT p_partkey + 1000 AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part)
    SELECT * FROM part UNION ALL SELECT * FROM s WHERE p_partkey NOT IN (SELECT p_partkey FROM part)"""
)
def insert_if_absent_part(spark, d):
    parts = table(spark, d, "part")
    return dml.insert_if_absent(parts, parts.withColumn("p_partkey", F.col("p_partkey") + 1000), ["p_partkey"])


@query("SELECT * FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def delete_in_list(spark, d):
    return dml.delete_in(table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT CASE WHEN r_regionkey = 2 THEN 12 ELSE r_regionkey END AS r_regionkey, r_name FROM region")
def rename_key(spark, d):
    return dml.rename_key(table(spark, d, "region"), "r_regionkey", 2, 12)


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def copy_common_columns(spark, d):
    return dml.copy_common(table(spark, d, "supplier"), ["s_suppkey", "s_phone", "s_acctbal"])


# --- integrity

@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_duplicates_lineitem(spark, d):
    return integrity.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders) WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)")
def fk_orphans_orders(spark, d):
    broken = F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_custkey")).when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_custkey"))
    orders = table(spark, d, "orders").select("o_orderkey", broken.alias("o_custkey"))
    return integrity.orphans(orders, ["o_custkey"], table(spark, d, "customer"), ["c_custkey"])


@query("SELECT 'o_orderstatus' AS \"column\", count(*) AS n_rows FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'o_orderdate', count(*) FROM orders WHERE o_orderkey % 5 = 0")
def not_null_violations(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("o_orderdate"))
    return integrity.nulls(orders, orders.columns)


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE NOT (l_quantity <= 45 OR l_discount < 0.02)")
def check_violations(spark, d):
    return integrity.check_failures(table(spark, d, "lineitem"), "l_quantity <= 45 OR l_discount < 0.02").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT c_name, c_mktsegment, count(*) AS n_rows FROM (SELECT 'n' || (c_custkey % 400)::VARCHAR AS c_name, c_mktsegment FROM customer) GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    named = table(spark, d, "customer").select(F.concat(F.lit("n"), (F.col("c_custkey") % 400).cast("string")).alias("c_name"), "c_mktsegment")
    return integrity.duplicates(named, ["c_name", "c_mktsegment"])


@query(
    """SELECT 'lineitem' AS "table", 'lineitem_l_quantity_check' AS "constraint", 'CHECK' AS kind, count(*) AS n_rows FROM lineitem WHERE l_quantity > 40
    UNION ALL SELECT 'orders', 'orders_o_custkey_fkey', 'FOREIGN KEY', count(*) FROM orders WHERE o_custkey % 3 = 0"""
)
def validate_catalog(spark, d):
    """All declared rules at once, with customers missing and a check that some rows break."""
    tables = sample(spark, d)
    tables["customer"] = tables["customer"].filter("c_custkey % 3 <> 0")
    catalog = sample_catalog()
    catalog.table("lineitem").constraints.append(Constraint(CHECK, ["l_quantity"], "lineitem_l_quantity_check", check="l_quantity <= 40"))
    found = integrity.validate({n: tables[n] for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}, catalog)
    return found


# --- codec

@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders")
def csv_encode_orders(spark, d):
    return files.encoded(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"))


@query(
    r"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '\N' WHEN event_id % 4 = 1 THEN '' ELSE event_type END AS text,
    CASE WHEN event_id % 3 = 0 THEN '1' WHEN event_id % 3 = 1 THEN '0' ELSE '\N' END AS flag, CASE WHEN event_id % 5 = 0 THEN '\N' ELSE '0x' || lower(hex(event_type)) END AS bytes, '[' || event_id || ',null]' AS list FROM events"""
)
def csv_encode_nulls(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    text = F.when(i % 4 == 1, F.lit("")).when(i % 4 != 0, F.col("event_type"))
    flag = F.when(i % 3 == 0, True).when(i % 3 == 1, False)
    raw = F.when(i % 5 == 0, F.lit("")).otherwise(F.col("event_type")).cast("binary")
    made = e.select("event_id", text.alias("text"), flag.alias("flag"), raw.alias("bytes"), F.array(i, F.lit(None).cast("bigint")).alias("list"))
    return made.select("event_id", *[codec.encode(F.col(c), made.schema[c].dataType).alias(c) for c in ("text", "flag", "bytes", "list")])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s, o_totalprice AS p, date_trunc('second', o_orderdate) AS t FROM orders")
def csv_decode_orders(spark, d):
    """Encoded fields read back by type."""
    from pyspark.sql import types as T

    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("s"), F.col("o_totalprice").alias("p"), F.col("o_orderdate").alias("t"))
    kinds = {"o_orderkey": T.LongType(), "s": T.StringType(), "p": T.DoubleType(), "t": T.TimestampNTZType()}
    return files.encoded(o).select(*[codec.decode(F.col(c), k).alias(c) for c, k in kinds.items()])


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 4 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def parse_timestamp_formats(spark, d):
    ts, k = F.col("ts"), F.col("event_id") % 6
    full = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    text = F.when(k == 0, full).when(k == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm")).when(k == 2, F.date_format(ts, "yyyy-MM-dd")).when(k == 3, F.concat(full, F.lit(".000+02:00"))).when(k == 4, F.lit("")).otherwise(F.concat(F.replace(full, F.lit(" "), F.lit("T")), F.lit("Z")))
    return table(spark, d, "events").select("event_id", codec.parse_timestamp(text).alias("at"))


@query("SELECT event_id, date_trunc('second', ts) AS s, date_trunc('millisecond', ts) AS ms FROM events")
def epoch_timestamps(spark, d):
    unix = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    return table(spark, d, "events").select("event_id", codec.epoch_timestamp(F.floor(unix / 1_000_000)).alias("s"), codec.epoch_timestamp(F.floor(unix / 1000)).alias("ms"))


@query("SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS uuid FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)")
def uuid_from_hex(spark, d):
    return table(spark, d, "customer").select("c_custkey", codec.uuid_from_bytes(F.unhex(F.md5("c_name"))).alias("uuid"))


@query("SELECT o_orderkey, o_custkey + 1 AS second FROM orders")
def json_array_roundtrip(spark, d):
    from pyspark.sql import types as T

    kind = T.ArrayType(T.LongType())
    text = codec.encode(F.array("o_custkey", F.col("o_custkey") + 1), kind)
    return table(spark, d, "orders").select("o_orderkey", codec.decode(text, kind)[1].alias("second"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%E%' AND p_name NOT LIKE '%1_' AND p_brand LIKE 'Brand#_%'")
def like_filters(spark, d):
    return table(spark, d, "part").filter(F.col("p_type").like("%E%") & ~F.col("p_name").like("%1_") & F.col("p_brand").like("Brand#_%")).select("p_partkey", "p_type")
