"""Exclusion constraints and referential actions on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.catalog import CASCADE, EXCLUDE, NO_ACTION, RESTRICT, SET_DEFAULT, SET_NULL, Catalog, Column, Constraint, Table, sample_catalog
from relweave.functions import collation
from relweave.operators import actions, dml, exclusion, integrity
from relweave.queries import query, sample, table

# --- exclusion: an order is open from its date for some days; every fiftieth has no end

_SPANS = "s AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_orderdate AS starts, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate + to_days((o_orderkey % 40)::INTEGER) END AS ends FROM orders)"
_MEET = "a.o_orderkey <> b.o_orderkey AND a.starts < coalesce(b.ends, TIMESTAMP '9999-01-01') AND b.starts < coalesce(a.ends, TIMESTAMP '9999-01-01') AND (b.ends IS NULL OR b.starts < b.ends) AND (a.ends IS NULL OR a.starts < a.ends)"


def _spans(spark, d):
    o = table(spark, d, "orders")
    ends = F.when(F.col("o_orderkey") % 50 != 0, F.timestamp_add("DAY", (F.col("o_orderkey") % 40).cast("int"), F.col("o_orderdate")))
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_orderdate").alias("starts"), ends.alias("ends"))


@query(f"WITH {_SPANS} SELECT * FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE a.o_custkey = b.o_custkey AND {_MEET})")
def exclusion_overlapping_orders(spark, d):
    """Orders of one customer that are open at the same time."""
    return exclusion.overlaps(_spans(spark, d), ["o_custkey"], "starts", "ends").drop("overlaps_earlier", "overlaps_later")


_SHORT = "s AS (SELECT o_orderkey, o_orderpriority, o_orderdate AS starts, o_orderdate + to_minutes((o_orderkey % 3 * 20)::INTEGER) AS ends FROM orders)"


@query(f"WITH {_SHORT} SELECT * FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE a.o_orderpriority = b.o_orderpriority AND {_MEET})")
def exclusion_few_keys(spark, d):
    """Short spans under five keys, so that bands are what shares the work."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_orderdate").alias("starts"), F.timestamp_add("MINUTE", (F.col("o_orderkey") % 3 * 20).cast("int"), F.col("o_orderdate")).alias("ends"))
    return exclusion.overlaps(o, ["o_orderpriority"], "starts", "ends").drop("overlaps_earlier", "overlaps_later")


@query(
    f"""WITH {_SPANS}
    SELECT 'orders' AS "table", 'orders_open_excl' AS "constraint", 'EXCLUDE' AS kind, count(*) AS n_rows FROM s a WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM s b WHERE b.o_orderstatus = 'O' AND a.o_custkey = b.o_custkey AND {_MEET})
    UNION ALL SELECT 'orders', 'orders_urgent_excl', 'EXCLUDE', count(*) FROM (SELECT count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM s WHERE o_orderpriority = '1-URGENT') WHERE n > 1"""
)
def validate_exclusions(spark, d):
    """Two exclusion constraints with predicates, among the rules of a catalog."""
    columns = [Column(c, "TEXT") for c in ("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "starts", "ends")]
    rules = [
        Constraint(EXCLUDE, ["o_custkey", "starts", "ends"], "orders_open_excl", operators=["=", "&&", "&&"], predicate="o_orderstatus = 'O'"),
        Constraint(EXCLUDE, ["o_custkey", "o_orderstatus"], "orders_urgent_excl", operators=["=", "="], predicate="o_orderpriority = '1-URGENT'"),
    ]
    return integrity.validate({"orders": _spans(spark, d)}, Catalog("open", [Table("orders", columns, rules)]))


# --- referential actions


def _ruled(on: str, **rules: str) -> Catalog:
    """The sample catalog with rules by foreign-key column."""
    catalog = sample_catalog()
    for t in catalog.tables:
        for c in t.constraints:
            if c.columns[0] in rules and c.references_table:
                setattr(c, f"{on}_rule", rules[c.columns[0]])
    return catalog


_GONE = "n_nationkey % 5 = 2"
_DELETED = f"""WITH gone AS (SELECT n_nationkey FROM nation WHERE {_GONE}), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM gone)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) """


def _deleted(name):
    def run(spark, d):
        tables = sample(spark, d)
        catalog = _ruled("delete", c_nationkey=CASCADE, s_nationkey=SET_NULL, o_custkey=CASCADE, l_orderkey=CASCADE, user_id=SET_NULL)
        left = actions.delete(tables, catalog, {"nation": tables["nation"].filter(_GONE)}).tables[name]
        # As text, in which a number and none don't depend on how a reader holds nullable integers.
        return left.select(*[F.col(c).cast("string").alias(c) if c in ("s_nationkey", "user_id") else c for c in left.columns])

    return run


for _name, _sql in {
    "nation": f"SELECT * FROM nation WHERE NOT ({_GONE})",
    "customer": "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c)",
    "supplier": "SELECT * REPLACE (CASE WHEN s_nationkey NOT IN (SELECT n_nationkey FROM gone) THEN s_nationkey::VARCHAR END AS s_nationkey) FROM supplier",
    "orders": "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c)",
    "lineitem": "SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)",
    "events": "SELECT * REPLACE (CASE WHEN user_id NOT IN (SELECT c_custkey FROM c) THEN user_id::VARCHAR END AS user_id) FROM events",
}.items():
    query(_DELETED + _sql, f"delete_nations__{_name}")(_deleted(_name))


@query(
    _DELETED
    + """SELECT 'events' AS "table", 'events_user_id_fkey' AS "constraint", 'RESTRICT' AS rule, '{"event_id":' || event_id || '}' AS "row" FROM events WHERE user_id IN (SELECT c_custkey FROM c)
    UNION ALL SELECT 'supplier', 'supplier_s_nationkey_fkey', 'NO ACTION', '{"s_suppkey":' || s_suppkey || '}' FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM gone)"""
)
def delete_nations_blocked(spark, d):
    """The rows that forbid it, where events restrict and suppliers take no action."""
    tables = sample(spark, d)
    catalog = _ruled("delete", c_nationkey=CASCADE, s_nationkey=NO_ACTION, o_custkey=CASCADE, l_orderkey=CASCADE, user_id=RESTRICT)
    return actions.delete(tables, catalog, {"nation": tables["nation"].filter(_GONE)}).blocked


_MOVED = "CASE WHEN {0} % 4 = 0 THEN {0} + 1 WHEN {0} % 4 = 1 THEN {0} - 1 WHEN {0} % 4 = 2 THEN {0} + 1000 ELSE {0} END::INTEGER"


def _renumbered(name):
    def run(spark, d):
        tables = sample(spark, d)
        catalog = _ruled("update", c_nationkey=CASCADE, s_nationkey=SET_DEFAULT)
        next(c for c in catalog.table("supplier").columns if c.name == "s_nationkey").default = "7"
        k = F.col("n_nationkey")
        new = F.when(k % 4 == 0, k + 1).when(k % 4 == 1, k - 1).when(k % 4 == 2, k + 1000)
        moved = tables["nation"].select(k.alias("old_n_nationkey"), new.cast("int").alias("new_n_nationkey")).filter("new_n_nationkey IS NOT NULL AND old_n_nationkey <> 24")
        out = actions.update_key(tables, catalog, "nation", moved)
        return out.blocked if name == "blocked" else out.tables[name]

    return run


for _name, _sql in {
    "nation": f"SELECT * REPLACE (CASE WHEN n_nationkey = 24 THEN 24 ELSE {_MOVED.format('n_nationkey')} END AS n_nationkey) FROM nation",
    "customer": f"SELECT * REPLACE (CASE WHEN c_nationkey = 24 THEN 24 ELSE {_MOVED.format('c_nationkey')} END AS c_nationkey) FROM customer",
    "supplier": "SELECT * REPLACE (CASE WHEN s_nationkey % 4 = 3 OR s_nationkey = 24 THEN s_nationkey ELSE 7 END AS s_nationkey) FROM supplier",
}.items():
    query(_sql, f"renumber_nations__{_name}")(_renumbered(_name))


# --- keys under collations

_NAMES = "p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN lower(p_name) ELSE p_name END AS p_name FROM (SELECT p_partkey, p_brand || ' ' || (p_partkey % 700) AS p_name FROM part))"
_PARTS = Table("part", [Column("p_partkey", "BIGINT"), Column("p_name", "TEXT", collation="utf8mb4_0900_as_ci")], [Constraint("UNIQUE", ["p_name"])])


def _spelt(spark, d):
    k, name = F.col("p_partkey"), F.concat_ws(" ", "p_brand", (F.col("p_partkey") % 700).cast("string"))
    return table(spark, d, "part").select(k, F.when(k % 3 == 0, F.upper(name)).when(k % 3 == 1, F.lower(name)).otherwise(name).alias("p_name"))


@query(f"WITH {_NAMES} SELECT lower(p_name) AS p_name, count(*) AS n_rows FROM p GROUP BY 1 HAVING count(*) > 1")
def collated_duplicates(spark, d):
    """Part names that a case-blind collation takes for one."""
    found = integrity.duplicates(collation.collated(_spelt(spark, d), _PARTS), ["p_name"])
    return collation.plain(found).select(F.lower("p_name").alias("p_name"), "n_rows")


@query(
    f"""WITH {_NAMES}, s AS (SELECT max(p_partkey) AS p_partkey, upper(p_name) AS p_name FROM p WHERE p_partkey % 4 = 0 GROUP BY 2)
    SELECT p_partkey, p_name FROM p WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM s) UNION ALL SELECT p_partkey, p_name FROM s"""
)
def collated_upsert(spark, d):
    """Parts sent by name: a name in any spelling replaces the rows of that name, in the spelling of the last row sent."""
    parts = _spelt(spark, d)
    sent = parts.filter("p_partkey % 4 = 0").withColumn("p_name", F.upper("p_name"))
    return collation.plain(dml.upsert(collation.collated(parts, _PARTS), collation.collated(sent, _PARTS), ["p_name"]))


@query(
    f"""WITH {_NAMES} SELECT * FROM (
    SELECT 'part' AS "table", 'part_p_name_key' AS "constraint", 'UNIQUE' AS kind, sum(n)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM p GROUP BY lower(p_name)) WHERE n > 1
    UNION ALL SELECT 'offer', 'offer_o_part_fkey', 'FOREIGN KEY', count(*) FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'no ' || p_name ELSE upper(p_name) END AS o_part FROM p) WHERE lower(o_part) NOT IN (SELECT lower(p_name) FROM p)) WHERE n_rows > 0"""
)
def validate_collated(spark, d):
    """A unique and a foreign key of case-blind names."""
    parts = _spelt(spark, d)
    offers = parts.select(F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("no "), "p_name")).otherwise(F.upper("p_name")).alias("o_part"))
    fk = Constraint("FOREIGN KEY", ["o_part"], references_table="part", references_columns=["p_name"])
    return integrity.validate({"part": parts, "offer": offers}, Catalog("names", [_PARTS, Table("offer", [Column("o_part", "TEXT")], [fk])]))
