"""Reporting shapes on the sample tables: stars, lists per group, balances, rewards, stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.queries import query, sample, table


@query(
    """SELECT r_name AS region, n.n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_sales, count(*) AS n_lines
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN region ON r_regionkey = n.n_regionkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation m ON m.n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey WHERE m.n_name <> n.n_name GROUP BY 1, 2"""
)
def sales_by_nation(spark, d):
    t = sample(spark, d)
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    sellers = t["supplier"].join(t["nation"].select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation")), "s_nationkey").select("s_suppkey", "s_nation")
    buyers = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
    sold = (
        lines.join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["part"].select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        .filter("s_nation <> n_name")
    )
    return sold.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("total_sales"), F.count("*").alias("n_lines"))


@query("SELECT p_brand AS category, round(sum(l_extendedprice), 2) AS total_sales FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def sales_by_brand(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice")
    return lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("category")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total_sales"))


@query("SELECT c_custkey AS id, c_name || ' (' || n_name || ')' AS name, r_name AS region, CASE WHEN c_acctbal > 0 THEN 'active' ELSE '' END AS notes FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def customer_list(spark, d):
    t = sample(spark, d)
    full = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return full.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" ("), "n_name", F.lit(")")).alias("name"), F.col("r_name").alias("region"), F.when(F.col("c_acctbal") > 0, "active").otherwise("").alias("notes"))


@query("SELECT s_suppkey AS id, s_name AS name, n_name AS nation, r_name AS region, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def supplier_list(spark, d):
    t = sample(spark, d)
    full = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return full.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "s_acctbal")


@query("SELECT r_regionkey, n_nationkey, c_custkey, r_name, n_name, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def full_address(spark, d):
    """A materialised view elsewhere: write it out and write it anew when its tables change."""
    t = sample(spark, d)
    return t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "n_nationkey", "c_custkey", "r_name", "n_name", "c_name")


@query(
    """SELECT p_partkey AS fid, p_name AS title, p_retailprice AS price, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS suppliers
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3"""
)
def part_supplier_list(spark, d):
    """A left join that the inner join after it narrows again; each part's suppliers once, in order."""
    t = sample(spark, d)
    lines = t["lineitem"].select("l_partkey", "l_suppkey")
    full = t["part"].join(lines, F.col("l_partkey") == F.col("p_partkey"), "left").join(t["supplier"].select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    pairs = full.groupBy("p_partkey", "p_name", "p_retailprice").agg(F.array_join(F.array_sort(F.collect_set("s_name")), ", ").alias("suppliers"))
    return pairs.select(F.col("p_partkey").alias("fid"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), "suppliers")


@query(
    """WITH b AS (SELECT o_custkey, p_brand, '[' || string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) || ']' AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT c_custkey, '{' || coalesce(string_agg('"' || p_brand || '":' || lines, ',' ORDER BY p_brand), '') || '}' AS info FROM customer LEFT JOIN b ON o_custkey = c_custkey GROUP BY 1"""
)
def customer_brand_json(spark, d):
    """Per customer a JSON object of brands, in order, each with an array of its line numbers."""
    t = sample(spark, d)
    bought = t["orders"].select("o_orderkey", "o_custkey").join(t["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey")).join(t["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lists = bought.groupBy(F.col("o_custkey").alias("c_custkey"), "p_brand").agg(F.array_sort(F.collect_set("l_linenumber")).alias("lines"))
    info = lists.groupBy("c_custkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_brand", "lines"))))).alias("info"))
    return t["customer"].select("c_custkey").join(info, "c_custkey", "left").select("c_custkey", F.coalesce("info", F.lit("{}")).alias("info"))


@query(
    """SELECT p_partkey AS fid, '[' || string_agg('{"name":"' || s_name || '","key":' || s_suppkey || '}', ',' ORDER BY s_name, s_suppkey) || ']' AS suppliers
    FROM part JOIN (SELECT DISTINCT l_partkey, s_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) ON l_partkey = p_partkey GROUP BY 1"""
)
def part_supplier_json(spark, d):
    """Per part a JSON array of its suppliers, ordered by name."""
    t = sample(spark, d)
    sold = t["lineitem"].select("l_partkey", "l_suppkey").distinct().join(t["supplier"].select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    each = F.array_sort(F.collect_list(F.struct(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))))
    return t["part"].select("p_partkey").join(sold, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_partkey").alias("fid")).agg(F.to_json(each).alias("suppliers"))


@query(
    """SELECT p_partkey AS fid, '[' || string_agg('"' || nice || '"', ',' ORDER BY nice) || ']' AS suppliers FROM part JOIN (SELECT DISTINCT l_partkey, upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2)) || ' (' || n_name || ')' AS nice
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) ON l_partkey = p_partkey GROUP BY 1"""
)
def nicer_part_supplier_json(spark, d):
    """Per part a JSON array of its suppliers' names in one spelling, with their nations."""
    t = sample(spark, d)
    sellers = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    nice = F.concat(F.upper(F.substring("s_name", 1, 1)), F.lower(F.expr("substring(s_name, 2)")), F.lit(" ("), "n_name", F.lit(")"))
    sold = t["lineitem"].select("l_partkey", "l_suppkey").distinct().join(sellers.select("s_suppkey", nice.alias("nice")), F.col("s_suppkey") == F.col("l_suppkey"))
    names = sold.groupBy(F.col("l_partkey").alias("fid")).agg(F.to_json(F.array_sort(F.collect_set("nice"))).alias("suppliers"))
    return names.join(t["part"].select(F.col("p_partkey").alias("fid")), "fid", "left_semi")


@query("SELECT s_suppkey, upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2)) AS name FROM supplier")
def nicer_names(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.upper(F.substring("s_name", 1, 1)), F.lower(F.expr("substring(s_name, 2)"))).alias("name"))


@query(
    """WITH b AS (SELECT c_custkey, p_brand, string_agg(DISTINCT l_linenumber::VARCHAR, '+' ORDER BY l_linenumber::VARCHAR) AS parts FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
    SELECT customer.c_custkey, coalesce(string_agg(p_brand || ':' || parts, ';' ORDER BY p_brand), '') AS info FROM customer LEFT JOIN b ON b.c_custkey = customer.c_custkey GROUP BY 1"""
)
def customer_brand_info(spark, d):
    """Per customer the line numbers of each brand: the inner lists are aggregated first, not asked for row by row."""
    t = sample(spark, d)
    bought = t["orders"].select("o_orderkey", "o_custkey").join(t["lineitem"].select("l_orderkey", "l_partkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey")).join(t["part"].select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lists = bought.groupBy(F.col("o_custkey").alias("c_custkey"), "p_brand").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), "+").alias("parts"))
    info = lists.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", "parts"))), lambda x: F.concat(x["p_brand"], F.lit(":"), x["parts"])), ";").alias("info"))
    return t["customer"].select("c_custkey").join(info, "c_custkey", "left").select("c_custkey", F.coalesce("info", F.lit("")).alias("info"))


@query(
    """WITH m AS (SELECT date_trunc('month', max(o_orderdate)) AS last FROM orders), p AS (
      SELECT o_custkey FROM orders, m WHERE o_orderdate::DATE BETWEEN (last - INTERVAL 12 MONTH)::DATE AND (last - INTERVAL 1 DAY)::DATE GROUP BY 1 HAVING sum(o_totalprice) > 100000 AND count(*) > 1)
    SELECT customer.* FROM customer JOIN p ON o_custkey = c_custkey"""
)
def rewards_report(spark, d):
    """Customers who bought often and much in the twelve full months before the last order's month."""
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    last = orders.agg(F.date_trunc("month", F.max("o_orderdate"))).scalar()
    bought = orders.filter(F.to_date("o_orderdate").between(F.add_months(last, -12), F.date_sub(last, 1)))
    rich = bought.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n")).filter("spent > 100000 AND n > 1")
    return table(spark, d, "customer").join(rich, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query(
    """WITH fees AS (SELECT o_custkey AS k, sum(l_extendedprice) AS fee, sum(CASE WHEN epoch(l_shipdate) - epoch(o_orderdate) > 30 * 86400 THEN (epoch(l_shipdate) - epoch(o_orderdate) - 30 * 86400)::BIGINT // 86400 ELSE 0 END)::BIGINT AS late
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1),
    paid AS (SELECT o_custkey AS k, sum(o_totalprice) AS paid FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1)
    SELECT c_custkey, round(coalesce(fee, 0), 2) AS fees, coalesce(late, 0) AS late_days, round(coalesce(fee, 0) + coalesce(late, 0) - coalesce(paid, 0), 2) AS balance
    FROM customer LEFT JOIN fees ON fees.k = c_custkey LEFT JOIN paid ON paid.k = c_custkey"""
)
def customer_balance(spark, d):
    """Fees, a unit for each whole day past thirty, less payments, all before a date; zero without any."""
    t = sample(spark, d)
    before = t["orders"].filter("o_orderdate <= TIMESTAMP_NTZ '1997-01-01 00:00:00'").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    # Between clock times without a zone: no session's daylight saving takes part.
    over = F.timestamp_diff("MICROSECOND", F.col("o_orderdate"), F.col("l_shipdate")) - 30 * 86_400_000_000
    lines = before.join(t["lineitem"].select("l_orderkey", "l_extendedprice", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    fees = lines.groupBy("o_custkey").agg(F.sum("l_extendedprice").alias("fee"), F.sum(F.when(over > 0, F.floor(over / 86_400_000_000)).otherwise(0)).alias("late"))
    paid = before.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("paid"))
    both = t["customer"].select("c_custkey").join(fees.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").join(paid.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").na.fill(0)
    return both.select("c_custkey", F.round("fee", 2).alias("fees"), F.col("late").alias("late_days"), F.round(F.col("fee") + F.col("late") - F.col("paid"), 2).alias("balance"))


@query("SELECT l_orderkey, l_linenumber, o_custkey AS holder FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' AND l_returnflag = 'N'")
def held_by_customer(spark, d):
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'O' AND l_returnflag = 'N'").select("l_orderkey", "l_linenumber")
    return lines.join(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("holder")), F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", "holder")


def _stock(spark, d):
    """Per part, whether none of its lines is still out, open and shipped in the last 30 days: parts without lines are in stock."""
    shipped = table(spark, d, "lineitem").select("l_partkey", "l_linestatus", "l_shipdate")
    last = shipped.agg(F.max("l_shipdate")).scalar()
    out = (F.col("l_linestatus") == "O") & (F.col("l_shipdate") > last - F.expr("INTERVAL 30 DAYS"))
    lines = shipped.groupBy("l_partkey").agg(F.count(F.when(out, 1)).alias("n_open"))
    parts = table(spark, d, "part").select("p_partkey", "p_brand").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left")
    return parts.withColumn("in_stock", F.coalesce("n_open", F.lit(0)) == 0)


_STOCK = "WITH s AS (SELECT p_partkey, p_brand, coalesce(n_open, 0) = 0 AS ok FROM part LEFT JOIN (SELECT l_partkey, count(*) FILTER (WHERE l_linestatus = 'O' AND l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY) AS n_open FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) "


@query(_STOCK + "SELECT p_brand, count(*) AS n_parts FROM s WHERE ok GROUP BY 1")
def in_stock(spark, d):
    return _stock(spark, d).filter("in_stock").groupBy("p_brand").agg(F.count("*").alias("n_parts"))


@query(_STOCK + "SELECT p_brand, count(*) AS n_parts FROM s WHERE NOT ok GROUP BY 1")
def not_in_stock(spark, d):
    return _stock(spark, d).filter("NOT in_stock").groupBy("p_brand").agg(F.count("*").alias("n_parts"))


@query("SELECT DISTINCT last_day(o_orderdate) AS month_end FROM orders")
def last_days(spark, d):
    return table(spark, d, "orders").select(F.last_day("o_orderdate").alias("month_end")).distinct()


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY 1")
def ordered_listagg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_nationkey")).alias("o"), "n_name"))), lambda x: x["n_name"]), ",").alias("names"))


@query("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal > 9900)")
def exists_rich_customer(spark, d):
    t = sample(spark, d)
    rich = t["customer"].filter("c_acctbal > 9900").join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return t["region"].join(rich.select(F.col("n_regionkey").alias("r_regionkey")), "r_regionkey", "left_semi").select("r_name")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, json_extract_string(props, '$.k')::VARCHAR AS k FROM events GROUP BY event_type, k")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), ranked AS (SELECT c_custkey, c_nationkey, total FROM customer JOIN spent ON o_custkey = c_custkey)
    SELECT n_name, count(*) AS n_customers, round(max(total), 2) AS best FROM ranked JOIN nation ON n_nationkey = c_nationkey WHERE total > (SELECT avg(total) FROM spent) GROUP BY 1"""
)
def customers_above_average(spark, d):
    """Common table expressions, one of them read twice; tables are passed by name, so no view of the session's is replaced."""
    text = """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY 1), ranked AS (SELECT c_custkey, c_nationkey, total FROM {customer} JOIN spent ON o_custkey = c_custkey)
    SELECT n_name, count(*) AS n_customers, round(max(total), 2) AS best FROM ranked JOIN {nation} ON n_nationkey = c_nationkey WHERE total > (SELECT avg(total) FROM spent) GROUP BY 1"""
    return spark.sql(text, **{n: table(spark, d, n) for n in ("orders", "customer", "nation")})
