"""Queries over KPIs, totals, concentration and crossed facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import format_number
from ..operators import joins, kpis, model
from .base import COLUMNS, SALES, Book, r, rounded, sales, seller_sales, table
from .basics import customer_dim, order_calendar

BOOK = Book()
q = BOOK.add


def fmt(expression, decimals):
    return f"translate(format('{{:,.{decimals}f}}', {expression}), ',.', '.,')"


@q("AGG-01 AGG-02 AGG-03 AGG-04 AGG-08", f"""
  SELECT 'revenue' AS name, {r('sum(o_totalprice)')} AS value, {fmt('sum(o_totalprice)', 2)} AS text, true AS ok FROM orders
  UNION ALL SELECT 'mean', {r('avg(o_totalprice)')}, {fmt('avg(o_totalprice)', 1)}, true FROM orders
  UNION ALL SELECT 'smallest', {r('min(o_totalprice)')}, {fmt('min(o_totalprice)', 0)}, true FROM orders
  UNION ALL SELECT 'largest', {r('max(o_totalprice)')}, {fmt('max(o_totalprice)', 0)}, true FROM orders
  UNION ALL SELECT 'orders', count(*)::DOUBLE, {fmt('count(*)::DOUBLE', 0)}, true FROM orders
  UNION ALL SELECT 'clients', count(DISTINCT o_custkey)::DOUBLE, {fmt('count(DISTINCT o_custkey)::DOUBLE', 0)}, true FROM orders
  UNION ALL SELECT 'per client', {r('sum(o_totalprice) / count(DISTINCT o_custkey)')}, {fmt('sum(o_totalprice) / count(DISTINCT o_custkey)', 2)}, true FROM orders
  UNION ALL SELECT 'lines per order', {r('count(*) * 1.0 / (SELECT count(*) FROM orders)')}, {fmt('count(*) * 1.0 / (SELECT count(*) FROM orders)', 3)}, true FROM lineitem
  UNION ALL SELECT 'open orders', count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE, {fmt("count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE", 0)}, true FROM orders
  UNION ALL SELECT 'broken', NULL, '—', false FROM orders GROUP BY 1""")
def kpi_table(spark, sf):
    tables = {"orders": table(spark, sf, "orders"), "lineitem": table(spark, sf, "lineitem")}
    tables["orders"].createOrReplaceTempView("tm_kpi_orders")
    o = {"table": "orders"}
    declared = [
        {**o, "name": "revenue", "aggregation": "sum", "column": "o_totalprice", "format": "#,0.00"},
        {**o, "name": "mean", "aggregation": "avg", "column": "o_totalprice", "format": "#,0.0"},
        {**o, "name": "smallest", "aggregation": "min", "column": "o_totalprice"},
        {**o, "name": "largest", "aggregation": "max", "column": "o_totalprice"},
        {**o, "name": "orders", "aggregation": "count"},
        {**o, "name": "clients", "aggregation": "count_distinct", "column": "o_custkey"},
        {"name": "per client", "type": "ratio", "numerator": {**o, "column": "o_totalprice"},
         "denominator": {**o, "aggregation": "count_distinct", "column": "o_custkey"}, "format": "#,0.00"},
        {"name": "lines per order", "type": "ratio", "numerator": {"table": "lineitem", "aggregation": "count"},
         "denominator": {**o, "aggregation": "count"}, "format": "#,0.000"},
        {"name": "open orders", "type": "sql", "sql": "SELECT count(*) FROM tm_kpi_orders WHERE o_orderstatus = 'O'"},
        {**o, "name": "broken", "aggregation": "sum", "column": "no_such_column"},
    ]
    return kpis.kpi_values(tables, declared).drop("error")


@q("AGG-05 SRT-01", f"SELECT l_partkey, {r('sum(l_extendedprice)')} AS value FROM lineitem GROUP BY 1 ORDER BY value DESC, l_partkey LIMIT 12")
def kpi_by_column(spark, sf):
    return kpis.kpi_by(table(spark, sf, "lineitem"), "l_partkey", F.sum("l_extendedprice"))


@q("AGG-05 JN-03", f"SELECT c_mktsegment, {r('sum(o_totalprice)')} AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1 ORDER BY 2 DESC LIMIT 12")
def kpi_by_attribute(spark, sf):
    dim = customer_dim(spark, sf)
    o = joins.lookup_key(table(spark, sf, "orders").select("o_custkey", "o_totalprice"), dim, "o_custkey", "c_custkey", "dim_key")
    return kpis.kpi_by_attribute(o, dim, "dim_key", "c_mktsegment", "o_totalprice")


@q("AGG-06 JN-04", f"SELECT strftime(o_orderdate, '%Y-%m') AS year_month, {r('sum(o_totalprice)')} AS value FROM orders GROUP BY 1")
def monthly_series(spark, sf):
    o = model.passthrough(table(spark, sf, "orders")).select("date_key", "o_totalprice")
    return kpis.monthly_series(o, order_calendar(spark, sf), "o_totalprice")


@q("AGG-07", f"""
  SELECT 'orders rows' AS name, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'orders.o_totalprice total', {r('sum(o_totalprice)', 2)} FROM orders
  UNION ALL SELECT 'lineitem rows', count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'lineitem.l_linenumber total', sum(l_linenumber)::DOUBLE FROM lineitem
  UNION ALL SELECT 'lineitem.l_quantity total', {r('sum(l_quantity)', 2)} FROM lineitem UNION ALL SELECT 'lineitem.l_extendedprice total', {r('sum(l_extendedprice)', 2)} FROM lineitem
  UNION ALL SELECT 'lineitem.l_discount total', {r('sum(l_discount)', 2)} FROM lineitem UNION ALL SELECT 'lineitem.l_tax total', {r('sum(l_tax)', 2)} FROM lineitem""", digits=2)
def automatic_kpis(spark, sf):
    return kpis.auto_kpis({"orders": table(spark, sf, "orders"), "lineitem": table(spark, sf, "lineitem"), "dim_part": table(spark, sf, "part")})


@q("AGG-09", f"""
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {fmt('l_extendedprice', 2)} AS price,
         CASE WHEN l_returnflag = 'R' THEN '—' ELSE {fmt('l_discount * 100', 1)} || ' %' END AS discount FROM lineitem""")
def number_format(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", format_number("l_extendedprice", "#,0.00").alias("price"),
        format_number(F.when(F.col("l_returnflag") != "R", F.col("l_discount")), "#,0.0 %").alias("discount"),
    )


@q("AGG-10", f"WITH {SALES} SELECT priority, {r('sum(amount) - sum(cost)')} AS margin, {r('(sum(amount) - sum(cost)) / sum(amount)', 6)} AS margin_pct FROM sales GROUP BY 1", digits=6)
def margins(spark, sf):
    out = kpis.margin(sales(spark, sf), "amount", "cost", ["priority"])
    return out.withColumn("margin", rounded(F.col("margin")))


@q("AGG-11", """
  SELECT 'l_partkey' AS dimension, count(DISTINCT l_partkey) AS members FROM lineitem
  UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey) FROM lineitem""")
def uniques_per_dimension(spark, sf):
    return kpis.uniques_per_dimension(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_orderkey"])


@q("AGG-12", f"SELECT l_returnflag, {r('sum(l_extendedprice * l_discount)')} AS value FROM lineitem GROUP BY 1")
def sum_product(spark, sf):
    return kpis.sum_product(table(spark, sf, "lineitem"), "l_extendedprice", "l_discount", ["l_returnflag"])


@q("AGG-13", f"SELECT l_returnflag, count(DISTINCT l_orderkey) AS operations, {r('sum(l_extendedprice) / count(DISTINCT l_orderkey)')} AS ticket FROM lineitem GROUP BY 1")
def average_ticket(spark, sf):
    return kpis.average_ticket(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey", ["l_returnflag"])


@q("AGG-14", f"SELECT o_orderpriority, {r('sum(o_totalprice)')} AS value, {r("sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O')")} AS filtered_value FROM orders GROUP BY 1")
def filtered_kpi(spark, sf):
    return kpis.filtered_kpi(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus = 'O'")


@q("AGG-15", f"""
  WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1)
  SELECT o_orderpriority, {r('v')} AS value, {r('v / sum(v) OVER ()', 6)} AS share,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {r("v / sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN v END) OVER ()", 6)} END AS share_of_selection FROM g""", digits=6)
def pct_of_total(spark, sf):
    out = kpis.pct_of_total(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderpriority in ('1-URGENT', '2-HIGH')")
    return out.withColumn("value", rounded(F.col("value")))


@q("AGG-16", f"""
  WITH g AS (SELECT l_suppkey, sum(l_extendedprice * l_discount) AS n, sum(l_extendedprice) AS d FROM lineitem GROUP BY 1)
  SELECT l_suppkey, {r('n / d')} AS ratio, {r('(n / d - sum(n) OVER () / sum(d) OVER ()) * 100')} AS vs_total_pp FROM g""")
def ratio_vs_total(spark, sf):
    li = table(spark, sf, "lineitem")
    return kpis.ratio_vs_total_pp(li, "l_suppkey", F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.sum("l_extendedprice"))


@q("AGG-17", """
  WITH g AS (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1)
  SELECT CAST(l_partkey AS VARCHAR) AS winner, v AS value FROM g WHERE v = (SELECT max(v) FROM g)""")
def which_member(spark, sf):
    return kpis.which(table(spark, sf, "lineitem"), "l_partkey", "l_quantity")


@q("AGG-18", f"""
  SELECT 'orders' AS table_name, 'price' AS column_name, {r("sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'P')")} AS sum,
         {r("avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'P')")} AS mean, count(*) FILTER (WHERE o_orderstatus <> 'P') AS filled, count(*) AS rows FROM orders
  UNION ALL SELECT 'orders', 'o_custkey', {r('sum(o_custkey)::DOUBLE')}, {r('avg(o_custkey)')}, count(o_custkey), count(*) FROM orders""")
def control_totals(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "s/d").otherwise(F.col("o_totalprice").cast("string")).alias("price"), "o_custkey"
    )
    return kpis.control_totals(o, ["price", "o_custkey"], "orders")


@q("AGG-19", f"""
  WITH t AS (SELECT sum(l_quantity) AS a, sum(l_quantity) AS b, sum(l_tax) AS c FROM lineitem)
  SELECT {r('a')} AS value, 'copy, quantity' AS names, CAST(2 AS BIGINT) AS twins FROM t WHERE a <> 0""")
def twin_measures(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_quantity").alias("copy"), F.col("l_tax").alias("tax"))
    return kpis.twin_measures(kpis.control_totals(li, ["quantity", "copy", "tax"], "lineitem"), "column_name", "sum")


@q("AGG-20", f"""
  WITH g AS (SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS member, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1),
  t AS (SELECT sum(v) FILTER (WHERE member IS NOT NULL) AS total, sum(v) FILTER (WHERE member IS NULL) AS un, count(member) AS members FROM g),
  b AS (SELECT member, v, row_number() OVER (ORDER BY v DESC, member) AS position FROM g WHERE member IS NOT NULL ORDER BY v DESC, member LIMIT 10)
  SELECT position, member, {r('v')} AS value, {r('v / total')} AS share, {r('sum(v) OVER (ORDER BY position) / total')} AS running_share,
         members, {r('un')} AS unassigned FROM b, t""")
def concentration(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), " ").otherwise(F.col("l_partkey").cast("string")).alias("part"), "l_extendedprice"
    )
    return kpis.concentration(li, "part", "l_extendedprice")


@q("AGG-21", f"SELECT 'seller' AS dimension, 'amount' AS measure, {r("sum(amount)", 2)} AS total FROM (WITH {SALES} SELECT * FROM sales)", digits=2)
def best_cut(spark, sf):
    s = seller_sales(spark, sf)
    return kpis.best_cut(s, ["seller", "flag", "product"], ["units", "amount"], used=["amount"])


def contact_facts(spark, sf):
    events = table(spark, sf, "events").select("user_id", "value")
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    return {"orders": (orders, "o_custkey", ["o_totalprice"]), "events": (events, "user_id", ["value"])}


CROSS = f"""crossed AS (
  SELECT c_mktsegment AS member_group, count(*) AS members,
         coalesce(sum(ov), 0) AS orders_total, coalesce(sum(ov), 0) / count(*) AS orders_each,
         coalesce(sum(ev), 0) AS events_total, coalesce(sum(ev), 0) / count(*) AS events_each
  FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS ov FROM orders GROUP BY 1) ON c_custkey = o_custkey
       LEFT JOIN (SELECT user_id, sum(value) AS ev FROM events GROUP BY 1) ON c_custkey = user_id GROUP BY 1)"""


@q("AGG-22", f"""
  WITH {CROSS} SELECT member_group, members, {r('orders_total')} AS orders_total, {r('orders_each')} AS orders_each,
         {r('events_total')} AS events_total, {r('events_each')} AS events_each FROM crossed""")
def cross_facts(spark, sf):
    return kpis.cross_facts(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", contact_facts(spark, sf))


@q("AGG-23", f"""
  WITH {CROSS}, s AS (
    SELECT max(orders_each) FILTER (WHERE orders_each > 0) / min(orders_each) FILTER (WHERE orders_each > 0) AS so, max(events_each) FILTER (WHERE events_each > 0) / min(events_each) FILTER (WHERE events_each > 0) AS se,
           max_by(member_group, orders_each) AS bo, min_by(member_group, orders_each) AS wo, max_by(member_group, events_each) AS be, min_by(member_group, events_each) AS we,
           max_by(events_each, orders_each) AS e_bo, min_by(events_each, orders_each) AS e_wo, max_by(orders_each, events_each) AS o_be, min_by(orders_each, events_each) AS o_we FROM crossed)
  SELECT CASE WHEN so > se THEN 'orders' ELSE 'events' END AS result, {r('greatest(so, se)')} AS spread,
         CASE WHEN so > se THEN bo ELSE be END AS best, CASE WHEN so > se THEN wo ELSE we END AS worst, CASE WHEN so > se THEN 'events' ELSE 'orders' END AS effort,
         {r('CASE WHEN so > se THEN e_bo ELSE o_be END')} AS in_best, {r('CASE WHEN so > se THEN e_wo ELSE o_we END')} AS in_worst,
         CASE WHEN so > se THEN e_wo >= e_bo ELSE o_we >= o_be END AS misaligned FROM s WHERE greatest(so, se) >= 1.05""")
def misalignment(spark, sf):
    crossed = kpis.cross_facts(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", contact_facts(spark, sf), top=None)
    return kpis.misalignment(crossed, ["orders", "events"], minimum_spread=1.05)


ORDER_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM orders" for cs in COLUMNS["orders"].values() for c in cs)


@q("AGG-25", f"""
  WITH u AS ({ORDER_CELLS}),
  s AS (SELECT column_name, string_agg(v, ' | ' ORDER BY v) AS samples FROM (SELECT column_name, v, row_number() OVER (PARTITION BY column_name ORDER BY v) AS rn FROM (SELECT DISTINCT column_name, v FROM u WHERE trim(v) <> '')) WHERE rn <= 3 GROUP BY 1),
  c AS (SELECT column_name, count(*) AS rows, count(DISTINCT v) AS distinct_values, count(*) FILTER (WHERE v IS NULL OR trim(v) = '') AS blanks FROM u GROUP BY 1)
  SELECT 'orders' AS table_name, c.column_name, rows, distinct_values, blanks, samples, row_number() OVER (ORDER BY distinct_values DESC, c.column_name) AS cardinality_rank FROM c JOIN s ON c.column_name = s.column_name""")
def column_stats(spark, sf):
    return kpis.column_stats(table(spark, sf, "orders"), "orders")
