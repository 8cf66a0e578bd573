"""Queries over sources, conformance, joins, the star model and sets."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import joins, model, silver
from ..plans.region_share import region_share as plan_region_share
from ..sources import layers, readers
from .base import CAMPAIGNS, SALES, Book, campaigns, r, sales, scratch, table

BOOK = Book()
q = BOOK.add


# --- sources and sinks -------------------------------------------------------

@q("SRC-03", "SELECT * FROM customer", finish=False)
def read_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/customer.parquet")


@q("SRC-01", f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, {r('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer")
def read_csv(spark, sf):
    path = scratch(spark)
    table(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv(spark, path).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@q("SRC-04", f"SELECT o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice')} AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def read_json(spark, sf):
    path = scratch(spark)
    table(spark, sf, "orders").write.json(path)
    return readers.read_json(spark, path, lines=True).withColumn("o_orderdate", F.to_date("o_orderdate"))


@q("SRC-05 SET-01", """
  SELECT n_nationkey, n_name, n_regionkey, NULL AS r_regionkey, NULL AS r_name, 'nation.parquet' AS _file FROM nation
  UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name, 'region.parquet' FROM region""")
def read_folder(spark, sf):
    return readers.read_folder(spark, sf, "*ion.parquet")


@q("SRC-08", f"SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, {r('s_acctbal')} AS s_acctbal FROM supplier")
def object_store_path(spark, sf):
    """URIs and absolute paths pass through; relative ones meet the project folder."""
    folder, _, last = sf.rstrip("/").rpartition("/")
    return readers.read_parquet(spark, readers.resolve(readers.resolve(f"{last}/supplier.parquet", folder or "."), "/elsewhere"))


@q("SRC-09", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500")
def limit_rows(spark, sf):
    return readers.limit_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey"), 500)


@q("SRC-10", "SELECT 'lineitem' AS name, 'parquet' AS type, count(*) AS rows, CAST(11 AS BIGINT) AS columns, false AS partial FROM lineitem")
def provenance_counts(spark, sf):
    out = readers.provenance(table(spark, sf, "lineitem"), "lineitem", "parquet", f"{sf}/lineitem.parquet")
    return out.select("name", "type", "rows", "columns", "partial")


DOCUMENT_CELLS = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in ("doc_id", "text", "lang", "source", "n_chars"))


@q("SRC-10", f"""
  SELECT 'documents' AS name, 'parquet' AS type, 'documents.parquet' AS origin, count(*) AS rows, 5 AS columns,
         md5(CAST(sum(CAST('0x' || md5(concat_ws(chr(31), {DOCUMENT_CELLS}))[:15] AS BIGINT)) AS VARCHAR)) AS content_hash,
         NULL AS row_limit, false AS partial FROM documents""")
def provenance_hash(spark, sf):
    return readers.provenance(table(spark, sf, "documents"), "documents", "parquet", "documents.parquet")


@q("SRC-11", 'SELECT o_orderkey AS id, o_orderstatus AS "Column2", o_custkey AS "id (2)" FROM orders')
def clean_headers(spark, sf):
    messy = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").toDF(" id ", "", "id")
    return readers.clean_headers(messy)


@q("SRC-12", "SELECT count(*) AS rows FROM events")
def require_non_empty(spark, sf):
    return readers.require_non_empty(table(spark, sf, "events"), "events").agg(F.count(F.lit(1)).alias("rows"))


LOADED = datetime(2024, 1, 31, 6, 0, 0)


@q("SNK-01 SNK-02", f"SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, {r('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer")
def bronze_round_trip(spark, sf):
    root = scratch(spark)
    layers.write_bronze(table(spark, sf, "customer"), root, "customer", "parquet:customer", LOADED)
    return layers.read_bronze(spark, root, "customer")


@q("SNK-03", "SELECT 'parquet:supplier' AS source, '2024-01-31T06:00:00+00:00' AS loaded_at, 'abc' AS source_hash FROM supplier LIMIT 1")
def bronze_metadata(spark, sf):
    path = layers.write_bronze(table(spark, sf, "supplier"), scratch(spark), "supplier", "parquet:supplier", LOADED, "abc")
    return layers.bronze_metadata(spark.read.parquet(path))


@q("SNK-04", f"SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, {r('s_acctbal + 1')} AS s_acctbal FROM supplier")
def replace_layer(spark, sf):
    root = scratch(spark)
    layers.write_layer(table(spark, sf, "supplier"), root, "silver", "supplier")
    again = layers.read_layer(spark, root, "silver", "supplier").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    layers.write_layer(again, root, "silver", "supplier")
    return layers.read_layer(spark, root, "silver", "supplier")


@q("SNK-02 SIL-12", f"""
  WITH arrived AS (SELECT *, row_number() OVER () AS place FROM events)
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, {r('value')} AS value, props FROM arrived
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY place DESC) = 1""")
def bronze_to_silver_last(spark, sf):
    """The last arrival of each user and kind of event, from the file through the landed table."""
    root = scratch(spark)
    layers.write_bronze(table(spark, sf, "events"), root, "events", "parquet:events", LOADED)
    landed = layers.read_bronze(spark, root, "events", with_arrival=True)
    return silver.conform(landed, {"types": {}, "dedup": ["user_id", "event_type"]})


@q("SRC-05", f"""
  SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, NULL AS c_name, NULL AS c_mktsegment FROM orders
  UNION ALL SELECT NULL, CAST(c_custkey AS VARCHAR), NULL, c_name, c_mktsegment FROM customer""")
def read_folder_csv(spark, sf):
    """CSV files of two headers in one folder."""
    folder = scratch(spark)
    one = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    two = table(spark, sf, "customer").select("c_mktsegment", F.col("c_custkey").alias("o_custkey"), "c_name")
    one.write.option("header", True).csv(f"{folder}/one")
    two.write.option("header", True).option("sep", ";").csv(f"{folder}/two")
    return readers.read_folder(spark, folder, "*/*.csv", "csv").drop("_file")


@q("SNK-05", """SELECT 'tm_orders' AS table_name, count(*) AS rows FROM orders
  UNION ALL SELECT 'tm_customer', count(*) FROM customer UNION ALL SELECT 'tm_lineitem', count(*) FROM lineitem""")
def warehouse_counts(spark, sf):
    return layers.register_views({f"tm_{n}": table(spark, sf, n) for n in ("orders", "customer", "lineitem")})


@q("SNK-05", """SELECT 'orders' AS table_name, count(*) AS rows FROM orders
  UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def warehouse_loaded(spark, sf):
    folder = scratch(spark)  # a schema of its own, so that nothing of an earlier session is in the way
    loaded = {n: table(spark, sf, n) for n in ("orders", "customer", "supplier")}
    return layers.load_warehouse(spark, loaded, f"tm_{folder[-12:]}", folder)


@q("SNK-06", f"SELECT o_orderpriority AS priority, {r('sum(o_totalprice)')} AS revenue FROM orders GROUP BY 1")
def declared_view(spark, sf):
    layers.register_views({"tm_view_orders": table(spark, sf, "orders")})
    outcome = layers.create_views(
        spark,
        {
            "tm_revenue": "SELECT o_orderpriority AS priority, sum(o_totalprice) AS revenue FROM tm_view_orders GROUP BY 1",
            "tm_broken": "SELECT nothing FROM tm_view_orders",
        },
    )
    assert outcome["tm_revenue"] is None and outcome["tm_broken"]
    return spark.table("tm_revenue")


@q("SNK-07", f"SELECT c_mktsegment, count(*) AS orders, {r('avg(o_totalprice)')} AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def free_query(spark, sf):
    layers.register_views({"tm_q_orders": table(spark, sf, "orders"), "tm_q_customer": table(spark, sf, "customer")})
    return spark.sql(
        "SELECT c_mktsegment, count(*) AS orders, avg(o_totalprice) AS mean_price "
        "FROM tm_q_orders JOIN tm_q_customer ON o_custkey = c_custkey GROUP BY 1"
    )


@q("SNK-09", f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, {r('p_retailprice')} AS p_retailprice FROM part")
def export_csv(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    out = layers.export_csv({"part": part}, scratch(spark))
    return readers.read_csv(spark, out["part"]).withColumn("p_retailprice", F.col("p_retailprice").cast("double"))


# --- conformance -------------------------------------------------------------

@q("SIL-01", "SELECT c_custkey AS client_id, c_name AS client, c_mktsegment FROM customer")
def rename_columns(spark, sf):
    return silver.rename(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_custkey": "client_id", "c_name": "client", "absent": "x"})


@q("SIL-02", f"""
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS as_integer,
         {r('o_totalprice')} AS as_decimal, CAST(o_custkey AS VARCHAR) AS as_text,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS as_date,
         o_orderstatus = 'O' AS as_boolean
  FROM orders""")
def cast_columns(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("as_integer"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("as_decimal"),
        F.col("o_custkey").alias("as_text"),
        F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("as_date"),
        F.when(F.col("o_orderstatus") == "O", " Sí ").when(F.col("o_orderstatus") == "P", "no").alias("as_boolean"),
    )
    return silver.cast(raw, {"as_integer": "integer", "as_decimal": "decimal", "as_text": "text", "as_date": "date",
                             "as_boolean": "boolean", "absent": "text"})


@q("SIL-03", f"""
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN NULL ELSE {r('l_extendedprice')} END AS price,
         {r('l_quantity * 1000')} AS thousands, {r('l_discount')} AS discount FROM lineitem""")
def parse_numbers(spark, sf):
    li = table(spark, sf, "lineitem")
    li = li.withColumn("english", F.format_number("l_extendedprice", 2))
    english = F.col("english")
    european = F.concat(F.lit("$ "), F.translate(english, ",.", ".,"))
    price = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "s/d")
        .when(F.col("l_returnflag") == "A", european).otherwise(english)
    )
    raw = li.select(
        "l_orderkey", "l_linenumber", price.alias("price"),
        F.format_number(F.col("l_quantity") * 1000, 0).alias("thousands"),
        F.translate(F.col("l_discount").cast("decimal(6,2)").cast("string"), ".", ",").alias("discount"),
    )
    return silver.cast(raw, {"price": "decimal", "thousands": "decimal", "discount": "decimal"})


@q("SIL-04", f"SELECT {r('o_totalprice')} AS price, o_orderdate AS day, o_orderstatus AS status FROM orders")
def infer_column_types(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(
        F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderstatus").alias("status"),
    )
    return silver.infer_types(raw)


@q("SIL-05", """
  SELECT 'key' AS column_name, 'integer' AS type, count(*) AS filled FROM orders
  UNION ALL SELECT 'price', 'number', count(*) FROM orders
  UNION ALL SELECT 'day', 'date', count(*) FROM orders
  UNION ALL SELECT 'open', 'boolean', count(*) FILTER (WHERE o_orderstatus <> 'P') FROM orders
  UNION ALL SELECT 'mixed', 'string', count(*) FROM orders""")
def strict_types(spark, sf):
    o = table(spark, sf, "orders")
    return silver.strict_types(
        o.select(
            F.col("o_orderkey").cast("string").alias("key"),
            F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
            F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
            F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "O").cast("string")).alias("open"),
            F.when(F.col("o_orderkey") == 0, "s/d").otherwise(F.col("o_orderkey").cast("string")).alias("mixed"),
        )
    )


@q("SIL-06", """
  SELECT 'us' AS column_name, 'month' AS first_part, false AS ambiguous, count(*) AS values FROM orders
  UNION ALL SELECT 'eu', 'day', false, count(*) FROM orders
  UNION ALL SELECT 'short', 'day', true, count(*) FILTER (WHERE day(o_orderdate) <= 12) FROM orders""")
def day_month_vote(spark, sf):
    o = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("eu"),
        F.when(F.dayofmonth("o_orderdate") <= 12, F.date_format("o_orderdate", "d/M/yyyy")).alias("short"),
    )
    votes = [silver.resolve_day_month(o, c) for c in ("us", "eu", "short")]
    return joins.union_all(votes)


@q("SIL-07", """
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), ',', '.') END AS number,
         strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') || 'T06:30' AS short_year,
         CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 'true' ELSE 'false' END AS flag
  FROM orders""")
def normalise_values(spark, sf):
    o = table(spark, sf, "orders")
    price = F.translate(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), ".", ",")
    return o.select(
        "o_orderkey",
        scalars.normalise_value(F.when(F.col("o_orderstatus") == "P", "  ").otherwise(price), "number").alias("number"),
        scalars.normalise_value(F.date_format("o_orderdate", "d/M/yyyy"), "date").alias("iso"),
        scalars.normalise_value(F.concat(F.date_format("o_orderdate", "MM-dd-yy"), F.lit(" 06:30")), "date", day_first=False).alias("short_year"),
        scalars.normalise_value(F.when(F.col("o_orderstatus") == "O", "Verdadero").when(F.col("o_orderstatus") == "F", "no"), "boolean").alias("flag"),
    )


@q("SIL-08", """
  SELECT 'price' AS column_name, 'decimal' AS type, count(*) FILTER (WHERE o_orderstatus = 'P') AS unconvertible, 's/d' AS example FROM orders
  UNION ALL SELECT 'day', 'date', count(*) FILTER (WHERE o_orderpriority = '5-LOW'), 'soon' FROM orders
  UNION ALL SELECT 'key', 'integer', count(*) FILTER (WHERE o_orderkey IS NULL), NULL FROM orders""")
def count_unconvertible(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "s/d").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderpriority") == "5-LOW", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.col("o_orderkey").cast("string").alias("key"),
    )
    return silver.count_unconvertible(o, {"price": "decimal", "day": "date", "key": "integer"})


@q("SIL-09", """
  SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'Other' END AS nation,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE 'Unknown' END AS segment FROM customer""")
def decode_codes(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("double").alias("nation"),
        F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("segment"),
    )
    c = silver.decode(c, "nation", {0: "zero", 1: "one", 2: "two"}, "Other")
    return silver.decode(c, "segment", {"BUILDING": "B"})


@q("SIL-10", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS day FROM orders")
def parse_dates(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "31/31").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day")
    )
    return silver.to_date(o, ["day"])


@q("SIL-11", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('l_quantity')} AS l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def filter_rows(spark, sf):
    return silver.keep(table(spark, sf, "lineitem"), "l_quantity > 30 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@q("SIL-12", f"""
  SELECT o_custkey, o_orderkey, {r('o_totalprice')} AS o_totalprice, o_orderstatus FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def dedup_last(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return silver.dedup(o, ["o_custkey", "absent"], "o_orderkey")


@q("SIL-13", f"""
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, measure, {r('amount')} AS amount FROM
    (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
    UNPIVOT INCLUDE NULLS (amount FOR measure IN (l_quantity, l_discount, l_tax))""")
def unpivot(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return silver.unpivot(li, ["l_orderkey", "l_linenumber"], None, "measure", "amount")


@q("SIL-14", f"""
  SELECT p_partkey, 'list' AS kind, {r('p_retailprice')} AS price FROM part
  UNION ALL SELECT p_partkey, 'sale', {r('p_retailprice * 0.9')} FROM part""")
def unpivot_labelled(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", (F.col("p_retailprice") * 0.9).alias("p_sale"))
    return silver.unpivot_labelled(p, ["p_partkey"], {"p_retailprice": "list", "p_sale": "sale"}, "kind", "price")


@q("SIL-15", f"""
  SELECT o_orderkey, 'm1' AS period, {r('o_totalprice')} AS amount, CAST(o_custkey AS BIGINT) AS paid FROM orders
  UNION ALL SELECT o_orderkey, 'm2', {r('o_totalprice * 2')}, CAST(o_custkey + 1 AS BIGINT) FROM orders""")
def unpivot_groups(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("a1"), (F.col("o_totalprice") * 2).alias("a2"),
        F.col("o_custkey").alias("p1"), (F.col("o_custkey") + 1).alias("p2"),
    )
    return silver.unpivot_groups(o, ["o_orderkey"], "period", {"amount": {"m1": "a1", "m2": "a2"}, "paid": {"m1": "p1", "m2": "p2"}})


@q("SIL-16", f"""
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {r('l_extendedprice * (1 - l_discount)', 6)} AS net,
         {r('l_extendedprice * (1 - l_discount) * (1 + l_tax)', 6)} AS gross FROM lineitem""", digits=6)
def derive_columns(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    out = silver.derive(li, {"net": "l_extendedprice * (1 - l_discount)", "gross": "net * (1 + l_tax)"})
    return silver.drop(out, ["l_extendedprice", "l_discount", "l_tax"])


@q("SIL-17", "SELECT c_custkey, c_mktsegment FROM customer")
def drop_columns(spark, sf):
    return silver.drop(table(spark, sf, "customer"), ["c_name", "c_nationkey", "c_acctbal", "absent"])


@q("SIL-18", """
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS from_key,
         CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS from_text FROM orders""")
def date_from_key(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(scalars.date_key("o_orderdate")).alias("k"),
        F.when(F.col("o_orderstatus") == "F", "tbd").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("t"),
    )
    return o.select("o_orderkey", scalars.date_from_key("k").alias("from_key"), scalars.date_from_key("t").alias("from_text"))


@q("SIL-01 SIL-02 SIL-09 SIL-11 SIL-12 SIL-15 SIL-16 SIL-17", f"""
  WITH kept AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_totalprice > 1000),
  last AS (SELECT * FROM kept WHERE rn = 1)
  SELECT o_custkey AS client, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'partial' END AS status,
         'net' AS kind, {r('o_totalprice * 0.9')} AS amount, {r('o_totalprice * 0.9 * 2')} AS doubled FROM last
  UNION ALL
  SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'partial' END,
         'gross', {r('o_totalprice')}, {r('o_totalprice * 2')} FROM last""")
def conform_table(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("gross"), (F.col("o_totalprice") * 0.9).alias("net")
    )
    return silver.conform(
        o,
        {
            "rename": {"o_custkey": "client", "o_orderstatus": "status"},
            "types": {"client": "integer"},
            "decode": {"status": {"O": "open", "F": "filled", "_other": "partial"}},
            "filter": "gross > 1000",
            "dedup": ["client"],
            "unpivot": {"ids": ["client", "status", "o_orderkey"], "columns": ["net", "gross"], "variable": "kind", "value": "amount"},
            "derive": {"doubled": "amount * 2"},
            "drop": ["o_orderkey"],
        },
        order="o_orderkey",
    )


# --- joins -------------------------------------------------------------------

CUSTOMER_DIM = "dim AS (SELECT row_number() OVER (ORDER BY c_custkey) AS dim_key, c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE')"


def customer_dim(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment <> 'FURNITURE'").select("c_custkey", "c_mktsegment")
    return model.dimension_scd1(c, "c_custkey", ["c_mktsegment"], surrogate="dim_key")


@q("JN-01 JN-02", f"WITH {CUSTOMER_DIM} SELECT o_orderkey, dim_key FROM orders LEFT JOIN dim ON o_custkey = c_custkey")
def lookup_key(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.lookup_key(o, customer_dim(spark, sf), "o_custkey", "c_custkey", "dim_key")


@q("JN-02", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0")
def current_rows(spark, sf):
    c = table(spark, sf, "customer").withColumn("is_current", F.col("c_acctbal") > 0)
    return joins.current_rows(c).select("c_custkey", "c_mktsegment")


@q("JN-03", f"WITH {CUSTOMER_DIM} SELECT c_mktsegment, count(*) AS orders, {r('sum(o_totalprice)')} AS revenue FROM orders JOIN dim ON o_custkey = c_custkey GROUP BY 1")
def star_join(spark, sf):
    dim = customer_dim(spark, sf)
    o = joins.lookup_key(table(spark, sf, "orders").select("o_custkey", "o_totalprice"), dim, "o_custkey", "c_custkey", "dim_key")
    return joins.star_join(o, dim, "dim_key").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue")
    )


def order_calendar(spark, sf):
    return model.calendar(spark, *model.date_range([table(spark, sf, "orders").select("o_orderdate")]))


@q("JN-04", f"SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS orders, {r('sum(o_totalprice)')} AS revenue FROM orders GROUP BY 1")
def calendar_join(spark, sf):
    o = table(spark, sf, "orders").select(scalars.date_key("o_orderdate").alias("date_key"), "o_totalprice")
    return joins.calendar_join(o, order_calendar(spark, sf)).groupBy("year_month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue")
    )


@q("JN-05", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def orphan_rows(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return joins.orphans(table(spark, sf, "customer"), "c_custkey", urgent, "o_custkey").select("c_custkey", "c_mktsegment")


@q("JN-06", f"""
  WITH {SALES}, promo AS (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
  SELECT product IN (SELECT p_partkey FROM promo) AS treated, count(*) AS rows, {r('sum(units)')} AS units FROM sales GROUP BY 1""")
def scope_flag(spark, sf):
    promo = table(spark, sf, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("product"))
    flagged = joins.mark_scope(sales(spark, sf), promo, ["product"])
    return flagged.groupBy("treated").agg(F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units"))


@q("JN-07", f"""
  WITH {SALES}, {CAMPAIGNS}
  SELECT campaign, edition, count(*) AS rows, {r('sum(amount)')} AS amount
  FROM sales JOIN cal ON day BETWEEN from_day AND to_day GROUP BY 1, 2""")
def interval_join(spark, sf):
    rows = joins.interval_join(sales(spark, sf), campaigns(spark, sf))
    return rows.groupBy("campaign", "edition").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"))


@q("JN-08", f"""
  WITH {CAMPAIGNS}, wide AS (SELECT campaign, from_day, to_day + 60 AS to_day FROM cal),
  hits AS (SELECT o_orderkey, campaign, row_number() OVER (PARTITION BY o_orderkey ORDER BY campaign, from_day) AS rn
           FROM orders JOIN wide ON CAST(o_orderdate AS DATE) BETWEEN from_day AND to_day)
  SELECT o.o_orderkey, coalesce(campaign, 'outside campaigns') AS origin FROM orders o LEFT JOIN hits h ON o.o_orderkey = h.o_orderkey AND rn = 1""")
def first_interval(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    wide = campaigns(spark, sf).withColumn("to_day", F.date_add("to_day", 60))
    out = joins.first_matching_interval(o, "day", wide, "campaign", ["campaign", "from_day"], "origin", "outside campaigns")
    return out.drop("day")


@q("JN-09", f"""
  SELECT c_mktsegment, count(*) AS orders, {r('sum(o_totalprice)')} AS revenue FROM orders
  LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'FURNITURE') ON o_custkey = c_custkey GROUP BY 1""")
def denormalise(spark, sf):
    side = table(spark, sf, "customer").where("c_mktsegment <> 'FURNITURE'")
    wide = joins.denormalise(table(spark, sf, "orders"), side, "o_custkey", "c_custkey", ["c_mktsegment"])
    return wide.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue"))


@q("JN-10", f"""
  SELECT p_brand AS label, {r('sum(l_extendedprice)')} AS amount FROM lineitem
  LEFT JOIN (SELECT * FROM part WHERE p_type <> 'LARGE') ON l_partkey = p_partkey GROUP BY 1""")
def label_via_relation(spark, sf):
    side = table(spark, sf, "part").where("p_type <> 'LARGE'")
    return joins.label_via_relation(table(spark, sf, "lineitem"), side, "l_partkey", "p_partkey", "p_brand", "l_extendedprice")


@q("JN-11 SET-02", "SELECT c_nationkey::BIGINT AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def bridge_keys(spark, sf):
    return joins.bridge(table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "supplier"), "s_nationkey", "nation")


@q("JN-12", f"SELECT strftime(l_shipdate, '%Y-%m') AS year_month, {r('sum(l_extendedprice)')} AS amount FROM lineitem GROUP BY 1")
def role_playing_date(spark, sf):
    li = table(spark, sf, "lineitem").select("l_shipdate", "l_extendedprice")
    span = model.date_range([li])
    return joins.role_playing_date(li, model.calendar(spark, *span), "l_shipdate", "l_extendedprice")


@q("JN-13", """
  SELECT o_orderkey, coalesce(label, 'Unclassified') AS label FROM orders LEFT JOIN
    (SELECT c_custkey, 'segment ' || c_mktsegment AS label FROM customer WHERE c_acctbal > 3000) ON o_custkey = c_custkey""")
def segment_lookup(spark, sf):
    seg = table(spark, sf, "customer").where("c_acctbal > 3000").select(
        F.col("c_custkey").alias("client"), F.concat(F.lit("segment "), F.col("c_mktsegment")).alias("label")
    )
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("client"))
    return joins.segment_lookup(o, seg, "client", "label").select("o_orderkey", "label")


@q("JN-14", f"""
  WITH d AS (SELECT o_custkey AS client, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
  s AS (SELECT client, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM d GROUP BY 1)
  SELECT s.client, s.month, {r('coalesce(value, 0)')} AS value FROM s LEFT JOIN d ON s.client = d.client AND s.month = d.month""")
def period_spine(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client"), F.trunc("o_orderdate", "month").alias("month")).agg(
        F.sum("o_totalprice").alias("value")
    )
    return joins.period_spine(o, "month", "value", ["client"])


# --- star model --------------------------------------------------------------

@q("GLD-01", f"""
  SELECT row_number() OVER (ORDER BY o_custkey) AS dim_key, o_custkey, o_orderpriority, {r('o_totalprice')} AS o_totalprice FROM
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def dimension_scd1(spark, sf):
    return model.dimension_scd1(table(spark, sf, "orders"), "o_custkey", ["o_orderpriority", "o_totalprice"], order="o_orderkey")


def customer_loads(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changed = c.withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")))
    first = c.where("c_mktsegment <> 'MACHINERY'")
    second = changed.where("c_mktsegment <> 'FURNITURE'")
    return first, second


def customer_versions(spark, sf):
    first, second = customer_loads(spark, sf)
    d1 = model.dimension_scd2(first, "c_custkey", date(2024, 1, 1))
    d2 = model.dimension_scd2(second, "c_custkey", date(2024, 2, 1), d1)
    return second, d2


SCD2 = f"""
  WITH rows AS (
    SELECT c_custkey, c_mktsegment, c_acctbal, DATE '2024-01-01' AS valid_from,
           CASE WHEN c_mktsegment = 'BUILDING' THEN DATE '2024-02-01' ELSE DATE '9999-12-31' END AS valid_to,
           c_mktsegment <> 'BUILDING' AS is_current, 1 AS version FROM customer WHERE c_mktsegment <> 'MACHINERY'
    UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal + 100, DATE '2024-02-01', DATE '9999-12-31', true, 2 FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal, DATE '2024-02-01', DATE '9999-12-31', true, 1 FROM customer WHERE c_mktsegment = 'MACHINERY')
  SELECT row_number() OVER (ORDER BY c_custkey, version) AS dim_key, c_custkey, c_mktsegment, {r('c_acctbal')} AS c_acctbal,
         valid_from, valid_to, is_current, CAST(version AS BIGINT) AS version FROM rows"""


@q("GLD-02 GLD-03", SCD2)
def dimension_scd2(spark, sf):
    return customer_versions(spark, sf)[1].drop("attr_hash")


@q("GLD-02", SCD2)
def dimension_scd2_rerun(spark, sf):
    """A second run on unchanged input opens nothing."""
    second, d2 = customer_versions(spark, sf)
    return model.dimension_scd2(second, "c_custkey", date(2024, 3, 1), d2).drop("attr_hash")


@q("GLD-02", f"""
  WITH first AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY'),
  news AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
                  CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS version FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
  rows AS (
    SELECT row_number() OVER (ORDER BY c_custkey) AS dim_key, c_custkey, c_mktsegment, c_acctbal, DATE '2024-01-01' AS valid_from,
           CASE WHEN c_mktsegment = 'BUILDING' THEN DATE '2024-02-01' ELSE DATE '9999-12-31' END AS valid_to,
           c_mktsegment <> 'BUILDING' AS is_current, 1 AS version FROM first
    UNION ALL SELECT (SELECT count(*) FROM first) + row_number() OVER (ORDER BY c_custkey), c_custkey, c_mktsegment, c_acctbal,
           DATE '2024-02-01', DATE '9999-12-31', true, version FROM news)
  SELECT dim_key::BIGINT AS dim_key, c_custkey, c_mktsegment, {r('c_acctbal')} AS c_acctbal, valid_from, valid_to, is_current,
         CAST(version AS BIGINT) AS version FROM rows""")
def dimension_scd2_stored(spark, sf):
    """A stored history after a load, an update and a rerun; numbers given once stay."""
    path = scratch(spark)
    first, second = customer_loads(spark, sf)
    for day, rows in ((date(2024, 1, 1), first), (date(2024, 2, 1), second), (date(2024, 3, 1), second)):
        out = model.merge_scd2(rows, path, "c_custkey", day)
    return out.drop("attr_hash", model.BUCKET)


@q("GLD-03", "SELECT count(*) AS rows, count(DISTINCT (c_nationkey, c_mktsegment)) AS distinct_hashes FROM customer")
def attribute_hash(spark, sf):
    c = table(spark, sf, "customer").select(model.attr_hash(["c_nationkey", "c_mktsegment"]).alias("h"))
    return c.groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_hashes"))


CALENDAR = """days AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), CAST(last_day(max(o_orderdate)) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM orders)"""


@q("GLD-04", f"""
  WITH {CALENDAR}
  SELECT CAST(strftime(date, '%Y%m%d') AS BIGINT) AS date_key, date, year(date) AS year, 'Q' || quarter(date) AS quarter,
         month(date) AS month_number, strftime(date, '%b') AS month, strftime(date, '%Y-%m') AS year_month,
         year(date) * 100 + month(date) AS year_month_order, strftime(date, '%a') AS weekday, isodow(date) >= 6 AS is_weekend FROM days""")
def calendar(spark, sf):
    return order_calendar(spark, sf)


@q("GLD-05", """
  SELECT date_trunc('month', least((SELECT min(o_orderdate) FROM orders), (SELECT min(l_shipdate) FROM lineitem)))::DATE AS first_day,
         last_day(greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)))::DATE AS last_day""")
def date_range(spark, sf):
    a, b = model.date_range([table(spark, sf, "orders"), table(spark, sf, "lineitem")])
    return spark.range(1).select(F.lit(a).alias("first_day"), F.lit(b).alias("last_day"))


@q("GLD-06", "SELECT date_trunc('month', min(o_orderdate))::DATE AS first_day, last_day(last_day(max(o_orderdate)) + INTERVAL 9 MONTH)::DATE AS last_day FROM orders")
def extend_calendar(spark, sf):
    span = model.date_range([table(spark, sf, "orders")])
    a, b = model.extend_range(span, "quarterly", 3, spark)
    return spark.range(1).select(F.lit(a).alias("first_day"), F.lit(b).alias("last_day"))


@q("GLD-07", f"""
  WITH {CUSTOMER_DIM}
  SELECT dim_key, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) END AS date_key,
         o_orderkey, {r('o_totalprice')} AS o_totalprice FROM orders LEFT JOIN dim ON o_custkey = c_custkey""")
def fact_table(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("day")
    )
    return model.fact(o, {"o_custkey": (customer_dim(spark, sf), "c_custkey", "dim_key")}, "day")


@q("GLD-08", "SELECT event_id, ts, user_id, event_type, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS date_key FROM events")
def passthrough_model(spark, sf):
    return model.passthrough(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"))


@q("GLD-09", f"""
  WITH {CALENDAR}
  SELECT date, 'Q' || quarter(date) || ' ' || year(date) AS quarter_label, 'S' || CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END || ' ' || year(date) AS semester_label,
         year(date) * 100 + month(date) AS year_month_order, year(date) * 10 + quarter(date) AS quarter_order,
         year(date) * 10 + CASE WHEN month(date) <= 6 THEN 1 ELSE 2 END AS semester_order FROM days""")
def calendar_orders(spark, sf):
    return model.order_columns(order_calendar(spark, sf)).select(
        "date", "quarter_label", "semester_label", "year_month_order", "quarter_order", "semester_order"
    )


@q("GLD-10", f"""
  SELECT r_name AS region_name, p_type AS category, p_brand AS brand, {r('sum(l_extendedprice)')} AS amount,
         CAST(3 - grouping(r_name) - grouping(p_type) - grouping(p_brand) AS BIGINT) AS depth
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, p_type, p_brand)""")
def drilldown(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    wide = joins.denormalise(li, table(spark, sf, "part"), "l_partkey", "p_partkey", ["p_type", "p_brand"])
    nations = joins.denormalise(table(spark, sf, "nation"), table(spark, sf, "region"), "n_regionkey", "r_regionkey", ["r_name"])
    sup = joins.denormalise(table(spark, sf, "supplier"), nations, "s_nationkey", "n_nationkey", ["r_name"])
    wide = joins.denormalise(wide, sup, "l_suppkey", "s_suppkey", ["r_name"]).withColumnsRenamed({"r_name": "region_name", "p_type": "category", "p_brand": "brand"})
    return model.drilldown(wide, model.drill_levels(wide.columns), "l_extendedprice")


@q("GLD-11", f"""
  SELECT l_returnflag, count(*) AS rows, {r('sum(l_quantity)')} AS sum_l_quantity, {r('sum(l_extendedprice)')} AS sum_l_extendedprice,
         {r('sum(l_tax)')} AS sum_l_tax FROM lineitem GROUP BY 1""")
def summary_table(spark, sf):
    return model.summary_table(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice", "l_tax"])


# --- sets, order, top-k ------------------------------------------------------

@q("SET-01", "SELECT o_orderkey AS id, 'order' AS kind, o_custkey AS client FROM orders UNION ALL SELECT event_id, 'event', NULL FROM events")
def union_all(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_custkey").alias("client"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"))
    return joins.union_all([o, e])


@q("SET-03", "SELECT DISTINCT month(o_orderdate) AS month FROM orders WHERE year(o_orderdate) = 2000 INTERSECT SELECT month(o_orderdate) FROM orders WHERE year(o_orderdate) = 2001")
def common_months(spark, sf):
    o = table(spark, sf, "orders")
    return joins.common([o.where(F.year("o_orderdate") == y).select(F.month("o_orderdate").alias("month")) for y in (2000, 2001)])


@q("SET-04", "SELECT l_partkey AS product FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def except_all(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product"), "l_returnflag")
    return joins.without(li.where("l_returnflag = 'N'").select("product"), li.where("l_returnflag = 'R'").select("product"))


@q("SET-04", """
  SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'added' WHEN 'FURNITURE' THEN 'removed' ELSE 'modified' END AS change
  FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE', 'BUILDING')""")
def snapshot_changes(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    after = c.where("c_mktsegment <> 'FURNITURE'").withColumn(
        "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") - 1).otherwise(F.col("c_acctbal"))
    )
    return joins.snapshot_diff(c.where("c_mktsegment <> 'MACHINERY'"), after, "c_custkey")


@q("SRT-01", f"SELECT o_orderkey, {r('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, sf):
    return joins.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, "o_orderkey")


@q("SRT-01", f"""
  SELECT o_orderpriority, o_orderkey, {r('o_totalprice')} AS o_totalprice, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def bottom_orders_per_priority(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return joins.top_k(o, "o_totalprice", 3, "o_orderkey", ["o_orderpriority"], ascending=True)


@q("SRT-02", """
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
         count(*) OVER (PARTITION BY user_id) AS group_rows FROM events""")
def stable_order(spark, sf):
    from ..functions.scale import ordered_rank

    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return ordered_rank(e, "ts", "event_id", ["user_id"]).drop("ts")


@q("SRT-03", """
  WITH top AS (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 30)
  SELECT CASE WHEN p_name IN (SELECT p_name FROM top) THEN p_name ELSE 'OTHER' END AS p_name, count(*) AS parts FROM part GROUP BY 1""")
def top_categories(spark, sf):
    out = joins.top_categories(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", 30)
    return out.groupBy("p_name").agg(F.count(F.lit(1)).alias("parts"))


# --- the flagship ------------------------------------------------------------

@q("GLD-01 GLD-04 GLD-07 AGG-06 WIN-03 WIN-09 DQ-01 DQ-02 DQ-08", f"""
  WITH m AS (SELECT r_name AS region, year(o_orderdate) * 100 + month(o_orderdate) AS ym, sum(o_totalprice) AS v
             FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
  t AS (SELECT ym, sum(v) AS mk FROM m GROUP BY 1)
  SELECT m.region, m.ym AS year_month, {r('m.v')} AS revenue, {r('p.v')} AS prior_revenue, {r('m.v / p.v - 1')} AS change,
         {r('m.v / t.mk')} AS share, {r('p.v / tp.mk')} AS prior_share, {r('(m.v / t.mk - p.v / tp.mk) * 100')} AS share_change_pp
  FROM m JOIN t ON m.ym = t.ym LEFT JOIN m p ON p.region = m.region AND p.ym = m.ym - 100 LEFT JOIN t tp ON tp.ym = m.ym - 100""")
def region_share(spark, sf):
    return plan_region_share(spark, *[table(spark, sf, n) for n in ("orders", "customer", "nation", "region")])
