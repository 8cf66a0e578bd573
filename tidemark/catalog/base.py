"""What every registered query shares: tables, views of them, SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scale import shared_folder as scratch  # noqa: F401  (families import it from here)

INTS = (T.ByteType, T.ShortType, T.IntegerType)


class Book:
    """Queries of one family with their SQL twins and the ids they answer."""

    def __init__(self):
        self.queries, self.oracles, self.ids = {}, {}, {}

    def add(self, ids: str, sql: str | None = None, finish: bool = True, digits: int = 4):
        def register(fn):
            name = fn.__name__

            def run(spark, sf):
                out = fn(spark, sf)
                return comparable(out, digits) if finish else out

            run.__name__, run.__doc__ = name, fn.__doc__
            self.queries[name] = run
            self.ids[name] = ids.split()
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register


def comparable(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded and integers widened, as both engines must print them."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c, digits)
        elif isinstance(field.dataType, INTS):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


# Added before rounding on both sides, so that a value on the edge of the last
# digit falls the same way whatever order its sum was taken in.
NUDGE = "0.00000002"


def rounded(c, digits: int = 4):
    return F.round(c.cast("double") + F.lit(float(NUDGE)), digits) + F.lit(0.0)


def r(expression: str, digits: int = 4) -> str:
    return f"(round(CAST({expression} AS DOUBLE) + {NUDGE}, {digits}) + 0.0)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Columns of every table by family of types: whole numbers, texts, dates, fractions (nested ones left out).
COLUMNS = {
    "region": {"number": ["r_regionkey"], "string": ["r_name"]},
    "nation": {"number": ["n_nationkey", "n_regionkey"], "string": ["n_name"]},
    "customer": {"number": ["c_custkey", "c_nationkey"], "string": ["c_name", "c_mktsegment"], "fraction": ["c_acctbal"]},
    "supplier": {"number": ["s_suppkey", "s_nationkey"], "string": ["s_name"], "fraction": ["s_acctbal"]},
    "part": {"number": ["p_partkey", "p_size"], "string": ["p_name", "p_brand", "p_type"], "fraction": ["p_retailprice"]},
    "orders": {"number": ["o_orderkey", "o_custkey"], "string": ["o_orderstatus", "o_orderpriority"], "date": ["o_orderdate"],
               "fraction": ["o_totalprice"]},
    "lineitem": {"number": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "string": ["l_returnflag", "l_linestatus"],
                 "date": ["l_shipdate"], "fraction": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]},
    "events": {"number": ["event_id", "user_id"], "string": ["event_type", "props"], "date": ["ts"], "fraction": ["value"]},
    "documents": {"number": ["doc_id", "n_chars"], "string": ["text", "lang", "source"]},
    "embeddings": {"number": ["vec_id", "label"]},
    "pages": {"number": ["page_id"], "string": ["url", "html"]},
    "benchmark": {"number": ["item_id"], "string": ["text"]},
    "labels": {"number": ["doc_id", "quality", "toxic"]},
    "conversations": {"number": ["conv_id", "turn"], "string": ["role", "text"]},
}


def every_table(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in COLUMNS}


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as dated sales of a product to a client."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("l_shipdate").cast("date").alias("ship_day"),
        F.col("l_partkey").alias("product"),
        F.col("o_custkey").alias("client"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_quantity").alias("units"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
        (F.col("l_extendedprice") * 0.8).alias("cost"),
        F.col("o_orderpriority").alias("priority"),
        F.col("l_returnflag").alias("flag"),
    )


SALES = """sales AS (
  SELECT CAST(o_orderdate AS DATE) AS day, CAST(l_shipdate AS DATE) AS ship_day, l_partkey AS product,
         o_custkey AS client, l_suppkey AS supplier, l_orderkey AS order_id, l_quantity AS units,
         l_extendedprice * (1 - l_discount) AS amount, l_extendedprice * 0.8 AS cost,
         o_orderpriority AS priority, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def seller_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Sales with the seller (supplier's nation) and the product's brand and type."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("seller"))
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    return (
        sales(spark, sf)
        .join(suppliers, F.col("supplier") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(parts, F.col("product") == F.col("p_partkey"))
        .drop("s_suppkey", "s_nationkey", "n_nationkey", "p_partkey")
    )


SELLER_SALES = SALES + """,
seller_sales AS (
  SELECT s.*, n_name AS seller, p_brand AS brand, p_type AS category
  FROM sales s JOIN supplier ON s.supplier = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON s.product = p_partkey)"""


def campaigns(spark: SparkSession, sf: str) -> DataFrame:
    """A campaign calendar read off the orders.

    One campaign per order priority, one edition per year in which it has
    orders; start month and length follow from the priority's own number.
    """
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderdate")
    number = F.substring("o_orderpriority", 1, 1).cast("int")
    editions = orders.select(
        F.col("o_orderpriority").alias("campaign"), F.year("o_orderdate").alias("year"), number.alias("n")
    ).distinct()
    start = F.make_date("year", F.col("n") * 2, F.lit(5))
    return editions.select(
        "campaign", F.col("year").cast("string").alias("edition"), start.alias("from_day"),
        F.date_add(start, 8 + F.col("n") + F.col("year") % 3).alias("to_day"),
    )


CAMPAIGNS = """cal0 AS (
  SELECT DISTINCT o_orderpriority AS campaign, year(o_orderdate) AS year,
         CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS n FROM orders),
calraw AS (
  SELECT campaign, CAST(year AS VARCHAR) AS edition, make_date(year, n * 2, 5) AS from_day,
         make_date(year, n * 2, 5) + CAST(8 + n + year % 3 AS INTEGER) AS to_day FROM cal0),
cal AS (
  SELECT campaign, edition, from_day, to_day, CAST(to_day - from_day + 1 AS BIGINT) AS days,
         row_number() OVER (PARTITION BY campaign ORDER BY from_day, edition) AS edition_number FROM calraw)"""


def scope(spark: SparkSession, sf: str) -> DataFrame:
    """Products of each edition: the parts whose type goes with the campaign.

    Odd years also take the brands that start with the campaign's number, so
    consecutive editions share only part of their products.
    """
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("product"), "p_type", "p_brand")
    return parts.join(scope_rules(spark, sf), ["p_type"]).where(
        (F.col("year") % 2 == 0) | (F.col("p_brand") >= "Brand#2")
    ).select("campaign", "edition", "product")


def scope_rules(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in SCOPE_TYPES.items() for x in kv])
    return campaigns(spark, sf).select(
        "campaign", "edition", F.year("from_day").alias("year"), pairs[F.substring("campaign", 1, 1)].alias("p_type")
    )


# Which part type each campaign number promotes.
SCOPE_TYPES = {"1": "ECONOMY", "2": "STANDARD", "3": "PROMO", "4": "SMALL", "5": "MEDIUM"}

SCOPE = """scope AS (
  SELECT campaign, edition, p_partkey AS product FROM calraw JOIN part
    ON p_type = CASE substring(campaign, 1, 1) WHEN '1' THEN 'ECONOMY' WHEN '2' THEN 'STANDARD'
                  WHEN '3' THEN 'PROMO' WHEN '4' THEN 'SMALL' ELSE 'MEDIUM' END
  WHERE year(from_day) % 2 = 0 OR p_brand >= 'Brand#2')"""
