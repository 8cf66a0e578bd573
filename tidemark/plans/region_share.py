"""Revenue by region and month with prior year, change and share.

Orders are conformed, pass a gate, become a fact over a customer dimension and
a calendar, and are compared period over period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from ..operators import joins, model, quality, silver, timeintel


def gate_rules() -> list[dict]:
    return [
        {"table": "orders", "column": "o_custkey", "type": "not_null"},
        {"table": "orders", "column": "o_orderkey", "type": "unique"},
        {"table": "orders", "column": "o_custkey", "type": "reference", "to": "customer.c_custkey"},
        {"table": "orders", "column": "o_totalprice", "type": "non_negative"},
    ]


def region_share(spark: SparkSession, orders: DataFrame, customer: DataFrame, nation: DataFrame,
                 region: DataFrame) -> DataFrame:
    orders = silver.cast(orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), {"o_totalprice": "decimal"})
    places = joins.denormalise(nation, region, "n_regionkey", "r_regionkey", ["r_name"])
    clients = joins.denormalise(customer.select("c_custkey", "c_nationkey"), places, "c_nationkey", "n_nationkey", ["n_name", "r_name"])
    quality.require_gate(
        quality.evaluate_rules(spark, {"orders": orders, "customer": customer}, gate_rules())
    )
    dim = model.dimension_scd1(clients, "c_custkey", ["n_name", "r_name"], surrogate="dim_customer_key")
    fact = model.fact(orders, {"o_custkey": (dim, "c_custkey", "dim_customer_key")}, "o_orderdate")
    span = model.date_range([orders.select("o_orderdate")])
    calendar = model.calendar(spark, *span)
    # Facts shrink to one row per client and day before they meet a dimension.
    daily = fact.groupBy("dim_customer_key", "date_key").agg(F.sum("o_totalprice").alias("revenue"))
    dated = joins.calendar_join(daily, calendar.select("date_key", "year_month_order"))
    placed = joins.star_join(dated, dim.select("dim_customer_key", "r_name"), "dim_customer_key")
    grouped = placed.groupBy(F.col("r_name").alias("region"), F.col("year_month_order").alias("period")).agg(
        F.sum("revenue").alias("value")
    )
    out = timeintel.shares(grouped, "region", ["period"], "month")
    return out.select(
        "region", F.col("period").alias("year_month"), F.col("value").alias("revenue"),
        F.col("prior").alias("prior_revenue"),
        safe_div(F.col("value") - F.col("prior"), "prior").alias("change"),
        "share", "prior_share", "share_change_pp",
    )
