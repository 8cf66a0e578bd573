"""Period comparisons: prior periods, running totals, market and share.

Inputs are aggregated to their grain first, so every self-join and window here
runs over (group, period) rows, never over facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from ..functions.scale import ordered_rank, with_totals

# Integer order of each grain and the jump that is one year.
GRAINS = {
    "month": (lambda d: F.year(d) * 100 + F.month(d), 100),
    "quarter": (lambda d: F.year(d) * 10 + F.quarter(d), 10),
    "semester": (lambda d: F.year(d) * 10 + F.when(F.month(d) <= 6, 1).otherwise(2), 10),
    "year": (lambda d: F.year(d), 1),
}


def by_month(df: DataFrame, day: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    month = F.trunc(F.col(day), "month").alias("month")
    return df.groupBy(*keys, month).agg(F.sum(value).alias("value"))


def by_grain(df: DataFrame, day: str, value: str, grain: str, keys: Sequence[str] = ()) -> DataFrame:
    order, _ = GRAINS[grain]
    return df.groupBy(*keys, order(F.col(day)).alias("period")).agg(F.sum(value).alias("value"))


def shifted(df: DataFrame, keys: Sequence[str], period: str, move, out: dict[str, str]) -> DataFrame:
    """Left self-join to the row whose period, once moved, is this one.

    Looking a period up by its key survives gaps, where `lag` would take
    whatever row comes before.
    """
    other = df.select(*keys, move(F.col(period)).alias(period), *[F.col(c).alias(a) for c, a in out.items()])
    return df.join(other, [*keys, period], "left")


def previous_month(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return shifted(monthly, keys, "month", lambda m: F.add_months(m, 1), {"value": "previous"})


def month_over_month(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    both = previous_month(monthly, keys)
    return both.withColumn("change", safe_div(F.col("value") - F.col("previous"), "previous"))


def prior_year(df: DataFrame, grain: str, keys: Sequence[str] = ()) -> DataFrame:
    _, jump = GRAINS[grain]
    return shifted(df, keys, "period", lambda p: p + jump, {"value": "prior"})


def ytd(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running total inside each year, cut at the month of the last fact."""
    closing = with_totals(monthly, __closing=F.month(F.max("month")))
    span = Window.partitionBy(*keys, F.year("month")).orderBy("month")
    return (
        closing.where(F.month("month") <= F.col("__closing"))
        .drop("__closing")
        .withColumn("ytd", F.sum("value").over(span.rowsBetween(Window.unboundedPreceding, 0)))
    )


def prior_year_ytd(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same window one year earlier under the same closing month."""
    return shifted(ytd(monthly, keys), keys, "month", lambda m: F.add_months(m, 12), {"ytd": "prior_ytd"})


def comparable_years(df: DataFrame, day: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Year against year over the days both have, ragged ends trimmed.

    A day counts as current if its year-earlier date is inside the calendar and
    as prior if its year-later date is; 29 February has no twin and counts on
    neither side.  One pass: each day is emitted under both roles.
    """
    daily = df.groupBy(*keys, F.col(day).alias("__d")).agg(F.sum(value).alias("__v"))
    bounded = with_totals(
        daily, __start=F.trunc(F.min("__d"), "month"), __end=F.last_day(F.max("__d"))
    )
    d = F.col("__d")
    leap = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    now = ~leap & (F.add_months(d, -12) >= F.col("__start"))
    before = ~leap & (F.add_months(d, 12) <= F.col("__end"))
    roles = F.array_compact(
        F.array(
            F.when(now, F.struct(F.year(d).alias("year"), F.col("__v").alias("c"), F.lit(None).cast("double").alias("p"))),
            F.when(before, F.struct((F.year(d) + 1).alias("year"), F.lit(None).cast("double").alias("c"), F.col("__v").alias("p"))),
        )
    )
    return (
        bounded.select(*keys, F.inline(roles))
        .groupBy(*keys, "year")
        .agg(F.sum("c").alias("current"), F.sum("p").alias("prior"))
    )


def comparable_yoy(df: DataFrame, day: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    both = comparable_years(df, day, value, keys)
    return both.where("prior is not null").withColumn(
        "change", safe_div(F.col("current") - F.col("prior"), "prior")
    )


def comparable_guard(df: DataFrame, calendar: DataFrame, day: str, value: str) -> DataFrame:
    """Yearly change, null unless both years show the same number of days."""
    days = calendar.select(F.col("date").alias("d"))
    earlier = days.select(F.year("d").alias("year"), F.add_months("d", -12).alias("d")).distinct()
    seen = earlier.join(days, "d", "left_semi").groupBy("year").agg(F.count(F.lit(1)).alias("days_before"))
    spans = days.groupBy(F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("days_now")).join(seen, "year", "left")
    yearly = df.groupBy(F.year(day).alias("year")).agg(F.sum(value).alias("value"))
    both = shifted(yearly, [], "year", lambda y: y + 1, {"value": "prior"}).join(spans, "year", "left")
    same = F.col("days_now") == F.col("days_before")
    return both.select(
        "year", "value", "days_now", F.coalesce("days_before", F.lit(0)).alias("days_before"),
        F.when(same, safe_div(F.col("value") - F.col("prior"), "prior")).alias("change"),
    )


def market(grouped: DataFrame, others: Sequence[str], value: str = "value") -> DataFrame:
    """Total that ignores the seller and keeps every other group."""
    totals = grouped.groupBy(*others).agg(F.sum(value).alias("market"))
    return grouped.join(totals, list(others))


def shares(grouped: DataFrame, seller: str, others: Sequence[str], grain: str = "month") -> DataFrame:
    """Share and prior-year share, both parts of the prior recomputed.

    Columns: value, market, share, prior, prior_market, prior_share and the
    change in percentage points.
    """
    _, jump = GRAINS[grain]
    rest = [c for c in others if c != "period"]
    m = market(grouped, [*rest, "period"])
    markets = grouped.groupBy(*rest, "period").agg(F.sum("value").alias("market"))
    before_market = markets.select(*rest, (F.col("period") + jump).alias("period"), F.col("market").alias("prior_market"))
    out = shifted(m.select(*rest, seller, "period", "value", "market"), [*rest, seller], "period", lambda p: p + jump, {"value": "prior"})
    out = out.join(before_market, [*rest, "period"], "left")
    share, earlier = safe_div("value", "market"), safe_div("prior", "prior_market")
    return out.withColumns(
        {"share": share, "prior_share": earlier, "share_change_pp": (share - earlier) * 100}
    )


def comparable_share(df: DataFrame, day: str, value: str, seller: str, keys: Sequence[str] = ()) -> DataFrame:
    """Yearly share change in points over the trimmed comparable window."""
    own = comparable_years(df, day, value, [*keys, seller])
    total = comparable_years(df, day, value, keys).select(
        *keys, "year", F.col("current").alias("market"), F.col("prior").alias("prior_market")
    )
    both = own.join(total, [*keys, "year"])
    share, earlier = safe_div("current", "market"), safe_div("prior", "prior_market")
    return both.where("prior_market is not null and market is not null").select(
        *keys, seller, "year", share.alias("share"), earlier.alias("prior_share"),
        ((share - earlier) * 100).alias("share_change_pp"),
    )


def ranked(grouped: DataFrame, value: str = "value", keys: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Position by value, descending; with gaps unless `dense`.

    Rows (or, for `dense`, distinct values) are numbered by `ordered_rank`;
    equal values then share their first number.
    """
    keys = list(keys)
    rows = grouped.select(*keys, value).distinct() if dense else grouped
    tied = rows.withColumn("__tie", F.xxhash64(*rows.columns))
    numbered = ordered_rank(tied, value, "__tie", keys, descending=True, out="__at", total="__of")
    places = numbered.groupBy(*keys, value).agg(F.min("__at").alias("rank"))
    return grouped.join(places, [*keys, value])


def top_n_total(df: DataFrame, member: str, value: str, n: int) -> DataFrame:
    """The measure over its n best members, ties kept: all that reach the n-th value."""
    grouped = df.groupBy(member).agg(F.sum(value).alias("value"))
    least = grouped.orderBy(F.desc("value")).limit(n).agg(F.min("value").alias("least"))
    best = grouped.join(F.broadcast(least), F.col("value") >= F.col("least"))  # one row
    return best.agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("members"))


def moving_average(df: DataFrame, day: str, value: str, months: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of DAILY totals over the trailing months; empty days do not count."""
    daily = df.groupBy(*keys, F.col(day).alias("__d")).agg(F.sum(value).alias("__v"))
    monthly = daily.groupBy(*keys, F.trunc("__d", "month").alias("month")).agg(
        F.sum("__v").alias("__s"), F.count(F.lit(1)).alias("__n")
    )
    index: Column = F.year("month") * 12 + F.month("month")
    span = Window.partitionBy(*keys).orderBy(index).rangeBetween(-(months - 1), 0)
    return monthly.select(
        *keys, "month", safe_div(F.sum("__s").over(span), F.sum("__n").over(span)).alias("moving_average")
    )
