"""Lookups, star joins, interval joins and period spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import spread_join


class NotUnique(ValueError):
    """The side that must hold one row per key holds more."""


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Non-null keys that occur more than once, with their row counts."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def current_rows(dim: DataFrame) -> DataFrame:
    return dim.where("is_current") if "is_current" in dim.columns else dim


def lookup_key(fact: DataFrame, dim: DataFrame, foreign: str, natural: str, surrogate: str,
               check: bool = True) -> DataFrame:
    """Swap a natural key for the current surrogate; unmatched becomes null.

    The dimension must be unique on its natural key, otherwise facts would
    multiply; the check reads two columns of the dimension only.
    """
    lookup = current_rows(dim).select(F.col(natural).alias("__natural"), F.col(surrogate))
    if check and not repeated_keys(lookup, "__natural").isEmpty():
        raise NotUnique(f"{surrogate}: {natural} repeats among the current rows")
    return spread_join(fact, lookup, foreign, "__natural").drop("__natural", foreign)


def star_join(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return fact.join(dim, key)


def calendar_join(fact: DataFrame, calendar: DataFrame, key: str = "date_key") -> DataFrame:
    return fact.join(calendar, key)


def orphans(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows whose non-null key is absent from the other side's non-null keys."""
    known = right.select(F.col(right_key).alias("__k")).where("__k is not null").distinct()
    return left.where(F.col(left_key).isNotNull()).join(known, F.col(left_key) == F.col("__k"), "left_anti")


def mark_scope(sales: DataFrame, scope: DataFrame, keys: Sequence[str], out: str = "treated") -> DataFrame:
    """Flag rows inside a declared scope without dropping those outside it."""
    flagged = scope.select(*keys).distinct().withColumn("__in", F.lit(True))
    return sales.join(flagged, list(keys), "left").withColumn(out, F.col("__in").isNotNull()).drop("__in")


def explode_days(windows: DataFrame, start: str = "from_day", end: str = "to_day", day: str = "day") -> DataFrame:
    """Closed date intervals to one row per day, so a range join is an equi join."""
    return windows.where(F.col(start) <= F.col(end)).withColumn(
        day, F.explode(F.sequence(F.col(start), F.col(end)))
    )


def interval_join(sales: DataFrame, windows: DataFrame, day: str = "day") -> DataFrame:
    """Every sale with every window holding its day; overlaps repeat the sale."""
    return sales.join(explode_days(windows, day=day), day)


def first_matching_interval(df: DataFrame, day: str, ranges: DataFrame, label: str,
                            order: Sequence[str], out: str, otherwise: str) -> DataFrame:
    """Label of the first range, in the given order, that holds the day."""
    first = (
        explode_days(ranges, day="__day")
        .groupBy("__day")
        .agg(F.min_by(label, F.struct(*order)).alias("__label"))
    )
    return (
        df.join(first, F.col(day) == F.col("__day"), "left")
        .withColumn(out, F.coalesce("__label", F.lit(otherwise)))
        .drop("__day", "__label")
    )


def denormalise(fact: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: Sequence[str]) -> DataFrame:
    """Left join of chosen attributes, so orphans stay and totals still close."""
    side = dim.select(F.col(dim_key).alias("__k"), *columns)
    return spread_join(fact, side, key, "__k").drop("__k")


def label_via_relation(fact: DataFrame, dim: DataFrame, key: str, dim_key: str, label: str,
                       value: str) -> DataFrame:
    """Amount per one-hop label; unmatched amounts form one null-label row.

    Amounts are summed per key before the lookup: a hot key crosses the join
    as a single row.
    """
    per_key = fact.groupBy(key).agg(F.sum(value).alias("__v"))
    side = dim.select(F.col(dim_key).alias("__k"), F.col(label).alias("label"))
    return (
        per_key.join(side, F.col(key) == F.col("__k"), "left")
        .groupBy("label")
        .agg(F.sum("__v").alias("amount"))
    )


def bridge(left: DataFrame, left_key: str, right: DataFrame, right_key: str, out: str = "bridge_key") -> DataFrame:
    """Distinct keys of both sides: the table that resolves many-to-many."""
    return (
        left.select(F.col(left_key).alias(out))
        .union(right.select(F.col(right_key).alias(out)))
        .where(F.col(out).isNotNull())
        .distinct()
    )


def role_playing_date(fact: DataFrame, calendar: DataFrame, date: str, value: str) -> DataFrame:
    """Monthly totals through an alternative date of the fact."""
    days = calendar.select(F.col("date").alias("__d"), "year_month")
    per_day = fact.groupBy(F.col(date).cast("date").alias("__d")).agg(F.sum(value).alias("__v"))
    return per_day.join(days, "__d").groupBy("year_month").agg(F.sum("__v").alias("amount"))


def segment_lookup(sales: DataFrame, segments: DataFrame, key: str, label: str,
                   otherwise: str = "Unclassified") -> DataFrame:
    side = segments.select(F.col(key).alias("__k"), F.col(label).alias("__label"))
    met = spread_join(sales, side, key, "__k").drop("__k")
    return met.withColumn(label, F.coalesce("__label", F.lit(otherwise))).drop("__label")


def period_spine(series: DataFrame, period: str, value: str, keys: Sequence[str] = (),
                 step: str = "1 month") -> DataFrame:
    """Every period between a series' first and last, absent ones at zero."""
    keys = list(keys)
    spine = (
        series.groupBy(*keys)
        .agg(F.min(period).alias("__a"), F.max(period).alias("__b"))
        .select(*keys, F.explode(F.sequence("__a", "__b", F.expr(f"interval {step}"))).alias(period))
    )
    return spine.join(series, [*keys, period], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def latest_per(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column missing from one part is null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def union_distinct(parts: Sequence[DataFrame]) -> DataFrame:
    return union_all(parts).distinct()


def common(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.intersect(part)
    return out


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Key-level change between two snapshots: added, removed or modified."""
    rest = [c for c in before.columns if c != key]
    a = before.select(F.col(key), F.struct(*rest).alias("__a"))
    b = after.select(F.col(key), F.struct(*rest).alias("__b"))
    return (
        a.join(b, key, "full_outer")
        .select(
            key,
            F.when(F.col("__a").isNull(), F.lit("added"))
            .when(F.col("__b").isNull(), F.lit("removed"))
            .when(~F.col("__a").eqNullSafe(F.col("__b")), F.lit("modified"))
            .alias("change"),
        )
        .where("change is not null")
    )


def top_k(df: DataFrame, value: str, k: int, tie: str, keys: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    """The k best rows, overall or per group, ties broken by `tie`.

    Overall it is Spark's bounded top-k.  Per group the rank filter becomes a
    window group limit: every map task forwards at most k rows of a group.
    """
    order = F.col(value).asc() if ascending else F.col(value).desc()
    if not keys:
        return df.orderBy(order, F.col(tie)).limit(k)
    span = Window.partitionBy(*keys).orderBy(order, F.col(tie))
    return df.withColumn("rank", F.row_number().over(span)).where(F.col("rank") <= k)


def top_categories(df: DataFrame, column: str, k: int = 30, other: str = "OTHER") -> DataFrame:
    """Keep the k most frequent values of a column, the rest become `other`."""
    best = (
        df.groupBy(F.col(column).alias("__c"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .where("__c is not null")
        .orderBy(F.desc("__n"), "__c")
        .limit(k)
        .select("__c", F.lit(True).alias("__top"))
    )
    return (
        df.join(F.broadcast(best), F.col(column) == F.col("__c"), "left")
        .withColumn(column, F.when(F.col("__top"), F.col(column)).otherwise(F.lit(other)))
        .drop("__c", "__top")
        .select(*df.columns)
    )
