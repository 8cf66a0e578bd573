"""How late is each table, by the dates in its own rows and by its load."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import date_from_key

# Hours of each declared period, its tolerance, and the cadences
# a median gap can be snapped to as (name, days, days tolerated).
PERIOD_HOURS = {"hourly": 1, "daily": 24, "weekly": 24 * 7, "fortnightly": 24 * 15, "monthly": 24 * 30}
MARGIN, MARGIN_HOURS = 1.15, 2
CADENCES = (("daily", 1, 3), ("weekly", 7, 10), ("fortnightly", 15, 20), ("monthly", 30, 40), ("quarterly", 91, 115))
KEPT_RUNS = 200


def tolerance_hours(every: str) -> float:
    base = PERIOD_HOURS.get(every, 24)
    return round(max(base * MARGIN, base + MARGIN_HOURS), 1)


def _stamp(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """Hours from one zone-free timestamp to another, one decimal."""
    day = F.datediff(end, start) * 24.0
    clock = lambda t: F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0
    return F.round(day + clock(end) - clock(start), 1)


def max_business_date(df: DataFrame, name: str, as_of: datetime, preferred: str | None = None) -> DataFrame:
    """(table, rows, data_date, column): the latest date the rows speak of.

    A column whose maximum lies over a day ahead of `as_of` holds plans, not
    facts, and is passed over.  A fact table is read by its integer date key.
    """
    kinds = dict(df.dtypes)
    if "date_key" in kinds:
        key = F.max(F.when(F.col("date_key") > 19000101, F.col("date_key")))
        dated = [("date_key", date_from_key(key).cast("timestamp_ntz"))]
    else:
        names = [preferred] if preferred in kinds else []
        names += [n for n, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz") and n not in names]
        dated = [(n, F.max(F.col(n).try_cast("timestamp_ntz"))) for n in names]
    limit = _stamp(as_of) + F.expr("interval 1 day")
    options = F.array_compact(
        F.array(
            *[
                F.when(top <= limit, F.struct(top.alias("data_date"), F.lit(-i).alias("place"), F.lit(n).alias("date_column")))
                for i, (n, top) in enumerate(dated)
            ],
            F.when(F.lit(False), F.struct(F.lit(None).cast("timestamp_ntz").alias("data_date"), F.lit(0).alias("place"), F.lit("").alias("date_column"))),
        )
    )
    return (
        df.agg(F.count(F.lit(1)).alias("rows"), F.array_max(options).alias("best"))
        .select(F.lit(name).alias("table_name"), "rows", F.col("best.data_date").alias("data_date"),
                F.col("best.date_column").alias("date_column"))
    )


def freshness(tables: Mapping[str, DataFrame], as_of: datetime, config: Mapping[str, Mapping] | None = None,
              loads: Mapping[str, datetime] | None = None) -> DataFrame:
    """State of each table; the data date rules over the load date.

    `config` may give per table `every`, `tolerance_hours` and `date_column`;
    `loads` the ingestion times stamped by bronze.
    """
    config, loads = dict(config or {}), dict(loads or {})
    now = _stamp(as_of)
    parts = []
    for name, df in tables.items():
        own = dict(config.get(name, {}))
        every = own.get("every", config.get("*", {}).get("every", "daily"))
        tolerance = float(own.get("tolerance_hours") or tolerance_hours(every))
        load = _stamp(loads[name]) if name in loads else F.lit(None).cast("timestamp_ntz")
        best = max_business_date(df, name, as_of, own.get("date_column"))
        data_hours, load_hours = hours_between(F.col("data_date"), now), hours_between(load, now)
        age = F.coalesce(data_hours, load_hours)
        state = (
            F.when(F.col("rows") == 0, "empty").when(age.isNull(), "no_date")
            .when(age <= tolerance, "up_to_date").otherwise("late")
        )
        base = F.coalesce(load, F.col("data_date"))
        parts.append(
            best.select(
                "table_name", "rows", "data_date", "date_column", load.alias("load_date"),
                data_hours.alias("hours_since_data"), load_hours.alias("hours_since_load"),
                F.lit(every).alias("every"), F.lit(tolerance).alias("tolerance_hours"), state.alias("state"),
                (base + F.expr(f"interval {PERIOD_HOURS.get(every, 24)} hours")).alias("next_load"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def record_history(rows: DataFrame, run: datetime, path: str) -> None:
    """Append one run; each run is its own partition of the history."""
    label = run.strftime("%Y-%m-%dT%H-%M-%S")
    rows.withColumn("run", F.lit(label)).write.mode("append").partitionBy("run").parquet(path)


def read_history(spark, path: str, runs: int | None = None) -> DataFrame:
    """All runs, or the last ones; run labels sort by time, so this prunes partitions."""
    rows = spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))
    if runs is None:
        return rows
    last = rows.select("run").distinct().orderBy(F.desc("run")).limit(runs)
    return rows.join(F.broadcast(last), "run", "left_semi")


def real_frequency(history: DataFrame, table: str = "table_name", stamp: str = "data_date") -> DataFrame:
    """Hours between distinct data dates per table: median, extremes, count.

    Dates are made distinct first, so a table's window holds dates, not rows.
    """
    span = Window.partitionBy(table).orderBy(stamp)
    seen = history.where(F.col(stamp).isNotNull()).select(table, stamp).distinct()
    gaps = seen.withColumn("gap", hours_between(F.lag(stamp).over(span).cast("timestamp_ntz"), F.col(stamp).cast("timestamp_ntz")))
    return gaps.groupBy(table).agg(
        F.count(F.lit(1)).alias("observations"),
        F.median("gap").alias("median_hours"),  # of a table's dates: a few thousand at most
        F.min("gap").alias("min_hours"),
        F.max("gap").alias("max_hours"),
    ).where("observations > 1")


def infer_cadence(df: DataFrame, day: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median gap of distinct dates snapped to the nearest known cadence.

    The median is the upper of the two middle gaps; under three dates, or too
    far from any cadence, there is none.
    """
    days = df.where(F.col(day).isNotNull()).select(*keys, F.col(day).cast("date").alias("__d")).distinct()
    span = Window.partitionBy(*keys).orderBy("__d")
    gaps = days.withColumn("__gap", F.datediff("__d", F.lag("__d").over(span)))
    counted = gaps.where("__gap is not null").groupBy(*keys, "__gap").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__gap")
    placed = counted.withColumns(
        {
            "__upto": F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "__all": F.sum("__n").over(Window.partitionBy(*keys)),
        }
    )
    middle = placed.where(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(*keys).agg(
        F.min("__gap").cast("bigint").alias("median_gap"), (F.max("__all") + 1).alias("dates")
    )
    options = F.array(
        *[F.struct(F.abs(F.col("median_gap") - d).alias("far"), F.lit(i).alias("i"), F.lit(n).alias("name"),
                   F.lit(d).alias("d"), F.lit(t).alias("tolerance")) for i, (n, d, t) in enumerate(CADENCES)]
    )
    near = middle.where("dates >= 3").withColumn("b", F.array_min(options))
    fits = F.col("b.far") <= F.col("b.d")
    return near.select(
        *keys, "dates", "median_gap",
        F.when(fits, F.col("b.name")).alias("cadence"),
        F.when(fits, F.col("b.tolerance").cast("bigint")).alias("tolerance_days"),
    )


def freshness_inferred(tables: Mapping[str, tuple[DataFrame, str | None]], as_of) -> DataFrame:
    """State judged by the rhythm in the data itself, worst table marked."""
    spark = next(iter(tables.values()))[0].sparkSession
    today = F.lit(as_of).cast("date")
    parts = []
    for name, (df, column) in tables.items():
        if column is None:
            parts.append(
                df.agg(F.count(F.lit(1)).alias("rows")).select(
                    F.lit(name).alias("table_name"), "rows", F.lit(None).cast("date").alias("data_date"),
                    F.lit(None).cast("bigint").alias("days"), F.lit(None).cast("string").alias("cadence"),
                    F.when(F.col("rows") == 0, "no_data").otherwise("no_date").alias("state"),
                )
            )
            continue
        size = df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.col(column).cast("date")).alias("data_date"), F.lit(1).alias("one"))
        rhythm = infer_cadence(df, column).withColumn("one", F.lit(1))
        days = F.datediff(today, F.col("data_date")).cast("bigint")
        state = (
            F.when(F.col("rows") == 0, "no_data")
            .when(F.col("data_date").isNull(), "no_date")
            .when(F.col("cadence").isNotNull(), F.when(days <= F.col("tolerance_days"), "up_to_date").otherwise("late"))
            .when(days <= 1, "up_to_date").otherwise("no_date")
        )
        parts.append(
            size.join(F.broadcast(rhythm), "one", "left").select(
                F.lit(name).alias("table_name"), "rows", "data_date", days.alias("days"), "cadence", state.alias("state")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    worst = out.agg(F.max("days").alias("__worst"), F.lit(1).alias("one"))
    return (
        out.withColumn("one", F.lit(1)).join(F.broadcast(worst), "one")
        .withColumn("worst", F.coalesce(F.col("days") == F.col("__worst"), F.lit(False)))
        .drop("one", "__worst")
    )
