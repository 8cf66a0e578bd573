"""Star schema: dimensions with history, calendar, facts, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import date_key
from ..functions.scale import landed, ordered_rank
from .joins import current_rows, lookup_key
from .silver import dedup

FAR = date(9999, 12, 31)
HISTORY = ["attr_hash", "valid_from", "valid_to", "is_current", "version"]

# Calendar abbreviations, independent of the session locale.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def attr_hash(columns: Sequence[str]):
    """Fingerprint of the attributes in which null differs from empty text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    return F.md5(F.concat_ws("|", *parts)) if parts else F.lit("")


def _incoming(df: DataFrame, key: str, attributes: Sequence[str] | None, order: str | None) -> DataFrame:
    attributes = [c for c in (attributes or df.columns) if c != key and c != order]
    if order is None:
        return df.select(key, *attributes)
    return dedup(df.select(*dict.fromkeys([key, *attributes, order])), [key], order).select(key, *attributes)


def dimension_scd1(df: DataFrame, key: str, attributes: Sequence[str] | None = None,
                   order: str | None = None, surrogate: str = "dim_key") -> DataFrame:
    """Last row per key with a dense surrogate 1..n in key order."""
    base = _incoming(df, key, attributes, order)
    ranked = ordered_rank(base, key, key, out=surrogate, total="__n")
    return ranked.select(surrogate, *base.columns)


def dimension_scd2(df: DataFrame, key: str, as_of: date, previous: DataFrame | None = None,
                   attributes: Sequence[str] | None = None, order: str | None = None,
                   surrogate: str = "dim_key") -> DataFrame:
    """History-keeping dimension: close changed versions, open new ones.

    Keys missing today stay open.  One full outer join between the open
    versions and the incoming rows decides every action, so a re-run on the
    same input opens nothing.  Surrogates are renumbered by (key, version).
    """
    incoming = _incoming(df, key, attributes, order)
    attributes = [c for c in incoming.columns if c != key]
    incoming = incoming.withColumn("attr_hash", attr_hash(attributes))
    today = F.lit(as_of).cast("date")
    if previous is None or not set(HISTORY) <= set(previous.columns):
        rows = incoming.select(
            key, *attributes, "attr_hash", today.alias("valid_from"), F.lit(FAR).alias("valid_to"),
            F.lit(True).alias("is_current"), F.lit(1).cast("long").alias("version"),
        )
    else:
        columns = [key, *attributes, *HISTORY]
        previous = previous.select(*columns)
        both = (
            current_rows(previous)
            .select(F.col(key).alias("__k"), F.struct(*columns).alias("old"))
            .join(
                incoming.select(F.col(key).alias("__k2"), F.struct(*incoming.columns).alias("new")),
                F.col("__k") == F.col("__k2"),
                "full_outer",
            )
        )
        is_new = F.col("old").isNull()
        changed = ~is_new & F.col("new").isNotNull() & (F.col("old.attr_hash") != F.col("new.attr_hash"))
        kept = F.struct(
            *[F.col(f"old.{c}").alias(c) for c in [key, *attributes, "attr_hash", "valid_from"]],
            F.when(changed, today).otherwise(F.col("old.valid_to")).alias("valid_to"),
            (~changed).alias("is_current"),
            F.col("old.version").cast("long").alias("version"),
        )
        opened = F.struct(
            *[F.col(f"new.{c}").alias(c) for c in [key, *attributes, "attr_hash"]],
            today.alias("valid_from"),
            F.lit(FAR).alias("valid_to"),
            F.lit(True).alias("is_current"),
            (F.coalesce(F.col("old.version"), F.lit(0)) + 1).cast("long").alias("version"),
        )
        actions = F.array_compact(
            F.array(F.when(~is_new, kept), F.when(is_new | changed, opened))
        )
        closed = previous.where(~F.col("is_current"))
        rows = closed.unionByName(both.select(F.inline(actions)))
    ranked = ordered_rank(rows, key, "version", out=surrogate, total="__n")
    return ranked.select(surrogate, key, *attributes, *HISTORY)


BUCKET = "key_bucket"


def merge_scd2(df: DataFrame, path: str, key: str, as_of: date, attributes: Sequence[str] | None = None,
               order: str | None = None, surrogate: str = "dim_key", buckets: int = 64) -> DataFrame:
    """Bring a stored history up to date, writing only what a change touches; returns the stored table.

    The table lies in folders by a hash of the key.  Only its open versions' hashes
    are compared with the incoming rows; the buckets of changed and new keys are
    rewritten, the others stay as they are, and a run without changes writes
    nothing.  Surrogates never change: new versions are numbered after the largest.
    Keys missing today stay open.  A null key is a key.
    """
    spark = df.sparkSession
    incoming = _incoming(df, key, attributes, order)
    attributes = [c for c in incoming.columns if c != key]
    incoming = incoming.withColumn("attr_hash", attr_hash(attributes))
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    today = F.lit(as_of).cast("date")
    stored = _stored(spark, path)
    if stored is None:
        changed, top = incoming.withColumn("version", F.lit(1).cast("long")), 0
    else:
        open_ = current_rows(stored).select(F.col(key).alias("__k"), F.col("attr_hash").alias("__h"), F.col("version").alias("__v"))
        met = incoming.join(open_, F.col(key).eqNullSafe(F.col("__k")), "left")
        fresh = F.col("__h").isNull() | (F.col("__h") != F.col("attr_hash"))
        changed = landed(met.where(fresh).select(*incoming.columns, (F.coalesce("__v", F.lit(0)) + 1).alias("version")))
        if changed.isEmpty():
            return stored
        top = stored.agg(F.max(surrogate).alias("top")).first().top
    numbered = ordered_rank(changed.withColumn(BUCKET, bucket), key, key, out="__at", total="__n")
    opened = numbered.select(
        (F.col("__at") + top).alias(surrogate), key, *attributes, "attr_hash", today.alias("valid_from"), F.lit(FAR).alias("valid_to"),
        F.lit(True).alias("is_current"), "version", BUCKET,
    )
    if stored is None:
        opened.repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        return _stored(spark, path)
    touched = [r[BUCKET] for r in changed.select(bucket.alias(BUCKET)).distinct().collect()]  # at most `buckets`
    superseded = changed.where("version > 1").select(F.col(key).alias("__k"), F.lit(True).alias("__over"))
    before = stored.where(F.col(BUCKET).isin(touched)).join(superseded, F.col(key).eqNullSafe(F.col("__k")), "left")
    closing = F.coalesce("__over", F.lit(False)) & F.col("is_current")
    kept = before.withColumns({
        "valid_to": F.when(closing, today).otherwise(F.col("valid_to")), "is_current": F.col("is_current") & ~closing,
    }).select(*opened.columns)
    rewritten = landed(kept.unionByName(opened))
    rewritten.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return _stored(spark, path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def date_range(tables: Sequence[DataFrame]) -> tuple[date, date] | None:
    """First and last day over every date column, widened to whole months."""
    edges = []
    for df in tables:
        columns = [n for n, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")]
        if not columns:
            continue
        low = F.least(*[F.min(F.to_date(c)) for c in columns], F.lit(None).cast("date"))
        high = F.greatest(*[F.max(F.to_date(c)) for c in columns], F.lit(None).cast("date"))
        edges.append(df.agg(F.trunc(low, "month").alias("a"), F.last_day(high).alias("b")))
    if not edges:
        return None
    both = edges[0]
    for e in edges[1:]:
        both = both.unionByName(e)
    row = both.agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
    return (row.a, row.b) if row.a is not None else None


def calendar_columns(days: DataFrame, column: str = "date") -> DataFrame:
    d = F.col(column)
    weekday = F.weekday(d)
    return days.select(
        date_key(d).alias("date_key"),
        d.alias("date"),
        F.year(d).alias("year"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"),
        F.month(d).alias("month_number"),
        F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)).alias("month"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        (F.year(d) * 100 + F.month(d)).alias("year_month_order"),
        F.element_at(F.array(*map(F.lit, DAYS)), weekday + 1).alias("weekday"),
        (weekday >= 5).alias("is_weekend"),
    )


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day between two dates, both included."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )
    return calendar_columns(days)


# How far one period of each frequency reaches.
STEPS = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month", "quarterly": "3 months", "yearly": "1 year"}


def extend_range(span: tuple[date, date], frequency: str, horizon: int, spark: SparkSession) -> tuple[date, date]:
    """Stretch a calendar range to the month that holds the last forecast."""
    if horizon <= 0 or frequency not in STEPS:
        return span
    count, unit = STEPS[frequency].split()
    reach = F.expr(f"last_day(date'{span[1]}' + interval {int(count) * horizon} {unit})")
    return span[0], spark.range(1).select(reach.alias("d")).first().d


def order_columns(cal: DataFrame) -> DataFrame:
    """Labels carrying the year and integer orders for quarter and semester."""
    year, month = F.col("year"), F.col("month_number")
    quarter = F.ceil(month / 3).cast("int")
    half = F.when(month <= 6, 1).otherwise(2)
    return cal.withColumns(
        {
            "quarter_label": F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string")),
            "semester_label": F.concat(F.lit("S"), half.cast("string"), F.lit(" "), year.cast("string")),
            "year_month_order": year * 100 + month,
            "quarter_order": year * 10 + quarter,
            "semester_order": year * 10 + half,
        }
    )


def fact(df: DataFrame, keys: Mapping[str, tuple[DataFrame, str, str]], date_column: str | None = None,
         check: bool = True) -> DataFrame:
    """Fact rows with surrogate keys first, the date as an integer key.

    `keys` maps a foreign column to (dimension, natural key, surrogate name).
    Every other column travels; a missing date gets key 0.
    """
    for foreign, (dim, natural, surrogate) in keys.items():
        df = lookup_key(df, dim, foreign, natural, surrogate, check)
    if date_column and date_column in df.columns:
        kind = dict(df.dtypes)[date_column]
        d = F.col(date_column).try_cast("date") if kind == "string" else F.col(date_column)
        df = df.withColumn("date_key", date_key(d)).drop(date_column)
    first = [c for c in df.columns if c.endswith("_key")]
    return df.select(*first, *[c for c in df.columns if c not in first])


def passthrough(df: DataFrame) -> DataFrame:
    """No model declared: the table as is, dated by its first date column."""
    dates = [n for n, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")]
    return df.withColumn("date_key", date_key(dates[0])) if dates else df


# Chain members from the most general to the most particular;
# names that share a rank are siblings and never nest.
GENERALITY = (
    ("country", "region"),
    ("category", "area", "segment"),
    ("line", "brand", "family"),
    ("product", "city", "item"),
)
TIME_LEVELS = ("year", "semester", "quarter", "month")


def drill_levels(columns: Sequence[str], levels: int = 3) -> list[str]:
    """Up to `levels` columns of strictly increasing detail (one more for time)."""
    times = [t for t in TIME_LEVELS if t in columns]
    if len(times) > 1:
        return times[: levels + 1]
    picked = []
    for names in GENERALITY:
        hit = next((c for c in columns if any(n in c.lower() for n in names)), None)
        if hit and hit not in picked:
            picked.append(hit)
    return picked[:levels]


def drilldown(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Totals at every level of a general-to-particular chain, in one pass."""
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin(F.grouping_id()), F.lit("0"), F.lit("")))
    return df.rollup(*levels).agg(F.sum(value).alias("amount"), depth.cast("long").alias("depth"))


def summary_table(df: DataFrame, column: str, measures: Sequence[str]) -> DataFrame:
    """One row per value of a column with every measure summed."""
    sums = [F.sum(m).alias(f"sum_{m}") for m in measures]
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"), *sums)
