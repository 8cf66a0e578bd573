"""Helpers that keep ranks and quantiles safe at any size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = "spark.checkpoint.dir"
# Types of which Spark's frequent-items sketch counts values; keys of others join plainly.
COUNTED = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "string", "date", "timestamp")
_LOCAL: dict[str, str] = {}  # application -> its folder, where none is declared


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder every executor can reach: under the folder the session declares in spark.checkpoint.dir.

    A session of one machine (tests, bench) may leave that unset and gets a local
    one; on a cluster a missing setting is an error, not a machine-local write.
    """
    root = spark.conf.get(ROOT, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {ROOT} to a folder that all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _LOCAL[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def landed(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back, so that later uses do not recompute them."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_pieces(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with __piece and __at: range-partitioned and sorted by `order`, then landed.

    Pieces follow each other in the order, and so do the rows of a piece by __at,
    which counts from 0.  Spark cuts the ranges from its own sample; any cut gives
    the same order.  Landing fixes the pieces, as two runs may cut differently.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = landed(ranged.withColumn("__id", F.monotonically_increasing_id()))
    return numbered.select(
        *df.columns, F.shiftright("__id", 33).alias("__piece"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__at")
    )


def ordered_rank(
    df: DataFrame,
    order: str,
    tie: str,
    keys: Sequence[str] = (),
    descending: bool = False,
    out: str = "position",
    total: str = "group_rows",
) -> DataFrame:
    """1..n by (order, tie) inside `keys`, plus the group's row count; nulls come last.

    One path for every size: rows are sorted in range pieces, so a group of any
    size is spread over them, and each piece's share of a group is offset by the
    shares before it.  Only those shares, counts, are ever summed in a window.
    """
    keys = list(keys)
    direction = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    placed = sorted_pieces(df, [*[F.col(k) for k in keys], direction, F.col(tie)])
    span = Window.partitionBy(*keys)
    shares = (
        placed.groupBy(*keys, "__piece")
        .agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
        .withColumns(
            {
                "__before": F.sum("__rows").over(span.orderBy("__piece").rowsBetween(Window.unboundedPreceding, 0))
                - F.col("__rows") - F.col("__first") + 1,
                total: F.sum("__rows").over(span),
            }
        )
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__piece").alias("__p"), "__before", total)
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = placed.join(shares, [F.col("__piece") == F.col("__p"), *same])
    return joined.withColumn(out, F.col("__at") + F.col("__before")).select(*df.columns, out, total)


def running_sums(df: DataFrame, sums: Mapping[str, str], order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """For each (new column, summed column) the sum over a group's rows up to each row, in an order without ties.

    Rows are summed inside their range piece and offset by the sums of the pieces before,
    so a group of any size is spread over tasks.  All sums share one sorted landing.
    """
    keys = list(keys)
    placed = sorted_pieces(df, [*[F.col(k) for k in keys], *order])
    upto = Window.partitionBy(*keys, "__piece").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy(*keys, "__piece").agg(*[F.sum(v).alias(f"__s{i}") for i, v in enumerate(sums.values())])
    shares = whole.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__piece").alias("__p"),
        *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))],
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    inside = placed.withColumns({f"__i{i}": F.sum(v).over(upto) for i, v in enumerate(sums.values())})
    joined = inside.join(shares, [F.col("__piece") == F.col("__p"), *same])
    return joined.select(*df.columns, *[(F.col(f"__i{i}") + F.col(f"__b{i}")).alias(c) for i, c in enumerate(sums)])


def exact_sum(column: str) -> Column:
    """Sum of a column of doubles that does not depend on the order of the rows.

    Values are added as decimals of ten places, so equal rows give equal sums however they were dealt;
    sums of doubles differ in their last bits, which decides between ranks that are tied in truth.
    """
    return F.sum(F.col(column).cast("decimal(28,10)")).cast("double")


def hot_counted(counted: DataFrame, column: str, rows: str, share: float = 0.001) -> DataFrame:
    """Of counted values, the non-null ones that hold over `share` of all rows.

    There are at most 1 / share of them by definition, so they may be broadcast
    whatever the size of the table.
    """
    total = counted.agg(F.sum(rows).alias("__all"), F.lit(1).alias("__one"))
    kept = counted.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")
    return kept.where(F.col(column).isNotNull() & (F.col(rows) > F.col("__all") * share)).select(column)


def frequent(df: DataFrame, column: str, share: float = 0.001) -> DataFrame:
    """(v): values of a column that a sketch finds to hold over `share` of the rows, at most 1 / share.

    One aggregation to one row, no shuffle of the values.  A value may be missed or
    added at the edge of `share`: use it to spread work, never to decide a result.
    """
    most = int(1 / share)
    sketched = df.agg(F.expr(f"approx_top_k(`{column}`, {most}, {max(1024, 8 * most)})").alias("top"), F.count(F.lit(1)).alias("n"))
    return sketched.select("n", F.inline("top")).where(F.col("item").isNotNull() & (F.col("count") > F.col("n") * share)).select(F.col("item").alias("v"))


def spread_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, splits: int = 64) -> DataFrame:
    """Left join on one key whose hot and null values are spread over tasks.

    Rows whose key a sketch of `left` calls frequent are dealt over `splits` parts by
    a hash of the row, and the few matching rows of `right` are repeated for each
    part.  Null keys match nothing and are dealt out alike.  All other rows join as
    usual.  Both columns stay; the result is that of a plain left join.
    """
    kinds = dict(left.dtypes)
    if not kinds[left_key].startswith(COUNTED):
        return left.join(right, F.col(left_key) == F.col(right_key), "left")
    hot = frequent(left, left_key)
    hashed = [F.col(c) for c, k in left.dtypes if "map<" not in k and k != "variant"]
    part = F.pmod(F.xxhash64(*hashed), F.lit(splits)).cast("int")
    spread = left.join(F.broadcast(hot.select(F.col("v").alias("__hot"))), F.col(left_key) == F.col("__hot"), "left").withColumn(
        "__part", F.when(F.col("__hot").isNotNull() | F.col(left_key).isNull(), part).otherwise(0)
    ).drop("__hot")
    every = F.sequence(F.lit(0), F.lit(splits - 1))
    repeated = right.join(F.broadcast(hot.select(F.col("v").alias("__hot"))), F.col(right_key) == F.col("__hot"), "left").withColumn(
        "__side", F.explode(F.when(F.col("__hot").isNotNull(), every).otherwise(F.array(F.lit(0))))
    ).drop("__hot")
    met = spread.join(repeated, (F.col(left_key) == F.col(right_key)) & (F.col("__part") == F.col("__side")), "left")
    return met.drop("__part", "__side")


def quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Per group an array of linear-interpolation quantiles of every column, exact at any size, from one landing.

    Cells are counted by (group, column, value) first, so repeated values cost one row.
    The two neighbours of each level are the first values whose running count, taken
    over range-sorted pieces, passes them.  No group or column is ever one task.
    A column without a value in its group gives null.
    """
    keys = list(keys)
    cells = [F.struct(F.lit(i).alias("__c"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(columns)]
    values = df.select(*keys, F.inline(F.array(*cells))).where(F.col("__v").isNotNull())
    counted = values.groupBy(*keys, "__c", "__v").agg(F.count(F.lit(1)).alias("__n"))
    running = running_sums(counted, {"__until": "__n"}, [F.col("__v")], [*keys, "__c"])
    totals = running.groupBy(*keys, "__c").agg(F.max("__until").alias("__all"))
    same = [F.col(k).eqNullSafe(F.col(f"__t{i}")) for i, k in enumerate([*keys, "__c"])]
    named = totals.select(*[F.col(k).alias(f"__t{i}") for i, k in enumerate([*keys, "__c"])], "__all")
    met = running.join(named, same)
    picked = []
    for i, q in enumerate(levels):
        low = F.floor((F.col("__all") - 1) * F.lit(float(q)))
        high = F.least(low + 1, F.col("__all") - 1)
        picked += [
            F.min(F.when(F.col("__until") > low, F.col("__v"))).alias(f"__l{i}"),
            F.min(F.when(F.col("__until") > high, F.col("__v"))).alias(f"__h{i}"),
        ]
    found = met.groupBy(*keys, "__c").agg(F.max("__all").alias("__all"), *picked)
    levelled = []
    for i, q in enumerate(levels):
        place = (F.col("__all") - 1) * F.lit(float(q))
        levelled.append(F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (place - F.floor(place)))
    rows = found.select(*keys, "__c", F.array(*levelled).alias("__q"))
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("__c") == i, F.col("__q"))).alias(c) for i, c in enumerate(columns)])


def exact_quantiles(df: DataFrame, column: str, levels: Sequence[float]) -> list[float]:
    """Linear-interpolation quantiles of one column of the whole table."""
    return quantiles(df.select(F.col(column).alias("v")), ["v"], levels).first().v or []


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c, v, n): how many rows have text v in the c-th of the columns, for all columns from one scan."""
    kinds = dict(df.dtypes)
    return counted_texts(
        df, [F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c) for c in columns]
    )


def counted_texts(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    cells = [F.struct(F.lit(i).alias("c"), v.cast("string").alias("v")) for i, v in enumerate(values)]
    return df.select(F.inline(F.array(*cells))).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))


def deciles(df: DataFrame, score: str, tie: str, out: str = "decile") -> DataFrame:
    """Ten equal-frequency groups by ascending score, ties broken by `tie`.

    The first row opens group 1 and the rest follow the interpolated decile
    edges, which differs from ``ntile`` when the rows do not divide by ten.
    """
    ranked = ordered_rank(df, score, tie, out="__pos", total="__n")
    edge = F.ceil(F.try_divide((F.col("__pos") - 1) * 10, F.col("__n") - 1))
    return ranked.withColumn(
        out, F.greatest(F.coalesce(edge, F.lit(1)), F.lit(1)).cast("long")
    ).drop("__pos", "__n")


def cut_points(df: DataFrame, *columns: str) -> dict[str, list[float]]:
    """The 20/40/60/80 % cuts of each column, repeated values collapsed."""
    found = quantiles(df, columns, (0.2, 0.4, 0.6, 0.8)).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def quintile(c: Column, cuts: Sequence[float], invert: bool = False) -> Column:
    """1-based right-closed bucket of a value between fixed cuts; null is 1."""
    edges = sorted(float(x) for x in cuts)
    groups = len(edges) + 1
    bucket = F.lit(groups)
    for i in range(len(edges) - 1, -1, -1):
        bucket = F.when(c <= edges[i], F.lit(i + 1)).otherwise(bucket)
    if invert:
        bucket = F.lit(groups + 1) - bucket
    return F.when(c.isNull(), F.lit(1)).otherwise(bucket).cast("long")


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """Attach aggregates of the whole table to each row.

    The totals are one row, so joining them is a bounded broadcast; an
    unpartitioned window would instead pull every row into one task.
    """
    one = df.agg(F.lit(1).alias("__one"), *[c.alias(n) for n, c in totals.items()])
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")
