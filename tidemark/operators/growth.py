"""Why did own sales grow differently from the market?

    r - g  =  sum w_i (r_i - g_i)  +  sum (w_i - s_i) g_i

w and s are a member's weight in own sales and in the market, r and g the
growths.  The first sum is performance, the second mix.  Whatever a member
without a prior market leaves open is published as the residual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from ..functions.scale import landed

MAX_MEMBERS = 40  # of a breakdown that can be read; see `left_out`
TOP_DIMENSIONS = 4
PRICE_MOVE = 0.005


def comparable_years(df: DataFrame, day: str) -> DataFrame:
    """The last two years with data and the months both of them have."""
    months = df.where(F.col(day).isNotNull()).select(
        F.year(day).alias("year"), F.month(day).alias("month")
    ).distinct()
    current = months.agg(F.max("year").alias("current_year"), F.lit(1).alias("one"))
    previous = (
        months.withColumn("one", F.lit(1)).join(F.broadcast(current), "one")
        .where(F.col("year") < F.col("current_year"))
        .groupBy("current_year").agg(F.max("year").alias("previous_year"))
    )
    tagged = (
        months.withColumn("one", F.lit(1))
        .join(F.broadcast(previous.withColumn("one", F.lit(1))), "one")
        .where((F.col("year") == F.col("current_year")) | (F.col("year") == F.col("previous_year")))
    )
    return (
        tagged.groupBy("current_year", "previous_year", "month")
        .agg(F.count(F.lit(1)).alias("seen"))
        .where("seen = 2")
        .select("current_year", "previous_year", "month")
    )


def monthly_facts(df: DataFrame, day: str, values: Sequence[str], own: Column, dimensions: Sequence[str]) -> DataFrame:
    """Facts summed per month, `own` and combination of members, landed once.

    `day` becomes the month's first day.  All comparisons of years need only months, so every figure
    of this module comes out of these rows as out of the facts, without joining or reading them again.
    """
    month = F.trunc(day, "month").alias(day)
    return landed(df.groupBy(month, own.alias("own"), *dimensions).agg(*[F.sum(v).alias(v) for v in values]))


def _both_years(df: DataFrame, day: str, value: str, own: Column, keys: Sequence[str],
                extra: Sequence[str] = ()) -> DataFrame:
    """Sums of own and market, previous and current, per the given keys."""
    names = [f"__k{i}" for i in range(len(keys))]
    facts = monthly_facts(df.withColumns({n: F.col(k) for n, k in zip(names, keys)}), day, [value, *extra], own, names)
    periods = comparable_years(facts, day)
    marked = (
        facts.withColumns({"__month": F.month(day), "__year": F.year(day), "__own": F.col("own")})
        .join(F.broadcast(periods), F.col("__month") == F.col("month"))
        .withColumn("__now", F.col("__year") == F.col("current_year"))
        .where(F.col("__now") | (F.col("__year") == F.col("previous_year")))
    )
    sums = []
    for column in [value, *extra]:
        tag = "" if column == value else f"_{column}"
        for side, rows in (("own", F.col("__own")), ("market", F.lit(True))):
            for when, rows_when in (("0", ~F.col("__now")), ("1", F.col("__now"))):
                chosen = F.when(rows & rows_when, F.col(column))
                sums.append(F.coalesce(F.sum(chosen), F.lit(0.0)).alias(f"{side}{when}{tag}"))
    return marked.groupBy(*[F.col(n).alias(k) for n, k in zip(names, keys)]).agg(*sums)


def decompose(df: DataFrame, day: str, value: str, own: Column, dimensions: Sequence[str]) -> DataFrame:
    """Contribution of every member of every dimension, from one fact scan.

    Facts shrink first to one row per combination of members; only that table
    is then opened into (dimension, member) rows.
    """
    combos = _both_years(df, day, value, own, dimensions)
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("—")).alias("member"))
            for d in dimensions
        ]
    )
    sides = ("own0", "own1", "market0", "market1")
    sums = (
        combos.select(*sides, F.inline(pairs))
        .groupBy("dimension", "member")
        .agg(*[F.sum(c).alias(c) for c in sides])
    )
    totals = sums.groupBy("dimension").agg(
        *[F.sum(c).alias(f"t_{c}") for c in ("own0", "own1", "market0", "market1")]
    ).where("t_own0 <> 0 and t_market0 <> 0 and t_market1 <> 0")
    rows = sums.join(totals, "dimension").where("market0 <> 0")
    weight, slice_ = safe_div("own0", "t_own0"), safe_div("market0", "t_market0")
    own_growth = F.coalesce(safe_div("own1", "own0") - 1, F.lit(0.0))
    market_growth = safe_div("market1", "market0") - 1
    performance = weight * (own_growth - market_growth)
    mix = (weight - slice_) * market_growth
    return rows.select(
        "dimension", "member",
        weight.alias("weight"), slice_.alias("market_weight"),
        own_growth.alias("own_growth"), market_growth.alias("market_growth"),
        performance.alias("performance"), mix.alias("mix"), (performance + mix).alias("total"),
        "own0", "own1", "market0", "market1",
        F.coalesce(safe_div("own0", "market0"), F.lit(0.0)).alias("prior_share"),
        F.coalesce(safe_div("own1", "market1"), F.lit(0.0)).alias("share"),
        (safe_div("t_own1", "t_own0") - safe_div("t_market1", "t_market0")).alias("gap"),
    )


def decomposition_summary(members: DataFrame) -> DataFrame:
    """Per dimension: gap, performance, mix, residual, and whether it competes."""
    shared = (F.col("market1") != 0) & (F.col("share") > 0) & (F.col("share") < 0.999)
    return members.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("members"),
        F.max("gap").alias("gap"),
        F.sum("performance").alias("performance"),
        F.sum("mix").alias("mix"),
        (F.max("gap") - F.sum("performance") - F.sum("mix")).alias("residual"),
        F.sum(F.abs("total")).alias("weight"),
        F.coalesce(F.bool_or(shared), F.lit(False)).alias("competes"),
    )


def price_volume(df: DataFrame, day: str, value: str, units: str, own: Column) -> DataFrame:
    """Own growth split into a volume effect and a price effect."""
    v = _both_years(df, day, value, own, [], extra=[units])
    p0, p1 = safe_div("own0", f"own0_{units}"), safe_div("own1", f"own1_{units}")
    u0, u1 = F.col(f"own0_{units}"), F.col(f"own1_{units}")
    volume, price = (u1 - u0) * p0, (p1 - p0) * u1
    delta = F.col("own1") - F.col("own0")
    return v.select(
        p0.alias("price0"), p1.alias("price1"), (safe_div(p1, p0) - 1).alias("price_change"),
        u0.alias("units0"), u1.alias("units1"), (safe_div(u1, u0) - 1).alias("units_change"),
        volume.alias("volume_effect"), price.alias("price_effect"), delta.alias("value_change"),
        (delta - volume - price).alias("residual"),
    )


def explain_growth(df: DataFrame, day: str, value: str, own: Column, dimensions: Sequence[str]) -> DataFrame:
    """The breakdowns that explain most, straight from the facts."""
    return explain_members(decompose(df, day, value, own, dimensions))


def left_out(members: DataFrame, max_members: int = MAX_MEMBERS) -> DataFrame:
    """The dimensions that `explain_members` does not rank, with their sizes and why."""
    sizes = members.groupBy("dimension").agg(F.count(F.lit(1)).alias("members"))
    why = F.when(F.col("members") < 2, "fewer than 2 members").when(
        F.col("members") > max_members, F.lit(f"more than {max_members} members"))
    return sizes.withColumn("reason", why).where("reason is not null")


def explain_members(members: DataFrame, max_members: int = MAX_MEMBERS, top: int = TOP_DIMENSIONS) -> DataFrame:
    """The breakdowns that explain most: 2..`max_members` members, duplicates
    removed, contested dimensions first, the `top` of them.

    `left_out` names the rest.  `members` is read three times; land it when it
    is already decomposed.
    """
    sizes = members.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_members))
    members = members.join(sizes.select("dimension"), "dimension", "left_semi")
    prints = members.groupBy("dimension").agg(
        F.sort_array(F.collect_list(F.round("total", 9))).alias("print")  # at most max_members values
    )
    kept = prints.groupBy("print").agg(F.min("dimension").alias("dimension")).select("dimension")
    summary = decomposition_summary(members).join(kept, "dimension", "left_semi")
    order = Window.orderBy(F.desc("competes"), F.desc("weight"), "dimension")  # one row per dimension
    best = summary.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return best.select("rank", "dimension", "members", "gap", "performance", "mix", "residual", "competes")


def opportunities(members: DataFrame, explained: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """What to act on: the worst three and best two members of the two leading
    dimensions, and the price move when it is material.

    Weights of members are points of share; a price move weighs its amount.
    """
    leading = explained.where("rank <= 2").select("dimension")
    rows = members.join(leading, "dimension", "left_semi")
    worst = Window.partitionBy("dimension").orderBy("total", "member")
    best = Window.partitionBy("dimension").orderBy(F.desc("total"), "member")
    low = (
        rows.where("total < 0").withColumn("r", F.row_number().over(worst)).where("r <= 3")
        .withColumn("kind", F.when(F.abs("performance") >= F.abs("mix"), "performance").otherwise("mix"))
    )
    high = (
        rows.where("total > 0").withColumn("r", F.row_number().over(best)).where("r <= 2")
        .withColumn("kind", F.lit("strength"))
    )
    out = low.unionByName(high).select(
        "kind", "dimension", "member", (F.abs("total") * 100).alias("weight"), "own_growth", "market_growth"
    )
    if prices is not None:
        out = out.unionByName(
            prices.where(F.abs("price_change") > PRICE_MOVE).select(
                F.lit("price").alias("kind"), F.lit("—").alias("dimension"), F.lit("—").alias("member"),
                F.abs("price_effect").alias("weight"), F.col("units_change").alias("own_growth"),
                F.lit(None).cast("double").alias("market_growth"),
            )
        )
    return out
