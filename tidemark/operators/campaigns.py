"""Did the campaign work?  Difference in differences over daily sales.

Sales enter as (day, product, client, units, amount, cost, segments...).  The
calendar is exploded to one row per window day once; every figure of the panel
then comes out of a single grouping-sets aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import date_from_key, pct_change, safe_div
from ..functions.scale import cut_points, landed, quantiles, quintile
from .joins import explode_days, first_matching_interval, interval_join, mark_scope

EDITION = ["campaign", "edition"]

# Default windows and the thresholds of each judgement.
BASELINE_DAYS, CARRY_DAYS, BLACKOUT_DAYS = 28, 28, 7
INFLATED = 0.03
CONTROL_MAX_FALL = 25.0
SUBSTITUTION = -5.0
CARRY_FALL = -15.0
SMALL_COHORT = 15
WINDOWS = ["baseline", "blackout", "during", "carry"]


class CampaignError(ValueError):
    """Calendar or sales that cannot be measured."""


def prepare_sales(df: DataFrame, day: str, units: str, amount: str, cost: str | None = None) -> DataFrame:
    """Rows with a valid day; text dates and integer keys are parsed."""
    kind = dict(df.dtypes)[day]
    parsed = F.col(day).cast("date") if kind.startswith(("date", "timestamp")) else date_from_key(day)
    out = df.withColumn("day", parsed).withColumn("units", F.col(units).cast("double"))
    out = out.withColumn("amount", F.col(amount).cast("double"))
    out = out.withColumn("cost", F.col(cost).cast("double") if cost else F.lit(None).cast("double"))
    return out.where("day is not null")


def invalid_days(df: DataFrame, day: str) -> DataFrame:
    """How many rows `prepare_sales` leaves out."""
    kind = dict(df.dtypes)[day]
    parsed = F.col(day).cast("date") if kind.startswith(("date", "timestamp")) else date_from_key(day)
    return df.agg(F.count_if(parsed.isNull()).alias("invalid_days"), F.count(F.lit(1)).alias("rows"))


def number_editions(calendar: DataFrame) -> DataFrame:
    """Running number per campaign by start; labels do not sort by themselves."""
    span = Window.partitionBy("campaign").orderBy("from_day", "edition")
    return calendar.withColumn("edition_number", F.row_number().over(span).cast("bigint"))


def campaign_calendar(df: DataFrame, campaign: str = "campaign", edition: str = "edition",
                      start: str = "from_day", end: str = "to_day", strict: bool = True) -> DataFrame:
    """Normalised calendar; an edition that ends before it starts is an error."""
    out = df.select(
        F.col(campaign).alias("campaign"),
        F.col(edition).alias("edition"),
        F.col(start).try_cast("date").alias("from_day"),
        F.col(end).try_cast("date").alias("to_day"),
    )
    good = F.coalesce(F.col("to_day") >= F.col("from_day"), F.lit(False))
    if strict:
        bad = out.where(~good).limit(3).collect()
        if bad:
            raise CampaignError(f"editions with invalid dates: {[(r.campaign, r.edition) for r in bad]}")
    out = out.where(good).withColumn("days", (F.datediff("to_day", "from_day") + 1).cast("bigint"))
    return landed(number_editions(out))


def prior_editions(calendar: DataFrame) -> DataFrame:
    """Each edition paired with the previous one and the one before that."""
    span = Window.partitionBy("campaign").orderBy("from_day", "edition")
    this = F.struct("edition", "from_day", "to_day", "days")
    lags = calendar.withColumns({"__p1": F.lag(this, 1).over(span), "__p2": F.lag(this, 2).over(span)})
    pairs = F.array_compact(
        F.array(
            F.when(F.col("__p1").isNotNull(), F.struct(F.lit("previous").alias("relation"), F.col("__p1").alias("against"))),
            F.when(F.col("__p2").isNotNull(), F.struct(F.lit("one_before").alias("relation"), F.col("__p2").alias("against"))),
        )
    )
    return lags.select("campaign", "edition", "from_day", "to_day", "days", F.inline(pairs)).select(
        "campaign", "edition", "from_day", "to_day", "days", "relation",
        F.col("against.edition").alias("against"),
        F.col("against.from_day").alias("against_from"),
        F.col("against.to_day").alias("against_to"),
        F.col("against.days").alias("against_days"),
    )


def campaign_windows(calendar: DataFrame, baseline: int = BASELINE_DAYS, carry: int = CARRY_DAYS,
                     blackout: int = BLACKOUT_DAYS) -> DataFrame:
    """Four closed windows per edition.

    The days just before the start are set apart: the announcement already
    bends them, so they may not serve as baseline.  A window of zero days has
    null bounds.
    """
    start, end = F.col("from_day"), F.col("to_day")
    none = F.lit(None).cast("date")
    base_end = F.date_sub(start, blackout + 1)
    bounds = {
        "baseline": (F.date_sub(base_end, baseline - 1), base_end),
        "blackout": (F.date_sub(start, blackout), F.date_sub(start, 1)) if blackout else (none, none),
        "during": (start, end),
        "carry": (F.date_add(end, 1), F.date_add(end, carry)) if carry else (none, none),
    }
    rows = F.array(
        *[
            F.struct(F.lit(w).alias("time_window"), a.alias("__a"), b.alias("__b"))
            for w, (a, b) in bounds.items()
        ]
    )
    return calendar.select(*EDITION, F.inline(rows)).select(
        *EDITION, "time_window", F.col("__a").alias("from_day"), F.col("__b").alias("to_day"),
        F.coalesce(F.datediff("__b", "__a") + 1, F.lit(0)).cast("bigint").alias("days"),
    )


def campaign_scope(scope: DataFrame) -> DataFrame:
    """Distinct (campaign, edition, product), landed.

    Rows are dealt to all shuffle partitions before any are held: nearly all differ, so distinct rows
    held where few files are read, or where small bytes are joined to few tasks, would crowd a task.
    """
    tasks = int(scope.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return landed(scope.select(*EDITION, "product").repartition(tasks, *EDITION, "product").distinct())


def _in_windows(sales: DataFrame, windows: DataFrame, scope: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Sales repeated per window that holds their day, flagged by group, and the names of the windows.

    A sale carries its windows and editions as the numbers __w and __e, never as texts, and
    meets the scope as one row a product that lists the editions, before it is repeated.
    """
    numbers = windows.withColumns({"__w": F.xxhash64(*EDITION, "time_window"), "__e": F.xxhash64(*EDITION)})
    names = numbers.select("__w", *EDITION, "time_window").distinct()
    days = explode_days(numbers.select("__w", "__e", "from_day", "to_day")).select("day", "__w", "__e")
    if scope is None:
        return sales.join(days, "day").withColumn("arm", F.lit("campaign")), names
    editions = scope.select("product", F.xxhash64(*EDITION).alias("__e"))
    of_product = editions.groupBy("product").agg(F.collect_set("__e").alias("__in"))
    has_scope = editions.select("__e").distinct().withColumn("__has", F.lit(True))
    rows = sales.join(of_product, "product", "left").join(days, "day").join(has_scope, "__e", "left")
    inside = F.coalesce(F.array_contains("__in", F.col("__e")), F.lit(False)) | F.col("__has").isNull()
    return rows.withColumn("arm", F.when(inside, F.lit("campaign")).otherwise(F.lit("control"))).drop("__in", "__has"), names


def _measures(frame: DataFrame) -> DataFrame:
    """Per-day, price and margin figures from the summed columns."""
    days, units, amount = F.col("days"), F.col("units"), F.col("amount")
    return frame.withColumns(
        {
            "units_day": safe_div(units, days),
            "amount_day": safe_div(amount, days),
            "mean_price": safe_div(amount, units),
            "margin": amount - F.col("cost"),
            "margin_day": safe_div(amount - F.col("cost"), days),
            "margin_pct": safe_div(amount - F.col("cost"), amount) * 100,
        }
    )


def campaign_panel(sales: DataFrame, windows: DataFrame, scope: DataFrame | None = None,
                   segments: Sequence[str] = ()) -> DataFrame:
    """All measures per edition, dimension member, arm and window.

    TOTAL and every segment come from one grouping-sets pass.  The grid of
    windows and members stands on the left, so a window without sales shows
    zeros instead of vanishing.
    """
    rows, names = _in_windows(sales, windows, scope)
    base = [*EDITION, "arm", "time_window"]
    short = ["__w", "arm"]
    sets = [short, *[[*short, s] for s in segments]]
    every = [*short, *segments]
    level = F.grouping_id(*every)
    sums = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(c).alias(c) for c in ("units", "amount", "cost")],
        F.countDistinct("client").alias("clients"),
        level.alias("__level"),
    )
    dimension, member = F.lit("TOTAL"), F.lit("TOTAL")
    for i, s in enumerate(segments):
        mask = 1 << (len(segments) - 1 - i)
        grouped = (F.col("__level").bitwiseAND(F.lit(mask))) == 0
        dimension = F.when(grouped, F.lit(s)).otherwise(dimension)
        member = F.when(grouped, F.col(s).cast("string")).otherwise(member)
    # read twice, for the grid and for its cells; a row a member, small beside the sales
    sums = landed(sums.join(names, "__w").select(*base, dimension.alias("dimension"), member.alias("member"),
                              "rows", "units", "amount", "cost", "clients"))

    # every window for each member that any window saw, and for the total; members are never collected
    dimensions = F.array(*[F.lit(d) for d in ("TOTAL", *segments)])
    seen = sums.where("member is not null and dimension <> 'TOTAL'").select("dimension", "member").distinct()
    whole = windows.withColumn("dimension", F.lit("TOTAL")).withColumn("member", F.lit("TOTAL"))
    of_each = windows.withColumn("dimension", F.explode(dimensions)).join(seen, "dimension")
    grid = whole.unionByName(of_each)
    arms = F.array(F.lit("campaign"), F.lit("control")) if scope is not None else F.array(F.lit("campaign"))
    if scope is not None:
        has_scope = scope.select(*EDITION, F.lit(True).alias("__has")).distinct()
        grid = grid.join(has_scope, EDITION, "left")
        arms = F.when(F.col("__has"), arms).otherwise(F.array(F.lit("campaign")))
        grid = grid.withColumn("arm", F.explode(arms)).drop("__has")
    else:
        grid = grid.withColumn("arm", F.explode(arms))
    filled = grid.join(sums, [*base, "dimension", "member"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in
            (("rows", "bigint"), ("units", "double"), ("amount", "double"), ("clients", "bigint"))}
    return _measures(filled.withColumns(zero))


def campaign_effect(panel: DataFrame) -> DataFrame:
    """One row per edition and member: lift and increment against the control.

    The counterfactual is the baseline moved as the control moved.  A control
    that fell too far is no longer one and the flat baseline is used instead,
    which the `method` column states.
    """
    def pick(arm: str, window: str, column: str) -> Column:
        chosen = (F.col("arm") == arm) & (F.col("time_window") == window)
        return F.max(F.when(chosen, F.col(column)))

    wanted = ["days", "rows", "units_day", "mean_price", "margin_day", "margin_pct", "clients"]
    aggregates = []
    for arm, a in (("campaign", "t"), ("control", "c")):
        for window, w in (("baseline", "b"), ("during", "d"), ("carry", "a")):
            aggregates += [pick(arm, window, col).alias(f"{a}_{w}_{col}") for col in wanted]
    wide = panel.groupBy(*EDITION, "dimension", "member").agg(*aggregates)

    c = F.col
    has_control = F.coalesce((c("c_b_rows") > 0) & (c("c_b_units_day") != 0), F.lit(False))
    move_d = F.coalesce(safe_div("c_d_units_day", "c_b_units_day"), F.lit(1.0))
    move_a = F.coalesce(safe_div("c_a_units_day", "c_b_units_day"), F.lit(1.0))
    carried = F.coalesce(c("t_a_days") > 0, F.lit(False))
    wide = wide.withColumns(
        {
            "comparable": F.coalesce((c("t_b_rows") > 0) & (c("t_b_units_day") != 0), F.lit(False)),
            "control_during_pct": F.when(has_control, (move_d - 1) * 100),
            "control_carry_pct": F.when(has_control & carried, (move_a - 1) * 100),
        }
    )
    dropped = F.coalesce(has_control & (c("control_during_pct") < -CONTROL_MAX_FALL), F.lit(False))
    use = has_control & ~dropped

    def factor(window: str, column: str) -> Column:
        moved = F.coalesce(safe_div(f"c_{window}_{column}", f"c_b_{column}"), F.lit(1.0))
        return F.when(use, moved).otherwise(F.lit(1.0))

    expected_d = c("t_b_units_day") * factor("d", "units_day")
    expected_a = c("t_b_units_day") * factor("a", "units_day")
    more_units = (c("t_d_units_day") - expected_d) * c("t_d_days") + F.when(
        carried, (F.coalesce("t_a_units_day", F.lit(0.0)) - expected_a) * c("t_a_days")
    ).otherwise(0.0)
    margin_d = (c("t_d_margin_day") - c("t_b_margin_day") * factor("d", "margin_day")) * c("t_d_days")
    margin_a = F.when(
        carried & c("t_a_margin_day").isNotNull(),
        (c("t_a_margin_day") - c("t_b_margin_day") * factor("a", "margin_day")) * c("t_a_days"),
    )
    ok = c("comparable")
    effect = wide.select(
        *EDITION, "dimension", "member", "comparable",
        F.when(use, F.lit("diff_in_diff")).otherwise(F.lit("baseline")).alias("method"),
        c("t_d_days").alias("campaign_days"),
        c("t_b_units_day").alias("units_day_baseline"),
        c("t_d_units_day").alias("units_day_campaign"),
        c("t_a_units_day").alias("units_day_carry"),
        pct_change("t_d_units_day", "t_b_units_day").alias("gross_lift_pct"),
        F.when(ok, expected_d).alias("counterfactual_units_day"),
        F.when(ok, pct_change(c("t_d_units_day"), expected_d)).alias("lift_pct"),
        F.when(ok, more_units).alias("incremental_units"),
        F.when(ok, margin_d).alias("incremental_margin_during"),
        F.when(ok, margin_a).alias("incremental_margin_carry"),
        F.when(ok, margin_d + F.coalesce(margin_a, F.lit(0.0))).alias("incremental_margin"),
        pct_change("t_d_mean_price", "t_b_mean_price").alias("price_change_pct"),
        (c("t_d_margin_pct") - c("t_b_margin_pct")).alias("margin_change_pp"),
        pct_change("t_a_units_day", "t_b_units_day").alias("carry_units_pct"),
        c("t_d_clients").alias("campaign_clients"),
        "control_during_pct", "control_carry_pct",
        dropped.alias("control_dropped"),
        F.coalesce(has_control & (c("control_during_pct") < SUBSTITUTION), F.lit(False)).alias("substitution"),
    )
    return effect.withColumn("verdict", verdict())


def verdict() -> Column:
    """Ordered questions: comparable, earned, new volume, taken from where."""
    units, margin = F.col("incremental_units"), F.col("incremental_margin")
    during = F.col("incremental_margin_during")
    lost = margin < 0
    return (
        F.when(~F.col("comparable"), "not_comparable")
        .when(lost & (units > 0) & (during < 0), "sold_more_earned_less")
        .when(lost & (units > 0), "carry_over_eats_margin")
        .when(lost, "worse")
        .when(units <= 0, "pulled_forward")
        .when(F.col("control_dropped"), "incremental_without_control")
        .when(F.col("substitution"), "incremental_with_substitution")
        .when(F.col("carry_units_pct") < CARRY_FALL, "incremental_with_carry_over")
        .otherwise("incremental")
    )


def campaign_price(sales: DataFrame, windows: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Real discount against the clean window, apparent against the days before.

    Prices are amount over units per product and window.  The gap between both
    discounts is what was made by raising the price first.
    """
    rows, names = _in_windows(sales, windows, scope)
    if scope is not None:  # editions without a scope have no prices
        rows = rows.join(scope.select(F.xxhash64(*EDITION).alias("__e")).distinct(), "__e", "left_semi").where(F.col("arm") == "campaign")
    each = rows.groupBy("__w", "product").agg(F.sum("amount").alias("amount"), F.sum("units").alias("units"))
    sums = each.join(names, "__w").groupBy(*EDITION, "product").agg(
        *[
            F.sum(F.when(F.col("time_window") == w, F.col(m))).alias(f"{w}_{m}")
            for w in ("baseline", "blackout", "during")
            for m in ("amount", "units")
        ]
    )

    def price(w):
        return F.when(F.col(f"{w}_units") > 0, safe_div(f"{w}_amount", f"{w}_units"))

    priced = sums.select(
        *EDITION, "product",
        price("baseline").alias("reference_price"),
        price("blackout").alias("price_before"),
        price("during").alias("campaign_price"),
    ).where("campaign_price is not null")
    real, apparent = pct_change("campaign_price", "reference_price"), pct_change("campaign_price", "price_before")
    inflated = F.coalesce(F.col("price_before") > F.col("reference_price") * (1 + INFLATED), F.lit(False))
    return priced.withColumns(
        {
            "real_discount_pct": -real,
            "apparent_discount_pct": -apparent,
            "fabricated_points": real - apparent,
            "inflated_before": inflated,
            "rise_before_pct": F.when(inflated, pct_change("price_before", "reference_price")),
        }
    )


def stock_censoring(stock: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per edition and product: days out of stock and whether sales are a floor.

    Stock is (product, day, available); a missing reading counts as none.
    """
    rows = interval_join(stock, calendar.select(*EDITION, "from_day", "to_day", "days"))
    empty = F.coalesce(F.col("available"), F.lit(0)) <= 0
    return (
        rows.groupBy(*EDITION, "product")
        .agg(
            F.max("days").alias("campaign_days"),
            F.countDistinct("day").alias("days_with_data"),
            F.count_if(empty).alias("days_without_stock"),
            F.avg("available").alias("mean_available"),
        )
        .withColumn(
            "coverage_pct",
            (1 - safe_div("days_without_stock", F.greatest("days_with_data", F.lit(1)))) * 100,
        )
        .withColumn("censored", F.col("days_without_stock") > 0)
    )


def vs_editions(sales: DataFrame, calendar: DataFrame, scope: DataFrame | None = None,
                stock: DataFrame | None = None) -> DataFrame:
    """Each edition against the previous two, per day, mix set apart.

    Like-for-like keeps products present in both editions and never out of
    stock in either; the rest of the change is mix.
    """
    columns = ["product", "client", "units", "amount", "cost"]
    during = interval_join(sales.select("day", *columns), calendar.select(*EDITION, "from_day", "to_day"))
    per_product = during.groupBy(*EDITION, "product").agg(
        F.sum("units").alias("units"), F.sum("amount").alias("amount"), F.sum("cost").alias("cost")
    )
    clients = during.groupBy(*EDITION).agg(F.countDistinct("client").alias("clients"))
    members = per_product.select(*EDITION, "product") if scope is None else campaign_scope(scope)
    if stock is not None:
        censored = stock.where("censored").select(*EDITION, "product", F.lit(True).alias("censored"))
        members = members.join(censored, [*EDITION, "product"], "left")
    else:
        members = members.withColumn("censored", F.lit(None).cast("boolean"))
    pairs = prior_editions(calendar)

    sizes = members.groupBy(*EDITION).agg(F.count(F.lit(1)).alias("products"))
    now = pairs.join(members, EDITION).select("campaign", "edition", "against", "product", F.col("censored").alias("c1"))
    then = members.select("campaign", F.col("edition").alias("against"), "product", F.col("censored").alias("c2"))
    both = now.join(then, ["campaign", "against", "product"]).withColumn(
        "clean", F.col("c1").isNull() & F.col("c2").isNull()
    )
    counts = both.groupBy("campaign", "edition", "against").agg(
        F.count_if("clean").alias("products_like"), F.count_if(~F.col("clean")).alias("excluded_by_stock")
    )
    lfl = both.where("clean").select("campaign", "edition", "against", "product")
    like_now = lfl.join(per_product, [*EDITION, "product"]).groupBy("campaign", "edition", "against").agg(
        F.sum("units").alias("like_units")
    )
    earlier = per_product.select("campaign", F.col("edition").alias("against"), "product", F.col("units").alias("u2"))
    like_then = lfl.join(earlier, ["campaign", "against", "product"]).groupBy("campaign", "edition", "against").agg(
        F.sum("u2").alias("like_units_against")
    )
    totals = per_product.groupBy(*EDITION).agg(
        F.sum("units").alias("units"), F.sum("amount").alias("amount"), F.sum("cost").alias("cost")
    )
    facts = calendar.select(*EDITION, "days").join(totals, EDITION, "left").join(clients, EDITION, "left").join(sizes, EDITION, "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in (("units", "double"), ("amount", "double"), ("clients", "bigint"), ("products", "bigint"))}
    facts = _measures(facts.withColumns(zeros)).select(
        *EDITION, "units", "units_day", "mean_price", "margin_pct", "margin_day", "clients", "products"
    )
    other = facts.select("campaign", F.col("edition").alias("against"),
                         *[F.col(c).alias(f"{c}_against") for c in facts.columns if c not in EDITION])
    pair = ["campaign", "edition", "against"]
    out = (
        pairs.select(*pair, "relation", "days", "against_days")
        .join(facts, EDITION)
        .join(other, ["campaign", "against"])
        .join(counts, pair, "left")
        .join(like_now, pair, "left")
        .join(like_then, pair, "left")
    )
    like = F.coalesce("products_like", F.lit(0))
    total_change = pct_change("units_day", "units_day_against")
    like_change = F.when(
        like > 0,
        pct_change(
            safe_div(F.coalesce("like_units", F.lit(0.0)), "days"),
            safe_div(F.coalesce("like_units_against", F.lit(0.0)), "against_days"),
        ),
    )
    return out.select(
        *pair, "relation", "days", "against_days", "units_day", "units_day_against",
        total_change.alias("units_change_pct"),
        pct_change("mean_price", "mean_price_against").alias("price_change_pct"),
        (F.col("margin_pct") - F.col("margin_pct_against")).alias("margin_change_pp"),
        pct_change("margin_day", "margin_day_against").alias("margin_day_change_pct"),
        "products", "products_against", like.alias("products_like"),
        F.coalesce("excluded_by_stock", F.lit(0)).alias("excluded_by_stock"),
        F.when(like > 0, safe_div(F.coalesce("like_units", F.lit(0.0)), "units") * 100).alias("like_coverage_pct"),
        like_change.alias("like_units_change_pct"),
        (total_change - like_change).alias("mix_effect_pp"),
        "clients", "clients_against",
    )


def rfm_label(r: Column, f: Column) -> Column:
    """Eleven segments from the recency and frequency quintiles (5 = best)."""
    return (
        F.when((r >= 4) & (f >= 4), "Champions")
        .when((r >= 3) & (f >= 4), "Loyal")
        .when((r >= 4) & (f == 3), "Potential")
        .when((r == 5) & (f <= 2), "New")
        .when((r >= 4) & (f <= 2), "Promising")
        .when((r == 3) & (f == 3), "Need attention")
        .when((r == 3) & (f <= 2), "About to sleep")
        .when((r == 2) & (f >= 3), "At risk")
        .when((r == 1) & (f >= 4), "Cannot lose")
        .when((r == 2) & (f <= 2), "Hibernating")
        .otherwise("Lost")
    )


def rfm_cuts(clients: DataFrame) -> dict[str, list[float]]:
    return cut_points(clients, "recency_days", "frequency", "monetary")


def rfm(sales: DataFrame, as_of: date, window_days: int = 365,
        cuts: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """Recency, frequency, monetary quintiles and segment per client.

    Fixed `cuts` make two runs comparable; otherwise they are measured here
    (see `rfm_cuts`), all in one pass over the written clients, and the segments move
    with them.
    """
    until = F.lit(as_of).cast("date")
    inside = sales.where(F.col("day").between(F.date_sub(until, window_days - 1), until))
    daily = inside.groupBy("client", "day").agg(F.sum("amount").alias("amount"), F.sum("units").alias("units"))
    clients = daily.groupBy("client").agg(
        F.max("day").alias("last_purchase"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("amount").alias("monetary"),
        F.sum("units").alias("units"),
    ).withColumn("recency_days", F.datediff(until, "last_purchase").cast("bigint"))
    if not cuts:
        clients = landed(clients)
        cuts = rfm_cuts(clients)
    scored = clients.withColumns(
        {
            "r": quintile(F.col("recency_days"), cuts["recency_days"], invert=True),
            "f": quintile(F.col("frequency"), cuts["frequency"]),
            "m": quintile(F.col("monetary"), cuts["monetary"]),
        }
    )
    return scored.withColumn("segment", rfm_label(F.col("r"), F.col("f")))


def rfm_reach(sales: DataFrame, segments: DataFrame, calendar: DataFrame) -> DataFrame:
    """Whom did each edition reach: figures per edition and RFM segment."""
    rows = interval_join(sales, calendar.select(*EDITION, "from_day", "to_day"))
    per_client = rows.groupBy(*EDITION, "client").agg(
        F.sum("units").alias("units"), F.sum("amount").alias("amount"), F.sum("cost").alias("cost")
    )
    labelled = per_client.join(segments.select("client", "segment"), "client", "left").withColumn(
        "segment", F.coalesce("segment", F.lit("Unclassified"))
    )
    grouped = labelled.groupBy(*EDITION, "segment").agg(
        F.count(F.lit(1)).alias("clients"),
        F.sum("units").alias("units"),
        F.sum("amount").alias("amount"),
        F.sum("cost").alias("cost"),
    )
    whole = Window.partitionBy(*EDITION)  # at most twelve segments
    return grouped.withColumns(
        {
            "amount_share_pct": safe_div("amount", F.sum("amount").over(whole)) * 100,
            "margin": F.col("amount") - F.col("cost"),
            "margin_pct": safe_div(F.col("amount") - F.col("cost"), "amount") * 100,
        }
    )


# Period start and running index of each cohort granularity.
COHORT_PERIODS = {
    "monthly": ("month", lambda d: F.year(d) * 12 + F.month(d)),
    "quarterly": ("quarter", lambda d: F.year(d) * 4 + F.quarter(d)),
    "weekly": ("week", lambda d: F.floor(F.datediff(d, F.lit(date(1970, 1, 5))) / 7)),
}


def _client_periods(sales: DataFrame, granularity: str) -> DataFrame:
    """One row per client and active period, with the client's first period."""
    unit, index = COHORT_PERIODS[granularity]
    active = (
        sales.withColumn("period", F.trunc("day", unit))
        .groupBy("client", "period")
        .agg(F.sum("units").alias("units"), F.sum("amount").alias("amount"), F.min("day").alias("first_day"))
    )
    first = active.groupBy("client").agg(
        F.min("period").alias("cohort"), F.min("first_day").alias("first_purchase")
    )
    return active.drop("first_day").join(first, "client").withColumn(
        "period_index", (index(F.col("period")) - index(F.col("cohort"))).cast("bigint")
    )


def cohorts(sales: DataFrame, granularity: str = "monthly", periods: int = 6) -> DataFrame:
    """Retention by first-purchase period, with maturity and sample flags."""
    _, index = COHORT_PERIODS[granularity]
    rows = _client_periods(sales, granularity)
    last = rows.agg(F.max("period").alias("last_period"), F.lit(1).alias("one"))
    sizes = rows.where("period_index = 0").groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_clients"))
    kept = (
        rows.where(F.col("period_index").between(0, periods))
        .groupBy("cohort", "period_index")
        .agg(F.count(F.lit(1)).alias("clients"), F.sum("units").alias("units"), F.sum("amount").alias("amount"))
    )
    observable = (index(F.col("last_period")) - index(F.col("cohort"))).cast("bigint")
    return (
        kept.join(sizes, "cohort")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(last), "one")
        .select(
            "cohort", "period_index", "clients", "units", "amount", "cohort_clients",
            (safe_div("clients", "cohort_clients") * 100).alias("retention_pct"),
            observable.alias("observable_periods"),
            (observable >= periods).alias("mature"),
            (F.col("cohort_clients") < SMALL_COHORT).alias("small_sample"),
        )
    )


def cohorts_by_origin(sales: DataFrame, calendar: DataFrame, granularity: str = "monthly", periods: int = 6) -> DataFrame:
    """Retention of clients won inside each campaign against those won outside."""
    rows = _client_periods(sales, granularity)
    labelled = first_matching_interval(
        rows, "first_purchase", calendar.select("campaign", "from_day", "to_day"),
        "campaign", ["campaign", "from_day"], "origin", "outside campaigns",
    )
    sizes = labelled.where("period_index = 0").groupBy("origin").agg(F.count(F.lit(1)).alias("origin_clients"))
    kept = (
        labelled.where(F.col("period_index").between(0, periods))
        .groupBy("origin", "period_index")
        .agg(F.count(F.lit(1)).alias("clients"), F.sum("amount").alias("amount"))
    )
    return kept.join(sizes, "origin").select(
        "origin", "period_index", "clients", "amount", "origin_clients",
        (safe_div("clients", "origin_clients") * 100).alias("retention_pct"),
        (F.col("origin_clients") < SMALL_COHORT).alias("small_sample"),
    )


def campaign_alerts(effect: DataFrame, prices: DataFrame | None = None, origins: DataFrame | None = None,
                    stock: DataFrame | None = None) -> DataFrame:
    """What to look at first, one row per alert."""
    dash = F.lit("—")
    none = F.lit(None).cast("double")
    bad = ["pulled_forward", "sold_more_earned_less", "worse", "not_comparable"]
    out = effect.where((F.col("dimension") == "TOTAL") & F.col("verdict").isin(bad)).select(
        *EDITION, F.col("verdict").alias("alert"), F.lit(1).cast("bigint").alias("items"),
        none.alias("median_rise_pct"), none.alias("median_real_pct"), none.alias("median_apparent_pct"),
    )
    if prices is not None:
        risen = landed(prices.where("inflated_before"))
        shown = {"median_rise_pct": "rise_before_pct", "median_real_pct": "real_discount_pct", "median_apparent_pct": "apparent_discount_pct"}
        medians = quantiles(risen, list(shown.values()), [0.5], EDITION)
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in EDITION]
        out = out.unionByName(
            risen.groupBy(*EDITION).agg(F.count(F.lit(1)).alias("items"))
            .join(medians.withColumnsRenamed({k: f"__{k}" for k in EDITION}), same, "left")
            .select(*EDITION, F.lit("inflated_discount").alias("alert"), "items", *[F.col(c)[0].alias(n) for n, c in shown.items()])
        )
    for df, column, name in ((origins, "small_sample", "small_cohort"), (stock, "censored", "censored_measure")):
        if df is None:
            continue
        items = F.countDistinct("origin") if name == "small_cohort" else F.count(F.lit(1))
        out = out.unionByName(
            df.where(column)
            .agg(items.alias("items"))
            .where("items > 0")
            .select(dash.alias("campaign"), dash.alias("edition"), F.lit(name).alias("alert"), "items",
                    none.alias("median_rise_pct"), none.alias("median_real_pct"), none.alias("median_apparent_pct"))
        )
    return out
