"""Arithmetic by construction: daily constant sales around one edition."""

from datetime import date, timedelta

import pytest

from tidemark.operators import campaigns as c

START, END = date(2025, 3, 1), date(2025, 3, 10)


@pytest.fixture
def cal(spark):
    return c.campaign_calendar(spark.createDataFrame([("spring", "e1", START, END)], "campaign string, edition string, from_day date, to_day date"))


def shop(spark, product, levels, price=10.0, cost=6.0, client="c1"):
    """Units per day by window, from the first baseline day to the last carry day."""
    rows = []
    day = START - timedelta(days=35)
    while day <= END + timedelta(days=28):
        key = "during" if START <= day <= END else "after" if day > END else "blackout" if (START - day).days <= 7 else "before"
        units, p = levels.get(key, levels["before"]), price
        if isinstance(units, tuple):
            units, p = units
        rows.append((day, product, client, float(units), float(units * p), float(units * cost)))
        day += timedelta(days=1)
    return spark.createDataFrame(rows, "day date, product string, client string, units double, amount double, cost double")


def effect(spark, cal, treated, control=None):
    sales, scope = treated, None
    if control is not None:
        sales = treated.union(control)
        scope = spark.createDataFrame([("spring", "e1", "a")], "campaign string, edition string, product string")
    return c.campaign_effect(c.campaign_panel(sales, c.campaign_windows(cal), scope)).first()


def test_windows(cal):
    w = {r.time_window: (r.from_day, r.to_day, r.days) for r in c.campaign_windows(cal, baseline=20, carry=10, blackout=5).collect()}
    assert w["baseline"] == (date(2025, 2, 4), date(2025, 2, 23), 20)
    assert w["blackout"] == (date(2025, 2, 24), date(2025, 2, 28), 5)
    assert w["carry"] == (date(2025, 3, 11), date(2025, 3, 20), 10)


def test_bad_calendar_is_refused(spark):
    with pytest.raises(c.CampaignError):
        c.campaign_calendar(spark.createDataFrame([("x", "e", END, START)], "campaign string, edition string, from_day date, to_day date"))


def test_sales_only_pulled_forward(spark, cal):
    e = effect(spark, cal, shop(spark, "a", {"before": 10, "during": 22, "after": 1}))
    assert e.gross_lift_pct == pytest.approx(120)
    assert e.incremental_units == pytest.approx((22 - 10) * 10 + (1 - 10) * 28) and e.incremental_units < 0
    assert e.verdict == "worse" or e.verdict == "pulled_forward"
    assert e.method == "baseline"


def test_below_cost_is_no_success(spark, cal):
    e = effect(spark, cal, shop(spark, "a", {"before": 10, "during": (20, 5.0)}))
    assert e.gross_lift_pct == pytest.approx(100) and e.verdict == "sold_more_earned_less"


def test_margin_lost_after_the_campaign(spark, cal):
    e = effect(spark, cal, shop(spark, "a", {"before": 10, "during": 25, "after": (9.8, 6.5)}))
    assert e.incremental_margin_during > 0 > e.incremental_margin and e.verdict == "carry_over_eats_margin"


def test_rising_control_discounts_the_season(spark, cal):
    flat = effect(spark, cal, shop(spark, "a", {"before": 10, "during": 15}))
    fair = effect(spark, cal, shop(spark, "a", {"before": 10, "during": 15}), shop(spark, "b", {"before": 10, "during": 14}))
    assert fair.method == "diff_in_diff" and not fair.control_dropped
    assert fair.lift_pct == pytest.approx((15 / 14 - 1) * 100) and fair.lift_pct < flat.lift_pct


def test_falling_control_flags_substitution(spark, cal):
    e = effect(spark, cal, shop(spark, "a", {"before": 10, "during": 15}), shop(spark, "b", {"before": 10, "during": 9}))
    assert e.substitution and e.verdict == "incremental_with_substitution"


def test_collapsed_control_is_discarded(spark, cal):
    e = effect(spark, cal, shop(spark, "a", {"before": 10, "during": 15}), shop(spark, "b", {"before": 10, "during": 3}))
    assert e.control_dropped and e.method == "baseline" and e.lift_pct == pytest.approx(50)
    assert e.verdict == "incremental_without_control"


def test_no_baseline_is_not_comparable(spark, cal):
    e = effect(spark, cal, shop(spark, "a", {"before": 10}).where(f"day >= '{START}'"))
    assert not e.comparable and e.verdict == "not_comparable" and e.lift_pct is None


def test_price_raised_before(spark, cal):
    s = shop(spark, "a", {"before": 10, "blackout": (10, 11.4), "during": (12, 9.0)})
    p = c.campaign_price(s, c.campaign_windows(cal)).first()
    assert p.inflated_before and p.rise_before_pct == pytest.approx(14)
    assert p.real_discount_pct == pytest.approx(10)
    assert p.fabricated_points == pytest.approx(p.apparent_discount_pct - p.real_discount_pct)


def test_empty_window_shows_zero(spark, cal):
    p = c.campaign_panel(shop(spark, "a", {"before": 10}).where(f"day < '{START}'"), c.campaign_windows(cal))
    during = p.where("time_window = 'during'").first()
    assert (during.rows, during.units, during.units_day, during.mean_price) == (0, 0.0, 0.0, None)


def test_stock_out_leaves_like_for_like(spark):
    cal = c.campaign_calendar(spark.createDataFrame(
        [("s", "e1", date(2024, 3, 1), date(2024, 3, 10)), ("s", "e2", START, END)], "campaign string, edition string, from_day date, to_day date"))
    rows = [(d, p, "c", 10.0 * k, 100.0 * k, 60.0 * k) for k, first in ((1, date(2024, 3, 1)), (2, START)) for p in ("a", "b") for d in (first + timedelta(days=i) for i in range(10))]
    sales = spark.createDataFrame(rows, "day date, product string, client string, units double, amount double, cost double")
    stock = spark.createDataFrame([("a", START, 0), ("a", START + timedelta(days=1), None), ("b", START, 5)], "product string, day date, available int")
    censor = c.stock_censoring(stock, cal)
    assert {(r.product, r.days_without_stock, r.censored) for r in censor.collect()} == {("a", 2, True), ("b", 0, False)}
    r = c.vs_editions(sales, cal, None, censor).first()
    assert (r.relation, r.products_like, r.excluded_by_stock) == ("previous", 1, 1)
    assert r.units_change_pct == pytest.approx(100) and r.like_coverage_pct == pytest.approx(50) and r.mix_effect_pp == pytest.approx(0)


def test_rfm_with_fixed_cuts(spark):
    rows = [(date(2025, 1, 1), "old", 1.0, 5.0), (date(2025, 6, 1), "new", 1.0, 500.0), (date(2025, 6, 2), "new", 1.0, 500.0)]
    sales = spark.createDataFrame(rows, "day date, client string, units double, amount double")
    cuts = {"recency_days": [10, 20, 30, 40], "frequency": [0.1, 0.2, 1.0, 1.5], "monetary": [1, 2, 3, 4]}
    got = {r.client: (r.r, r.f, r.m, r.segment) for r in c.rfm(sales, date(2025, 6, 10), cuts=cuts).collect()}
    assert got == {"new": (5, 5, 5, "Champions"), "old": (1, 3, 5, "Lost")}


def test_cohort_maturity_and_origin(spark, cal):
    rows = [(date(2025, 3, 5), "won", 1.0, 1.0), (date(2025, 4, 5), "won", 1.0, 1.0), (date(2025, 1, 5), "own", 1.0, 1.0)]
    sales = spark.createDataFrame(rows, "day date, client string, units double, amount double")
    got = {(str(r.cohort), r.period_index): (r.retention_pct, r.observable_periods, r.mature) for r in c.cohorts(sales, periods=2).collect()}
    assert got == {("2025-03-01", 0): (100.0, 1, False), ("2025-03-01", 1): (100.0, 1, False), ("2025-01-01", 0): (100.0, 3, True)}
    assert {r.origin for r in c.cohorts_by_origin(sales, cal).collect()} == {"spring", "outside campaigns"}


def test_scope_rows_are_dealt_before_they_are_held(spark):
    scope = spark.range(1000).selectExpr("cast(id % 3 as string) as campaign", "cast(id % 2 as string) as edition", "id % 900 as product")
    out = c.campaign_scope(scope)
    assert out.count() == 900 and len(out.inputFiles()) > 1


def test_sales_carry_windows_as_numbers(spark, cal):
    sales = shop(spark, "a", {"before": 1}).union(shop(spark, "b", {"before": 2}))
    scope = spark.createDataFrame([("spring", "e1", "a")], "campaign string, edition string, product string")
    rows, names = c._in_windows(sales, c.campaign_windows(cal), scope)
    assert not {"campaign", "edition", "time_window"} & set(rows.columns) and names.count() == 4
    assert {(r.product, r.arm) for r in rows.collect()} == {("a", "campaign"), ("b", "control")}
    twice = c.campaign_windows(cal).union(c.campaign_windows(cal))
    assert c._in_windows(sales, twice, scope)[1].count() == 4
