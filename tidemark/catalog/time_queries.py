"""Queries over periods, ranks, series and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forecasters
from ..functions.scale import cut_points, deciles, ordered_rank, quintile
from ..operators import campaigns as camp
from ..operators import model
from ..operators import series as ts
from ..operators import timeintel as ti
from .base import CAMPAIGNS, SALES, SELLER_SALES, Book, campaigns, r, sales, seller_sales, table

BOOK = Book()
q = BOOK.add

MONTHLY = f"""{SALES}, m AS (SELECT priority, CAST(date_trunc('month', day) AS DATE) AS month, sum(amount) AS v FROM sales GROUP BY 1, 2)"""


def monthly(spark, sf):
    return ti.by_month(sales(spark, sf), "day", "amount", ["priority"])


@q("WIN-01", f"WITH {MONTHLY} SELECT m.priority, m.month, {r('m.v')} AS value, {r('p.v')} AS previous FROM m LEFT JOIN m p ON p.priority = m.priority AND p.month + INTERVAL 1 MONTH = m.month")
def previous_month(spark, sf):
    return ti.previous_month(monthly(spark, sf), ["priority"])


@q("WIN-02", f"WITH {MONTHLY} SELECT m.priority, m.month, {r('m.v')} AS value, {r('p.v')} AS previous, {r('(m.v - p.v) / p.v')} AS change FROM m LEFT JOIN m p ON p.priority = m.priority AND p.month + INTERVAL 1 MONTH = m.month")
def month_over_month(spark, sf):
    return ti.month_over_month(monthly(spark, sf), ["priority"])


GRAIN_SQL = {
    "month": ("year(day) * 100 + month(day)", 100), "quarter": ("year(day) * 10 + quarter(day)", 10),
    "semester": ("year(day) * 10 + CASE WHEN month(day) <= 6 THEN 1 ELSE 2 END", 10), "year": ("year(day)", 1),
}


def _prior(grain):
    order, jump = GRAIN_SQL[grain]

    def run(spark, sf):
        return ti.prior_year(ti.by_grain(sales(spark, sf), "day", "amount", grain, ["priority"]), grain, ["priority"])

    run.__name__ = f"prior_year_by_{grain}"
    q("WIN-03", f"""
      WITH {SALES}, g AS (SELECT priority, {order} AS period, sum(amount) AS v FROM sales GROUP BY 1, 2)
      SELECT g.priority, g.period, {r('g.v')} AS value, {r('p.v')} AS prior FROM g LEFT JOIN g p ON p.priority = g.priority AND p.period + {jump} = g.period""")(run)


for _grain in GRAIN_SQL:
    _prior(_grain)

YTD = f"""{MONTHLY}, y AS (
  SELECT priority, month, v, sum(v) OVER (PARTITION BY priority, year(month) ORDER BY month) AS ytd FROM m
  WHERE month(month) <= (SELECT month(max(month)) FROM m))"""


@q("WIN-04", f"WITH {YTD} SELECT priority, month, {r('v')} AS value, {r('ytd')} AS ytd FROM y")
def year_to_date(spark, sf):
    return ti.ytd(monthly(spark, sf), ["priority"])


@q("WIN-05", f"WITH {YTD} SELECT y.priority, y.month, {r('y.v')} AS value, {r('y.ytd')} AS ytd, {r('p.ytd')} AS prior_ytd FROM y LEFT JOIN y p ON p.priority = y.priority AND p.month + INTERVAL 12 MONTH = y.month")
def prior_year_to_date(spark, sf):
    return ti.prior_year_ytd(monthly(spark, sf), ["priority"])


COMPARABLE = """b AS (SELECT date_trunc('month', min(day)) AS s, last_day(max(day)) AS e FROM {src}),
  d AS (SELECT {keys}day, sum(amount) AS v FROM {src} GROUP BY {by}day),
  roles AS (SELECT {keys}year(day) AS year, v AS c, NULL AS p FROM d, b WHERE NOT (month(day) = 2 AND day(day) = 29) AND day - INTERVAL 12 MONTH >= s
    UNION ALL SELECT {keys}year(day) + 1, NULL, v FROM d, b WHERE NOT (month(day) = 2 AND day(day) = 29) AND day + INTERVAL 12 MONTH <= e)"""


@q("WIN-06", f"""
  WITH {SALES}, {COMPARABLE.format(src='sales', keys='priority, ', by='priority, ')}
  SELECT priority, year, {r('sum(c)')} AS current, {r('sum(p)')} AS prior, {r('(sum(c) - sum(p)) / sum(p)')} AS change FROM roles GROUP BY 1, 2 HAVING sum(p) IS NOT NULL""")
def comparable_yoy(spark, sf):
    return ti.comparable_yoy(sales(spark, sf), "day", "amount", ["priority"])


@q("WIN-07", f"""
  WITH {SALES}, days AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(day)), CAST(last_day(max(day)) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM sales),
  n AS (SELECT year(d) AS year, count(*) AS days_now FROM days GROUP BY 1),
  e AS (SELECT DISTINCT year(d) AS year, CAST(d - INTERVAL 12 MONTH AS DATE) AS d FROM days),
  b AS (SELECT year, count(*) AS days_before FROM e WHERE d IN (SELECT d FROM days) GROUP BY 1),
  v AS (SELECT year(day) AS year, sum(amount) AS v FROM sales GROUP BY 1)
  SELECT v.year, {r('v.v')} AS value, days_now, coalesce(days_before, 0) AS days_before,
         CASE WHEN days_now = days_before THEN {r('(v.v - p.v) / p.v')} END AS change
  FROM v LEFT JOIN v p ON p.year + 1 = v.year LEFT JOIN n ON n.year = v.year LEFT JOIN b ON b.year = v.year""")
def comparable_guard(spark, sf):
    s = sales(spark, sf)
    cal = model.calendar(spark, *model.date_range([s.select("day")]))
    return ti.comparable_guard(s, cal, "day", "amount")


SHARES = f"""{SELLER_SALES}, g AS (SELECT brand, seller, year(day) AS period, sum(amount) AS v FROM seller_sales GROUP BY 1, 2, 3),
  t AS (SELECT brand, period, sum(v) AS mk FROM g GROUP BY 1, 2)"""


def yearly_by_seller(spark, sf):
    return ti.by_grain(seller_sales(spark, sf), "day", "amount", "year", ["brand", "seller"])


@q("WIN-08", f"WITH {SHARES} SELECT g.brand, seller, g.period, {r('v')} AS value, {r('mk')} AS market FROM g JOIN t ON t.brand = g.brand AND t.period = g.period")
def market_total(spark, sf):
    return ti.market(yearly_by_seller(spark, sf), ["brand", "period"])


@q("WIN-09 WIN-10", f"""
  WITH {SHARES}
  SELECT g.brand, g.seller, g.period, {r('g.v')} AS value, {r('t.mk')} AS market, {r('p.v')} AS prior, {r('tp.mk')} AS prior_market,
         {r('g.v / t.mk')} AS share, {r('p.v / tp.mk')} AS prior_share, {r('(g.v / t.mk - p.v / tp.mk) * 100')} AS share_change_pp
  FROM g JOIN t ON t.brand = g.brand AND t.period = g.period LEFT JOIN g p ON p.brand = g.brand AND p.seller = g.seller AND p.period + 1 = g.period
       LEFT JOIN t tp ON tp.brand = g.brand AND tp.period + 1 = g.period""")
def market_share(spark, sf):
    return ti.shares(yearly_by_seller(spark, sf), "seller", ["brand", "period"], "year")


@q("WIN-10", f"""
  WITH {SELLER_SALES}, {COMPARABLE.format(src='seller_sales', keys='seller, ', by='seller, ')},
  o AS (SELECT seller, year, sum(c) AS c, sum(p) AS p FROM roles GROUP BY 1, 2), t AS (SELECT year, sum(c) AS mc, sum(p) AS mp FROM roles GROUP BY 1)
  SELECT seller, o.year, {r('c / mc')} AS share, {r('p / mp')} AS prior_share, {r('(c / mc - p / mp) * 100')} AS share_change_pp
  FROM o JOIN t ON o.year = t.year WHERE mp IS NOT NULL AND mc IS NOT NULL""")
def comparable_share(spark, sf):
    return ti.comparable_share(seller_sales(spark, sf), "day", "amount", "seller")


@q("WIN-11", f"""
  WITH {SELLER_SALES}, g AS (SELECT seller, year(day) AS period, round(sum(units) / 100) AS v FROM seller_sales GROUP BY 1, 2)
  SELECT seller, period, v AS value, rank() OVER (PARTITION BY period ORDER BY v DESC) AS rank, dense_rank() OVER (PARTITION BY period ORDER BY v DESC) AS dense FROM g""")
def market_rank(spark, sf):
    g = ti.by_grain(seller_sales(spark, sf), "day", "units", "year", ["seller"]).withColumn("value", F.round(F.col("value") / 100))
    loose = ti.ranked(g, "value", ["period"])
    tight = ti.ranked(g, "value", ["period"], dense=True).select("seller", "period", F.col("rank").alias("dense"))
    return loose.join(tight, ["seller", "period"])


@q("WIN-12", f"""
  WITH g AS (SELECT l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1), k AS (SELECT v, rank() OVER (ORDER BY v DESC) AS rk FROM g)
  SELECT {r('sum(v)')} AS value, count(*) AS members FROM k WHERE rk <= 20""")
def top_n_total(spark, sf):
    return ti.top_n_total(table(spark, sf, "lineitem"), "l_partkey", "l_quantity", 20)


@q("WIN-13", f"""
  WITH {SALES}, d AS (SELECT priority, day, sum(amount) AS v FROM sales GROUP BY 1, 2),
  m AS (SELECT DISTINCT priority, CAST(date_trunc('month', day) AS DATE) AS month FROM d)
  SELECT m.priority, m.month, {r('avg(v)')} AS moving_average FROM m JOIN d ON d.priority = m.priority AND d.day >= m.month - INTERVAL 2 MONTH AND d.day < m.month + INTERVAL 1 MONTH GROUP BY 1, 2""")
def moving_average(spark, sf):
    return ti.moving_average(sales(spark, sf), "day", "amount", 3, ["priority"])


@q("WIN-14", """
  WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS p, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, CAST(greatest(ceil((p - 1) * 10.0 / (n - 1)), 1) AS BIGINT) AS decile FROM k""")
def order_deciles(spark, sf):
    return deciles(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").drop("o_totalprice")


@q("WIN-15", """
  WITH c AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS k FROM orders)
  SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'P' THEN 1 WHEN o_totalprice <= k[1] THEN 1 WHEN o_totalprice <= k[2] THEN 2 WHEN o_totalprice <= k[3] THEN 3
         WHEN o_totalprice <= k[4] THEN 4 ELSE 5 END AS BIGINT) AS q,
         CAST(CASE WHEN o_totalprice <= 100000 THEN 3 WHEN o_totalprice <= 300000 THEN 2 ELSE 1 END AS BIGINT) AS fixed FROM orders, c""")
def order_quintiles(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    cuts = cut_points(o, "o_totalprice")["o_totalprice"]
    shown = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return o.select(
        "o_orderkey", quintile(shown, cuts).alias("q"), quintile(F.col("o_totalprice"), [100000, 300000], invert=True).alias("fixed")
    )


@q("WIN-16", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS priority FROM orders")
def priority_rank(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ordered_rank(o, "o_totalprice", "o_orderkey", descending=True, out="priority").select("o_orderkey", "priority")


@q("WIN-17", f"WITH {CAMPAIGNS} SELECT campaign, edition, from_day, to_day, edition_number FROM cal")
def edition_numbers(spark, sf):
    return camp.number_editions(campaigns(spark, sf))


@q("WIN-18", f"""
  WITH {CAMPAIGNS}
  SELECT a.campaign, a.edition, a.from_day, a.to_day, a.days, CASE a.edition_number - b.edition_number WHEN 1 THEN 'previous' ELSE 'one_before' END AS relation,
         b.edition AS against, b.from_day AS against_from, b.to_day AS against_to, b.days AS against_days
  FROM cal a JOIN cal b ON a.campaign = b.campaign AND a.edition_number - b.edition_number IN (1, 2)""")
def edition_pairs(spark, sf):
    return camp.prior_editions(camp.campaign_calendar(campaigns(spark, sf)))


# --- series ------------------------------------------------------------------

def spine_sql(unit, step):
    return f"""
      WITH d AS (SELECT {unit} AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1),
      s AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL {step})) AS DATE) AS period FROM d)
      SELECT s.period, {r('coalesce(v, 0)')} AS value FROM s LEFT JOIN d ON s.period = d.period"""


def _series(frequency, unit, step):
    def run(spark, sf):
        return ts.series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", frequency)

    run.__name__ = f"series_{frequency}"
    q("TS-01 JN-14", spine_sql(unit, step))(run)


_series("daily", "CAST(o_orderdate AS DATE)", "1 DAY")
_series("weekly", "CAST(o_orderdate AS DATE) + CAST(7 - isodow(o_orderdate) AS INTEGER)", "7 DAY")
_series("monthly", "CAST(date_trunc('month', o_orderdate) AS DATE)", "1 MONTH")
_series("quarterly", "CAST(date_trunc('quarter', o_orderdate) AS DATE)", "3 MONTH")
_series("yearly", "CAST(date_trunc('year', o_orderdate) AS DATE)", "1 YEAR")

SEGMENTS = """lab AS (
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_totalprice AS v,
           CASE WHEN o_orderstatus = 'P' THEN o_orderpriority WHEN o_orderpriority = '5-LOW' THEN o_orderstatus ELSE o_orderpriority || ' · ' || o_orderstatus END AS segment FROM orders),
  g AS (SELECT segment, period, sum(v) AS v FROM lab WHERE segment <> '' GROUP BY 1, 2 UNION ALL SELECT 'TOTAL', period, sum(v) FROM lab GROUP BY 2),
  sp AS (SELECT segment, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM g GROUP BY 1),
  ser AS (SELECT sp.segment, sp.period, coalesce(v, 0) AS value FROM sp LEFT JOIN g ON g.segment = sp.segment AND g.period = sp.period)"""


def labelled_orders(spark, sf):
    """Orders whose second segment column is sometimes unused."""
    return table(spark, sf, "orders").select(
        "o_orderdate", "o_totalprice",
        F.when(F.col("o_orderpriority") == "5-LOW", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise("")).otherwise(F.col("o_orderpriority")).alias("a"),
        F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_orderstatus")).alias("b"),
    )


def segment_rows(spark, sf):
    return ts.segment_series(labelled_orders(spark, sf), "o_orderdate", "o_totalprice", ["a", "b"])


@q("TS-02", f"WITH {SEGMENTS} SELECT segment, period, {r('value')} AS value FROM ser")
def segment_series(spark, sf):
    return segment_rows(spark, sf)


@q("TS-02", f"WITH {SEGMENTS}, yearly AS (SELECT segment, period FROM ser) SELECT segment, count(*) AS periods FROM yearly WHERE segment <> 'TOTAL' GROUP BY 1 HAVING count(*) < 80")
def short_segments(spark, sf):
    return ts.omitted_segments(segment_rows(spark, sf), minimum=80)


PRIORITY_SERIES = """seen AS (
  SELECT o_orderpriority AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
  spine AS (SELECT segment, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM seen GROUP BY 1),
  ser AS (SELECT spine.segment, spine.period, coalesce(value, 0.0::DOUBLE) AS value FROM spine LEFT JOIN seen ON seen.segment = spine.segment AND seen.period = spine.period)"""


def priority_series(spark, sf):
    return ts.series(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "segment"), "o_orderdate", "o_totalprice", keys=["segment"])


@q("TS-03", f"WITH {PRIORITY_SERIES} SELECT segment, {r('max_by(value, period)')} AS predicted FROM ser GROUP BY 1")
def forecast_naive(spark, sf):
    return ts.last_value(priority_series(spark, sf))


RECENT = f"{PRIORITY_SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY period DESC) AS rn FROM ser)"


@q("TS-04", f"WITH {RECENT} SELECT segment, 13 - rn AS step, {r('value')} AS predicted FROM k WHERE rn BETWEEN 10 AND 12")
def forecast_seasonal_naive(spark, sf):
    return ts.same_position(priority_series(spark, sf))


@q("TS-05", f"WITH {RECENT} SELECT segment, {r('avg(value)')} AS predicted FROM k WHERE rn <= 12 GROUP BY 1")
def forecast_moving_average(spark, sf):
    return ts.trailing_mean(priority_series(spark, sf))


@q("TS-06", f"""
  WITH {PRIORITY_SERIES}, e AS (SELECT segment, max_by(value, period) AS b, min_by(value, period) AS a, count(*) AS n FROM ser GROUP BY 1)
  SELECT segment, CAST(h AS BIGINT) AS step, {r('b + (b - a) / (n - 1) * h')} AS predicted FROM e, (VALUES (1), (2), (3)) v(h)""")
def forecast_drift(spark, sf):
    return ts.drift_line(priority_series(spark, sf))


# Trials of the methods that learn a season: up to six cuts of at least two years, and the whole series.
CUTS = f"""{PRIORITY_SERIES},
  p AS (SELECT segment, period, value, row_number() OVER (PARTITION BY segment ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM ser),
  ns AS (SELECT DISTINCT segment, n, least(6, n - 3 - 24 + 1) AS usable FROM p),
  c AS (SELECT segment, n, n - 3 - usable + k AS cut FROM (SELECT *, unnest(generate_series(1, usable)) AS k FROM ns WHERE usable > 0)
        UNION ALL SELECT segment, n, n FROM ns WHERE usable > 0),
  ahead AS (SELECT segment, n, cut, step, cut + step - 1 AS position FROM c, (VALUES (1), (2), (3)) v(step))"""


def _trials(method, predicted, source):
    return f"""
      SELECT h.segment, '{method}' AS method, CASE WHEN h.cut = h.n THEN 'future' ELSE 'backtest' END AS kind, h.cut::BIGINT AS cut,
             h.step::BIGINT AS step, h.position::BIGINT AS position, a.period, {r('a.value')} AS actual, {r(predicted)} AS predicted, NULL AS error
      FROM ahead h JOIN {source} LEFT JOIN p a ON a.segment = h.segment AND a.i = h.position"""


METHOD_SQL = {
    "seasonal_trend": f"""
      WITH {CUTS},
      w AS (SELECT c.segment, c.cut, i, value, i % 12 AS pos FROM c JOIN p ON p.segment = c.segment AND i < cut AND i >= cut - {12 * forecasters.TREND_CYCLES}),
      lv AS (SELECT segment, cut, pos, avg(i) AS t, avg(value) AS v FROM w GROUP BY ALL),
      sl AS (SELECT segment, cut, sum((i - t) * (value - v)) / sum((i - t) * (i - t)) AS slope FROM w JOIN lv USING (segment, cut, pos) GROUP BY ALL)
      {_trials("seasonal_trend", "v + slope * (h.position - t)",
               "lv ON lv.segment = h.segment AND lv.cut = h.cut AND lv.pos = h.position % 12 JOIN sl ON sl.segment = h.segment AND sl.cut = h.cut")}""",
    "holt_winters": f"""
      WITH RECURSIVE {CUTS},
      ys AS (SELECT segment, list(value ORDER BY i) AS y FROM p GROUP BY 1),
      grid AS (SELECT a, b, g, row_number() OVER (ORDER BY a, b, g) AS gi FROM
        (SELECT unnest({list(forecasters.ALPHAS)}::DOUBLE[]) AS a), (SELECT unnest({list(forecasters.BETAS)}::DOUBLE[]) AS b), (SELECT unnest({list(forecasters.GAMMAS)}::DOUBLE[]) AS g)),
      st(segment, cut, gi, a, b, g, y, i, level, trend, season, error) AS (
        SELECT c.segment, cut, gi, a, b, g, y, 12, list_avg(y[1:12]), (list_avg(y[13:24]) - list_avg(y[1:12])) / 12,
               list_transform(y[1:12], lambda v: v - list_avg(y[1:12])), 0.0::DOUBLE FROM c JOIN ys USING (segment), grid
        UNION ALL
        SELECT segment, cut, gi, a, b, g, y, i + 1, fresh, b * (fresh - level) + (1 - b) * trend,
               list_transform(season, lambda v, j: CASE WHEN j = i % 12 + 1 THEN g * (y[i + 1] - fresh) + (1 - g) * v ELSE v END),
               error + pow(y[i + 1] - level - trend - season[i % 12 + 1], 2)
        FROM (SELECT *, a * (y[i + 1] - season[i % 12 + 1]) + (1 - a) * (level + trend) AS fresh FROM st WHERE i < cut)),
      best AS (SELECT * FROM st WHERE i = cut QUALIFY row_number() OVER (PARTITION BY segment, cut ORDER BY error, gi) = 1)
      {_trials("holt_winters", "level + trend * h.step + season[h.position % 12 + 1]", "best s ON s.segment = h.segment AND s.cut = h.cut")}""",
}


def _method(name, id):
    """Rolling trials of one numeric method on the monthly series."""
    def run(spark, sf):
        kept = {k: forecasters.METHODS[k] for k in dict.fromkeys(["seasonal_naive", name])}
        return ts.run_methods(priority_series(spark, sf), methods=kept).where(F.col("method") == name)

    run.__name__ = f"trials_{name}"
    q(id, METHOD_SQL.get(name))(run)


for _name, _id in (
    ("seasonal_trend", "TS-07"), ("holt_winters", "TS-08"), ("yoy", "TS-09 TS-17"), ("mom", "TS-10 TS-17"), ("theta", "TS-11 TS-17"),
    ("mean_reversion", "TS-12 TS-17"), ("damped_trend", "TS-13 TS-17"), ("cycle_decay", "TS-14 TS-17"), ("cycle_slope", "TS-15 TS-17"), ("annual_factor", "TS-16 TS-17"),
):
    _method(_name, _id)

# Trials of the four elementary methods, written as SQL over the same series.
ELEMENTARY = ["naive", "seasonal_naive", "moving_average", "drift"]

TRIALS = f"""{PRIORITY_SERIES},
  p AS (SELECT segment, period, value, row_number() OVER (PARTITION BY segment ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM ser),
  c AS (SELECT DISTINCT segment, n - 3 - k AS cut FROM p, (VALUES (0), (1), (2), (3), (4), (5)) v(k)),
  h AS (SELECT segment, cut, s AS step, cut + s - 1 AS position FROM c, (VALUES (1), (2), (3)) v(s)),
  base AS (
    SELECT h.segment, h.cut, h.step, h.position, a.period, a.value AS actual, l.value AS last, sn.value AS sn, f.value AS first,
           (SELECT avg(value) FROM p WHERE p.segment = h.segment AND i BETWEEN h.cut - 12 AND h.cut - 1) AS ma
    FROM h JOIN p a ON a.segment = h.segment AND a.i = h.position JOIN p l ON l.segment = h.segment AND l.i = h.cut - 1
         JOIN p sn ON sn.segment = h.segment AND sn.i = h.position - 12 JOIN p f ON f.segment = h.segment AND f.i = 0),
  tr AS (
    SELECT segment, 'naive' AS method, cut, step, position, period, actual, last AS predicted FROM base
    UNION ALL SELECT segment, 'seasonal_naive', cut, step, position, period, actual, sn FROM base
    UNION ALL SELECT segment, 'moving_average', cut, step, position, period, actual, ma FROM base
    UNION ALL SELECT segment, 'drift', cut, step, position, period, actual, last + (last - first) / (cut - 1) * step FROM base)"""

CUT_METRICS = """cm AS (
  SELECT segment, method, cut, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse,
         avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0 ELSE abs(predicted - actual) / ((abs(actual) + abs(predicted)) / 2) END) * 100 AS smape,
         CASE WHEN count(*) FILTER (WHERE actual = 0) = 0 THEN avg(abs((predicted - actual) / nullif(actual, 0))) * 100 END AS mape FROM {src} GROUP BY 1, 2, 3)"""

METRICS = """mm AS (SELECT segment, method, count(*) AS origins, avg(mae) AS mae, avg(rmse) AS rmse, avg(smape) AS smape, avg(mape) AS mape FROM cm GROUP BY 1, 2)"""


def elementary_trials(spark, sf):
    kept = {k: forecasters.METHODS[k] for k in ELEMENTARY}
    rows = ts.run_methods(priority_series(spark, sf), methods=kept)
    return rows.where("kind = 'backtest'").select(*ts.COMMON)


@q("TS-19", f"WITH {TRIALS} SELECT segment, method, cut, step::BIGINT AS step, position, period, {r('actual')} AS actual, {r('predicted')} AS predicted FROM tr")
def rolling_backtest(spark, sf):
    return elementary_trials(spark, sf)


@q("TS-18", f"WITH {TRIALS}, {CUT_METRICS.format(src='tr')} SELECT segment, method, cut, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('smape')} AS smape, {r('mape')} AS mape FROM cm")
def forecast_metrics(spark, sf):
    return ts.trial_metrics(elementary_trials(spark, sf))


@q("TS-19", f"""
  WITH {TRIALS}, {CUT_METRICS.format(src='tr')}, {METRICS}
  SELECT mm.segment, mm.method, mm.origins, {r('mm.mae')} AS mae, {r('mm.rmse')} AS rmse, {r('mm.smape')} AS smape, {r('mm.mape')} AS mape,
         {r('(1 - mm.mae / f.mae) * 100')} AS gain_vs_reference_pct FROM mm JOIN mm f ON f.segment = mm.segment AND f.method = 'seasonal_naive'""")
def method_comparison(spark, sf):
    return ts.method_metrics(elementary_trials(spark, sf))


@q("TS-20", f"""
  WITH {TRIALS}, {CUT_METRICS.format(src='tr')}, {METRICS}
  SELECT segment, method, {r('(1 / mae) / sum(1 / mae) OVER (PARTITION BY segment)', 6)} AS weight FROM mm""", digits=6)
def error_weights(spark, sf):
    return ts.inverse_error_weights(ts.method_metrics(elementary_trials(spark, sf))).select("segment", "method", "weight")


ENSEMBLE = f"""{TRIALS}, {CUT_METRICS.format(src='tr')},
  past AS (SELECT segment, method, cut, avg(mae) OVER (PARTITION BY segment, method ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM cm),
  w AS (SELECT segment, method, cut, (1 / pm) / sum(1 / pm) OVER (PARTITION BY segment, cut) AS weight FROM past WHERE pm IS NOT NULL),
  en AS (SELECT tr.segment, tr.cut, step, position, min(period) AS period, min(actual) AS actual, sum(weight * predicted) AS predicted
         FROM tr JOIN w ON w.segment = tr.segment AND w.method = tr.method AND w.cut = tr.cut GROUP BY 1, 2, 3, 4)"""


@q("TS-21", f"WITH {ENSEMBLE} SELECT segment, cut, step::BIGINT AS step, position, period, {r('actual')} AS actual, {r('predicted')} AS predicted, 'ensemble' AS method FROM en")
def ensemble_backtest(spark, sf):
    return ts.ensemble_trials(elementary_trials(spark, sf))


@q("TS-22", f"""
  WITH {TRIALS}, {CUT_METRICS.format(src='tr')}, {METRICS}, k AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY mae, method) AS rn FROM mm), f AS (SELECT segment, mae FROM mm WHERE method = 'seasonal_naive')
  SELECT k.segment, method, {r('k.mae')} AS error, origins, {r('f.mae')} AS reference_error, {r('(1 - k.mae / f.mae) * 100')} AS gain_pct,
         method <> 'seasonal_naive' AND k.mae < f.mae AS beats_reference FROM k JOIN f ON f.segment = k.segment WHERE rn = 1""")
def chosen_model(spark, sf):
    return ts.choose_model(ts.method_metrics(elementary_trials(spark, sf)))


BANDS = """er AS (SELECT segment, method, step, (predicted - actual) / abs(actual) AS e FROM tr WHERE actual <> 0),
  bd AS (SELECT segment, method, step::BIGINT AS step, count(*) AS errors, quantile_cont(e, 0.1) AS low_error, quantile_cont(e, 0.9) AS high_error,
                quantile_cont(e, 0.5) AS bias, avg(abs(e)) AS mean_abs_error FROM er GROUP BY 1, 2, 3)"""


@q("TS-23", f"WITH {TRIALS}, {BANDS} SELECT segment, method, step, errors, {r('low_error', 6)} AS low_error, {r('high_error', 6)} AS high_error, {r('bias', 6)} AS bias, {r('mean_abs_error', 6)} AS mean_abs_error FROM bd", digits=6)
def error_bands(spark, sf):
    return ts.error_bands(elementary_trials(spark, sf))


@q("TS-24", f"""
  WITH {TRIALS}, {BANDS}, fut AS (SELECT segment, 'naive' AS method, s::BIGINT AS step, max_by(value, period) AS predicted FROM ser, (VALUES (1), (2), (3)) v(s) GROUP BY 1, 3)
  SELECT f.segment, f.method, f.step, {r('predicted')} AS predicted, {r('CASE WHEN 1 + high_error > 0 THEN predicted / (1 + high_error) END')} AS low,
         {r('CASE WHEN 1 + low_error > 0 THEN predicted / (1 + low_error) END')} AS high FROM fut f JOIN bd ON bd.segment = f.segment AND bd.method = f.method AND bd.step = f.step""")
def banded_forecast(spark, sf):
    s = priority_series(spark, sf)
    future = ts.run_methods(s, methods={"naive": forecasters.naive}).where("kind = 'future'").select("segment", "method", "step", "predicted")
    return ts.apply_bands(future, ts.error_bands(elementary_trials(spark, sf)))


@q("TS-26", f"""
  WITH {PRIORITY_SERIES} SELECT segment, s::BIGINT AS step, CAST(max(period) + to_months(CAST(s AS INTEGER)) AS DATE) AS period, CAST(s * 30 AS BIGINT) AS days
  FROM ser, (VALUES (1), (2), (3), (4)) v(s) GROUP BY segment, s""")
def future_periods(spark, sf):
    return ts.future_periods(priority_series(spark, sf), 4)


# --- one step ahead of each chained method, written as SQL -------------------

STEP = f"""{PRIORITY_SERIES},
  p AS (SELECT segment, value AS v, row_number() OVER (PARTITION BY segment ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM ser),
  b AS (SELECT segment, max(n) AS n, avg(v) AS av, avg(v) FILTER (WHERE i >= n - 6) AS rec, sum(v) FILTER (WHERE i >= n - 12) AS s1, sum(v) FILTER (WHERE i >= n - 24 AND i < n - 12) AS s2,
               avg(v) FILTER (WHERE i >= n - 18) AS a18, avg(v) FILTER (WHERE i >= n - 24) AS a24, max_by(v, i) AS lastv FROM p GROUP BY 1),
  pos AS (SELECT segment, v, row_number() OVER (PARTITION BY segment ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY segment) AS c, v / lag(v) OVER (PARTITION BY segment ORDER BY i) AS g FROM p WHERE i % 12 = n % 12),
  l AS (SELECT segment, max_by(v, k) AS lp, max(c) AS c, regr_slope(v, k) AS sl, regr_intercept(v, k) AS ic,
               sum(v * exp(-1.0 + k / (c - 1.0))) / sum(exp(-1.0 + k / (c - 1.0))) AS w10, sum(v * exp(-0.8 + 0.8 * k / (c - 1.0))) / sum(exp(-0.8 + 0.8 * k / (c - 1.0))) AS w08,
               sum(v * exp(-0.5 + 0.5 * k / (c - 1.0))) / sum(exp(-0.5 + 0.5 * k / (c - 1.0))) AS w05,
               sum(g * exp(-1.5 + 1.5 * (k - 1) / (c - 2.0))) FILTER (WHERE k > 0) / sum(exp(-1.5 + 1.5 * (k - 1) / (c - 2.0))) FILTER (WHERE k > 0) AS own FROM pos GROUP BY 1),
  gr AS (SELECT a.segment, sum(a.v / o.v * exp(-1.5 + 1.5 * (a.i - a.n + 6) / 5.0)) / sum(exp(-1.5 + 1.5 * (a.i - a.n + 6) / 5.0)) AS growth FROM p a JOIN p o ON o.segment = a.segment AND o.i = a.i - 12 WHERE a.i >= a.n - 6 GROUP BY 1),
  jm AS (SELECT a.segment, a.v / o.v AS g, row_number() OVER (PARTITION BY a.segment ORDER BY a.i) - 1 AS k, count(*) OVER (PARTITION BY a.segment) AS c FROM p a JOIN p o ON o.segment = a.segment AND o.i = a.i - 1 WHERE a.i % 12 = a.n % 12),
  jw AS (SELECT segment, sum(g * exp(-1.5 + 1.5 * k / (c - 1.0))) / sum(exp(-1.5 + 1.5 * k / (c - 1.0))) AS jump FROM jm GROUP BY 1),
  tq AS (SELECT segment, quantile_cont(g, 0.05) AS q05, quantile_cont(g, 0.95) AS q95 FROM pos WHERE k > 0 GROUP BY 1),
  tf AS (SELECT pos.segment, g, row_number() OVER (PARTITION BY pos.segment ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY pos.segment) AS m FROM pos JOIN tq ON tq.segment = pos.segment
         WHERE k > 0 AND g >= greatest(0.5, q05) AND g <= least(2.0, q95)),
  tw AS (SELECT segment, sum(g * exp(-1.5 + 1.5 * j / (m - 1.0))) / sum(exp(-1.5 + 1.5 * j / (m - 1.0))) AS trimmed FROM tf GROUP BY 1),
  sm AS (SELECT * FROM smooth),
  al AS (SELECT b.*, lp, c, sl, ic, w10, w08, w05, own, growth, jump, trimmed, tl, tt, dl, dt FROM b JOIN l USING (segment) JOIN gr USING (segment) JOIN jw USING (segment) JOIN tw USING (segment) JOIN sm USING (segment))"""

SMOOTH = f"""WITH RECURSIVE {PRIORITY_SERIES},
  q AS (SELECT segment, value AS v, row_number() OVER (PARTITION BY segment ORDER BY period) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n, lead(value) OVER (PARTITION BY segment ORDER BY period) AS nx FROM ser),
  rec(segment, i, tl, tt, dl, dt) AS (
    SELECT segment, i, v, 0.0::DOUBLE, v, nx - v FROM q WHERE i = 0
    UNION ALL SELECT q.segment, q.i, 0.15 * v + 0.85 * (tl + tt), 0.10 * (0.15 * v + 0.85 * (tl + tt) - tl) + 0.90 * tt,
                     0.20 * v + 0.80 * (dl + 0.85 * dt), 0.10 * (0.20 * v + 0.80 * (dl + 0.85 * dt) - dl) + 0.90 * 0.85 * dt FROM rec JOIN q ON q.segment = rec.segment AND q.i = rec.i + 1),
  smooth AS (SELECT rec.segment, tl, tt, dl, dt FROM rec JOIN q ON q.segment = rec.segment AND q.i = rec.i WHERE q.i = n - 1),
  """


def clip(x, low, high):
    return f"least(greatest({x}, {low}), {high})"


def railed(x):
    return f"CASE WHEN rec > 0 THEN {clip(x, '0.5 * rec', '1.5 * rec')} ELSE {x} END"


_theta = f"((tl + 0.80 * tt) * {clip('w10 / a18', 0.85, 1.15)})"
ONE_STEP = {
    "yoy": ("TS-09", f"lp * {clip('0.45 * own + 0.55 * growth', 0.75, 1.30)}"),
    "mom": ("TS-10", f"lastv * {clip('jump', 0.65, 1.35)}"),
    "theta": ("TS-11", railed(f"CASE WHEN rec > 0 AND ({_theta} > 1.3 * rec OR {_theta} < 0.7 * rec) THEN 0.6 * {_theta} + 0.4 * rec ELSE {_theta} END")),
    "mean_reversion": ("TS-12", railed(f"(0.6 * av + 0.4 * rec) * {clip('w08 / av', 0.80, 1.20)}")),
    "damped_trend": ("TS-13", railed(f"(dl + 0.85 * dt) * {clip('w05 / a24', 0.85, 1.15)}")),
    "cycle_decay": ("TS-14", railed("lp * trimmed")),
    "cycle_slope": ("TS-15", railed("0.6 * (ic + sl * c) + 0.4 * w05")),
    "annual_factor": ("TS-16", railed(f"lp * {clip('s1 / s2', 0.80, 1.25)}")),
}


def _one_step(name, id, formula):
    def run(spark, sf):
        rows = ts.run_methods(priority_series(spark, sf), methods={name: forecasters.METHODS[name]})
        return rows.where("kind = 'future' and step = 1").select("segment", "predicted")

    run.__name__ = f"next_period_{name}"
    q(id, f"{SMOOTH}{STEP[len(PRIORITY_SERIES) + 2:].lstrip()} SELECT segment, {r(formula, 3)} AS predicted FROM al", digits=3)(run)


for _n, (_i, _f) in ONE_STEP.items():
    _one_step(_n, _i, _f)


def mean_of_three(path, cycle):
    return forecasters.mean(forecasters.tail(path, 3))


@q("TS-17", f"""
  WITH {RECENT}, t AS (SELECT segment, max(value) FILTER (WHERE rn = 1) AS c, max(value) FILTER (WHERE rn = 2) AS b, max(value) FILTER (WHERE rn = 3) AS a FROM k GROUP BY 1),
  x AS (SELECT segment, (a + b + c) / 3 AS p1, (b + c + (a + b + c) / 3) / 3 AS p2, c FROM t)
  SELECT segment, CAST(s AS BIGINT) AS step, {r('CASE s WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE (c + p1 + p2) / 3 END')} AS predicted FROM x, (VALUES (1), (2), (3)) v(s)""")
def chained_forecast(spark, sf):
    """A caller's own one-step rule, chained over the horizon."""
    rows = ts.run_methods(priority_series(spark, sf), methods={"own": forecasters.chained(mean_of_three)})
    return rows.where("kind = 'future'").select("segment", "step", "predicted")


@q("TS-25", f"""
  WITH {PRIORITY_SERIES}, e AS (SELECT segment, max_by(value, period) AS b, min_by(value, period) AS a, count(*) AS n FROM ser GROUP BY 1)
  SELECT segment, n AS cut, CAST(h AS BIGINT) AS step, n + h - 1 AS position, {r('b + (b - a) / (n - 1) * h')} AS predicted FROM e, (VALUES (1), (2), (3)) v(h)""")
def full_history_forecast(spark, sf):
    rows = ts.run_methods(priority_series(spark, sf), methods={"drift": forecasters.drift})
    return rows.where("kind = 'future'").select("segment", "cut", "step", "position", "predicted")


@q("TS-28", f"""
  WITH {TRIALS} SELECT segment, method, cut, step::BIGINT AS step, period, {r('actual')} AS actual, {r('predicted')} AS predicted, {r('predicted - actual')} AS deviation,
    {r('(predicted - actual) / nullif(actual, 0) * 100')} AS deviation_pct FROM tr WHERE method = 'seasonal_naive'""")
def deviations_of_reference(spark, sf):
    return ts.deviations(elementary_trials(spark, sf).where("method = 'seasonal_naive'"))


def projection(spark, sf):
    s = ts.long_enough(ts.segment_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"]))
    return ts.Projection(s)


@q("TS-25 TS-17")
def projected_series(spark, sf):
    return projection(spark, sf).forecast()


@q("TS-27")
def forecast_table(spark, sf):
    return projection(spark, sf).table()


@q("TS-27", f"""
  WITH {PRIORITY_SERIES}, a AS (SELECT * FROM ser UNION ALL SELECT 'TOTAL', period, sum(value) FROM ser GROUP BY 2 ORDER BY 1)
  SELECT segment, period, {r('value')} AS value, CAST(strftime(period, '%Y%m%d') AS BIGINT) AS date_key FROM a""")
def forecast_table_history(spark, sf):
    return projection(spark, sf).table().where("kind = 'history'").select("segment", "period", "value", "date_key")


@q("TS-28")
def actual_vs_projected(spark, sf):
    return projection(spark, sf).actual_vs_projected()


DEV = f"""{TRIALS}, dv AS (SELECT segment, cut, step, actual, predicted, (predicted - actual) / nullif(actual, 0) * 100 AS dp FROM tr WHERE method = 'drift')"""


@q("TS-29", f"""
  WITH {DEV}, pc AS (SELECT segment, cut, sum(actual) AS a, sum(predicted) AS p FROM dv GROUP BY 1, 2)
  SELECT segment, {r('sum(a)')} AS actual, {r('sum(p)')} AS predicted, {r('sum(p) - sum(a)')} AS deviation, {r('(sum(p) - sum(a)) / sum(a) * 100')} AS deviation_pct,
         {r('avg(abs((p - a) / a)) * 100')} AS mean_abs_deviation_pct FROM pc GROUP BY 1""")
def backtest_measures(spark, sf):
    return ts.backtest_measures(ts.deviations(elementary_trials(spark, sf).where("method = 'drift'")))


# A whole projection run over the four elementary methods: trials and blend, choice, bands, forecasts, tables.
PROJECTED = f"""{ENSEMBLE},
  every AS (SELECT segment, method, cut, step, position, period, actual, predicted FROM tr
            UNION ALL SELECT segment, 'ensemble', cut, step, position, period, actual, predicted FROM en),
  missed AS (SELECT segment, method, avg(mae) AS mae FROM (SELECT segment, method, cut, avg(abs(predicted - actual)) AS mae FROM every GROUP BY ALL) GROUP BY ALL),
  best AS (SELECT segment, method FROM missed QUALIFY row_number() OVER (PARTITION BY segment ORDER BY mae, method) = 1),
  er AS (SELECT segment, method, step, (predicted - actual) / abs(actual) AS e FROM every WHERE actual <> 0),
  bd AS (SELECT segment, method, step, quantile_cont(e, 0.1) AS low_error, quantile_cont(e, 0.9) AS high_error FROM er GROUP BY ALL HAVING count(*) >= 2),
  ends AS (SELECT segment, max(n) AS n, max(period) AS last_period, max_by(value, i) AS last, min_by(value, i) AS first,
                  avg(value) FILTER (WHERE i >= n - 12) AS ma FROM p GROUP BY 1),
  ahead AS (
    SELECT e.*, step, sn.value AS sn FROM ends e, (VALUES (1), (2), (3)) v(step) JOIN p sn ON sn.segment = e.segment AND sn.i = e.n - 13 + step),
  plain AS (
    SELECT segment, 'naive' AS method, step, last AS predicted FROM ahead UNION ALL SELECT segment, 'seasonal_naive', step, sn FROM ahead
    UNION ALL SELECT segment, 'moving_average', step, ma FROM ahead
    UNION ALL SELECT segment, 'drift', step, last + (last - first) / (n - 1) * step FROM ahead),
  future AS (
    SELECT * FROM plain UNION ALL
    SELECT segment, 'ensemble', step, sum(predicted / mae) / sum(1 / mae) FROM plain JOIN missed USING (segment, method) GROUP BY ALL),
  told AS (
    SELECT segment, method, step::BIGINT AS step, predicted, CAST(last_period + to_months(CAST(step AS INTEGER)) AS DATE) AS period,
           CAST(step * 30 AS BIGINT) AS days, CASE WHEN 1 + high_error > 0 THEN predicted / (1 + high_error) END AS low,
           CASE WHEN 1 + low_error > 0 THEN predicted / (1 + low_error) END AS high
    FROM future JOIN best USING (segment, method) JOIN ends USING (segment) LEFT JOIN bd USING (segment, method, step))"""

KEYED = "CAST(strftime(period, '%Y%m%d') AS BIGINT) AS date_key"


def elementary_projection(spark, sf):
    return ts.Projection(priority_series(spark, sf), methods={m: forecasters.METHODS[m] for m in ELEMENTARY})


@q("TS-25", f"WITH {PROJECTED} SELECT segment, method, step, {r('predicted')} AS predicted, period, days, {r('low')} AS low, {r('high')} AS high FROM told")
def projected_elementary(spark, sf):
    return elementary_projection(spark, sf).forecast()


@q("TS-27", f"""
  WITH {PROJECTED} SELECT segment, period, {r('value')} AS value, 'history' AS kind, '' AS method, NULL::BIGINT AS step, NULL::BIGINT AS days, NULL::DOUBLE AS low, NULL::DOUBLE AS high, {KEYED} FROM ser
  UNION ALL SELECT segment, period, {r('predicted')}, 'projection', method, step, days, {r('low')}, {r('high')}, {KEYED} FROM told""")
def forecast_table_elementary(spark, sf):
    return elementary_projection(spark, sf).table()


@q("TS-28", f"""
  WITH {PROJECTED} SELECT segment, method, cut, step::BIGINT AS step, period, {r('actual')} AS actual, {r('predicted')} AS predicted,
         {r('predicted - actual')} AS deviation, {r('(predicted - actual) / nullif(actual, 0) * 100')} AS deviation_pct FROM every JOIN best USING (segment, method)""")
def actual_vs_projected_elementary(spark, sf):
    return elementary_projection(spark, sf).actual_vs_projected()


@q("TS-29", f"""
  WITH {PROJECTED}, line AS (
    SELECT segment, period, value AS historical, NULL::DOUBLE AS projected, NULL::DOUBLE AS low, NULL::DOUBLE AS high FROM ser
    UNION ALL SELECT segment, period, NULL, predicted, low, high FROM told)
  SELECT segment, period, {r('historical')} AS historical, {r('projected')} AS projected, {r('low')} AS low, {r('high')} AS high,
         {r('coalesce(historical, projected)')} AS line, {r('(high - low) / projected * 100')} AS band_width_pct FROM line""")
def projection_measures_elementary(spark, sf):
    return ts.projection_measures(elementary_projection(spark, sf).table())


@q("TS-29")
def projection_measures(spark, sf):
    return ts.projection_measures(projection(spark, sf).table())


@q("TS-30", f"""
  WITH {DEV} SELECT segment, step::BIGINT AS step, count(*) AS observations, {r('avg(dp)')} AS mean_deviation_pct, {r('avg(abs(dp))')} AS mean_abs_deviation_pct FROM dv GROUP BY 1, 2""")
def deviation_by_step(spark, sf):
    return ts.deviation_by_step(ts.deviations(elementary_trials(spark, sf).where("method = 'drift'")))
