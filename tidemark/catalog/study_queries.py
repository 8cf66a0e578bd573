"""Queries over campaigns, growth, contact paths and transcripts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.scalars import date_key
from ..functions.scale import landed
from ..operators import campaigns as camp
from ..operators import growth, paths
from ..operators import transcripts as tx
from .base import CAMPAIGNS, SALES, SCOPE, SELLER_SALES, Book, campaigns, r, rounded, sales, scope, seller_sales, table

BOOK = Book()
q = BOOK.add

AS_OF = date(2001, 8, 1)


# --- campaigns ---------------------------------------------------------------

@q("CMP-01", f"WITH {SALES} SELECT day, product, {r('units')} AS units, {r('amount')} AS amount, {r('cost')} AS cost FROM sales WHERE flag <> 'R'")
def prepared_sales(spark, sf):
    raw = sales(spark, sf).withColumn("sold", F.when(F.col("flag") != "R", date_key("day")).otherwise(0)).drop("day")
    return camp.prepare_sales(raw, "sold", "units", "amount", "cost").select("day", "product", "units", "amount", "cost")


@q("CMP-01", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS invalid_days, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def invalid_sale_days(spark, sf):
    return camp.invalid_days(sales(spark, sf).withColumn("day", F.when(F.col("flag") != "R", F.col("day").cast("string")).otherwise("soon")), "day")


def calendar(spark, sf):
    return camp.campaign_calendar(campaigns(spark, sf))


@q("CMP-02", f"WITH {CAMPAIGNS} SELECT campaign, edition, from_day, to_day, days, edition_number FROM cal")
def campaign_calendar(spark, sf):
    return calendar(spark, sf)


WIN = f"""{CAMPAIGNS}, win AS (
  SELECT campaign, edition, 'baseline' AS time_window, from_day - 35 AS from_day, from_day - 8 AS to_day, CAST(28 AS BIGINT) AS days FROM cal
  UNION ALL SELECT campaign, edition, 'blackout', from_day - 7, from_day - 1, 7 FROM cal
  UNION ALL SELECT campaign, edition, 'during', from_day, to_day, days FROM cal
  UNION ALL SELECT campaign, edition, 'carry', to_day + 1, to_day + 28, 28 FROM cal)"""


def windows(spark, sf):
    return camp.campaign_windows(calendar(spark, sf))


@q("CMP-03", f"WITH {WIN} SELECT * FROM win")
def campaign_windows(spark, sf):
    return windows(spark, sf)


@q("CMP-03", f"WITH {CAMPAIGNS} SELECT campaign, edition, 'baseline' AS time_window, from_day - 10 AS from_day, from_day - 1 AS to_day, CAST(10 AS BIGINT) AS days FROM cal UNION ALL SELECT campaign, edition, 'blackout', NULL, NULL, 0 FROM cal UNION ALL SELECT campaign, edition, 'during', from_day, to_day, days FROM cal UNION ALL SELECT campaign, edition, 'carry', NULL, NULL, 0 FROM cal")
def campaign_windows_without_margins(spark, sf):
    return camp.campaign_windows(calendar(spark, sf), baseline=10, carry=0, blackout=0)


@q("CMP-04", f"WITH {CAMPAIGNS}, {SCOPE} SELECT DISTINCT campaign, edition, product FROM scope")
def campaign_scope(spark, sf):
    return camp.campaign_scope(scope(spark, sf).unionAll(scope(spark, sf)))


PANEL = f"""{SALES}, {WIN}, {SCOPE},
  hit AS (SELECT w.campaign, w.edition, w.time_window, s.*, CASE WHEN c.product IS NULL THEN 'control' ELSE 'campaign' END AS arm
          FROM sales s JOIN win w ON s.day BETWEEN w.from_day AND w.to_day LEFT JOIN scope c ON c.campaign = w.campaign AND c.edition = w.edition AND c.product = s.product),
  members AS (SELECT 'TOTAL' AS dimension, 'TOTAL' AS member UNION ALL SELECT DISTINCT 'flag', flag FROM sales),
  agg AS (SELECT campaign, edition, time_window, arm, 'TOTAL' AS dimension, 'TOTAL' AS member, count(*) AS rows, sum(units) AS units, sum(amount) AS amount, sum(cost) AS cost, count(DISTINCT client) AS clients FROM hit GROUP BY 1, 2, 3, 4
    UNION ALL SELECT campaign, edition, time_window, arm, 'flag', flag, count(*), sum(units), sum(amount), sum(cost), count(DISTINCT client) FROM hit GROUP BY 1, 2, 3, 4, 6),
  grid AS (SELECT w.*, m.dimension, m.member, a.arm FROM win w, members m, (VALUES ('campaign'), ('control')) a(arm)),
  panel AS (SELECT g.*, coalesce(rows, 0) AS rows, coalesce(units, 0) AS units, coalesce(amount, 0) AS amount, cost, coalesce(clients, 0) AS clients,
                   coalesce(units, 0) / days AS units_day, coalesce(amount, 0) / days AS amount_day, amount / nullif(units, 0) AS mean_price,
                   amount - cost AS margin, (amount - cost) / days AS margin_day, (amount - cost) / nullif(amount, 0) * 100 AS margin_pct
            FROM grid g LEFT JOIN agg x ON x.campaign = g.campaign AND x.edition = g.edition AND x.time_window = g.time_window AND x.arm = g.arm AND x.dimension = g.dimension AND x.member = g.member)"""


def panel(spark, sf):
    return camp.campaign_panel(sales(spark, sf), windows(spark, sf), camp.campaign_scope(scope(spark, sf)), ["flag"])


@q("CMP-05", f"""
  WITH {PANEL} SELECT campaign, edition, time_window, from_day, to_day, days, dimension, member, arm, rows, {r('units')} AS units, {r('amount')} AS amount, {r('cost')} AS cost, clients,
    {r('units_day')} AS units_day, {r('amount_day')} AS amount_day, {r('mean_price')} AS mean_price, {r('margin')} AS margin, {r('margin_day')} AS margin_day, {r('margin_pct')} AS margin_pct FROM panel""")
def campaign_panel(spark, sf):
    return panel(spark, sf)


EFFECT = f"""{PANEL},
  t AS (SELECT * FROM panel WHERE arm = 'campaign'), k AS (SELECT * FROM panel WHERE arm = 'control'),
  w AS (
    SELECT b.campaign, b.edition, b.dimension, b.member, b.rows AS b_rows, b.units_day AS bu, b.mean_price AS bp, b.margin_day AS bm, b.margin_pct AS bmp,
           d.days AS dd, d.units_day AS du, d.mean_price AS dp, d.margin_day AS dm, d.margin_pct AS dmp, d.clients AS dc,
           a.days AS ad, a.units_day AS au, a.margin_day AS am,
           kb.rows AS kb_rows, kb.units_day AS kbu, kb.margin_day AS kbm, kd.units_day AS kdu, kd.margin_day AS kdm, ka.units_day AS kau, ka.margin_day AS kam
    FROM t b JOIN t d USING (campaign, edition, dimension, member) JOIN t a USING (campaign, edition, dimension, member)
         JOIN k kb USING (campaign, edition, dimension, member) JOIN k kd USING (campaign, edition, dimension, member) JOIN k ka USING (campaign, edition, dimension, member)
    WHERE b.time_window = 'baseline' AND d.time_window = 'during' AND a.time_window = 'carry' AND kb.time_window = 'baseline' AND kd.time_window = 'during' AND ka.time_window = 'carry'),
  f AS (SELECT *, b_rows > 0 AND bu <> 0 AS comparable, kb_rows > 0 AND kbu <> 0 AS has_control FROM w),
  g AS (SELECT *, CASE WHEN has_control THEN (coalesce(kdu / nullif(kbu, 0), 1) - 1) * 100 END AS cd, CASE WHEN has_control THEN (coalesce(kau / nullif(kbu, 0), 1) - 1) * 100 END AS ca FROM f),
  h AS (SELECT *, coalesce(has_control AND cd < -25, false) AS dropped FROM g),
  u AS (SELECT *, has_control AND NOT dropped AS use FROM h),
  x AS (SELECT *, bu * CASE WHEN use THEN coalesce(kdu / nullif(kbu, 0), 1) ELSE 1 END AS ed, bu * CASE WHEN use THEN coalesce(kau / nullif(kbu, 0), 1) ELSE 1 END AS ea,
                  bm * CASE WHEN use THEN coalesce(kdm / nullif(kbm, 0), 1) ELSE 1 END AS emd, bm * CASE WHEN use THEN coalesce(kam / nullif(kbm, 0), 1) ELSE 1 END AS ema FROM u),
  y AS (SELECT *, CASE WHEN comparable THEN (du - ed) * dd + (coalesce(au, 0) - ea) * ad END AS iu, CASE WHEN comparable THEN (dm - emd) * dd END AS imd,
                  CASE WHEN comparable THEN (am - ema) * ad END AS ima FROM x),
  effect AS (SELECT campaign, edition, dimension, member, comparable, CASE WHEN use THEN 'diff_in_diff' ELSE 'baseline' END AS method, dd AS campaign_days, bu AS units_day_baseline, du AS units_day_campaign,
    au AS units_day_carry, (du / nullif(bu, 0) - 1) * 100 AS gross_lift_pct, CASE WHEN comparable THEN ed END AS counterfactual_units_day, CASE WHEN comparable THEN (du / nullif(ed, 0) - 1) * 100 END AS lift_pct,
    iu AS incremental_units, imd AS incremental_margin_during, ima AS incremental_margin_carry, imd + coalesce(ima, 0) AS incremental_margin,
    (dp / nullif(bp, 0) - 1) * 100 AS price_change_pct, dmp - bmp AS margin_change_pp, (au / nullif(bu, 0) - 1) * 100 AS carry_units_pct, dc AS campaign_clients, cd AS control_during_pct, ca AS control_carry_pct,
    dropped AS control_dropped, coalesce(has_control AND cd < -5, false) AS substitution FROM y),
  verdicts AS (SELECT *, CASE WHEN NOT comparable THEN 'not_comparable' WHEN incremental_margin < 0 AND incremental_units > 0 AND incremental_margin_during < 0 THEN 'sold_more_earned_less'
    WHEN incremental_margin < 0 AND incremental_units > 0 THEN 'carry_over_eats_margin' WHEN incremental_margin < 0 THEN 'worse' WHEN incremental_units <= 0 THEN 'pulled_forward'
    WHEN control_dropped THEN 'incremental_without_control' WHEN substitution THEN 'incremental_with_substitution' WHEN carry_units_pct < -15 THEN 'incremental_with_carry_over' ELSE 'incremental' END AS verdict FROM effect)"""


def effect(spark, sf):
    return camp.campaign_effect(panel(spark, sf))


@q("CMP-06", f"""
  WITH {EFFECT} SELECT campaign, edition, dimension, member, comparable, method, campaign_days, campaign_clients, {', '.join(r(c) + ' AS ' + c for c in (
    'units_day_baseline', 'units_day_campaign', 'units_day_carry', 'gross_lift_pct', 'counterfactual_units_day', 'lift_pct', 'incremental_units', 'incremental_margin_during',
    'incremental_margin_carry', 'incremental_margin', 'price_change_pct', 'margin_change_pp', 'carry_units_pct'))} FROM verdicts""")
def campaign_effect(spark, sf):
    return effect(spark, sf).drop("control_during_pct", "control_carry_pct", "control_dropped", "substitution", "verdict")


@q("CMP-07", f"WITH {EFFECT} SELECT campaign, edition, dimension, member, {r('control_during_pct')} AS control_during_pct, {r('control_carry_pct')} AS control_carry_pct, control_dropped, method FROM verdicts")
def control_guard(spark, sf):
    return effect(spark, sf).select("campaign", "edition", "dimension", "member", "control_during_pct", "control_carry_pct", "control_dropped", "method")


@q("CMP-08", f"WITH {EFFECT} SELECT campaign, edition, dimension, member, substitution FROM verdicts")
def substitution_flag(spark, sf):
    return effect(spark, sf).select("campaign", "edition", "dimension", "member", "substitution")


@q("CMP-09", f"WITH {EFFECT} SELECT campaign, edition, dimension, member, verdict FROM verdicts")
def campaign_verdict(spark, sf):
    return effect(spark, sf).select("campaign", "edition", "dimension", "member", "verdict")


@q("CMP-06", f"""
  WITH {SALES}, {WIN}, s AS (SELECT w.campaign, w.edition, w.time_window, max(days) AS days, sum(units) AS u FROM win w JOIN sales ON day BETWEEN w.from_day AND w.to_day GROUP BY 1, 2, 3),
  p AS (SELECT campaign, edition, max(u / days) FILTER (WHERE time_window = 'baseline') AS b, max(u / days) FILTER (WHERE time_window = 'during') AS d FROM s GROUP BY 1, 2)
  SELECT c.campaign, c.edition, CASE WHEN b IS NULL THEN NULL ELSE {r('(coalesce(d, 0) / b - 1) * 100')} END AS lift_pct, 'baseline' AS method FROM cal c LEFT JOIN p ON p.campaign = c.campaign AND p.edition = c.edition""")
def campaign_effect_without_scope(spark, sf):
    p = camp.campaign_panel(sales(spark, sf), windows(spark, sf))
    return camp.campaign_effect(p).select("campaign", "edition", "lift_pct", "method")


PRICE = f"""{PANEL}, pz AS (
    SELECT campaign, edition, product, sum(amount) FILTER (WHERE time_window = 'baseline') / nullif(sum(units) FILTER (WHERE time_window = 'baseline'), 0) AS rp,
           sum(amount) FILTER (WHERE time_window = 'blackout') / nullif(sum(units) FILTER (WHERE time_window = 'blackout'), 0) AS pp,
           sum(amount) FILTER (WHERE time_window = 'during') / nullif(sum(units) FILTER (WHERE time_window = 'during'), 0) AS cp FROM hit WHERE arm = 'campaign' GROUP BY 1, 2, 3),
  pr AS (SELECT campaign, edition, product, rp AS reference_price, pp AS price_before, cp AS campaign_price, -((cp / rp - 1) * 100) AS real_discount_pct, -((cp / pp - 1) * 100) AS apparent_discount_pct,
           (cp / rp - 1) * 100 - (cp / pp - 1) * 100 AS fabricated_points, coalesce(pp > rp * 1.03, false) AS inflated_before, CASE WHEN pp > rp * 1.03 THEN (pp / rp - 1) * 100 END AS rise_before_pct FROM pz WHERE cp IS NOT NULL)"""


def prices(spark, sf):
    return camp.campaign_price(sales(spark, sf), windows(spark, sf), camp.campaign_scope(scope(spark, sf)))


@q("CMP-10", f"""
  WITH {PRICE} SELECT campaign, edition, product, inflated_before, {', '.join(r(c) + ' AS ' + c for c in (
    'reference_price', 'price_before', 'campaign_price', 'real_discount_pct', 'apparent_discount_pct', 'fabricated_points', 'rise_before_pct'))} FROM pr""")
def campaign_price(spark, sf):
    return prices(spark, sf)


def stock(spark, sf):
    """Stock left per product and day, read off that day's sales."""
    daily = sales(spark, sf).groupBy("product", "day").agg(F.sum("units").alias("u"))
    return daily.select("product", "day", F.when(F.col("u") < 49, 45 - F.col("u")).alias("available"))


STOCK = """stock AS (SELECT product, day, CASE WHEN sum(units) < 49 THEN 45 - sum(units) END AS available FROM sales GROUP BY 1, 2),
  cens AS (SELECT campaign, edition, product, max(days) AS campaign_days, count(DISTINCT day) AS days_with_data, count(*) FILTER (WHERE coalesce(available, 0) <= 0) AS days_without_stock, avg(available) AS mean_available
           FROM stock JOIN cal ON day BETWEEN from_day AND to_day GROUP BY 1, 2, 3)"""


@q("CMP-11", f"""
  WITH {SALES}, {CAMPAIGNS}, {STOCK} SELECT campaign, edition, product, campaign_days, days_with_data, days_without_stock, {r('mean_available')} AS mean_available,
    {r('(1 - days_without_stock * 1.0 / days_with_data) * 100')} AS coverage_pct, days_without_stock > 0 AS censored FROM cens""")
def stock_censoring(spark, sf):
    return camp.stock_censoring(stock(spark, sf), calendar(spark, sf))


@q("CMP-12 WIN-18 SET-03 SET-04", f"""
  WITH {SALES}, {CAMPAIGNS}, {SCOPE}, {STOCK},
  dur AS (SELECT campaign, edition, s.* FROM sales s JOIN cal ON day BETWEEN from_day AND to_day),
  pp AS (SELECT campaign, edition, product, sum(units) AS u FROM dur GROUP BY 1, 2, 3),
  tot AS (SELECT c.campaign, c.edition, c.days, c.edition_number AS nr, coalesce(sum(units), 0) AS u, sum(amount) AS a, sum(amount) - sum(cost) AS m, count(DISTINCT client) AS clients,
                 (SELECT count(*) FROM scope s WHERE s.campaign = c.campaign AND s.edition = c.edition) AS products FROM cal c LEFT JOIN dur d ON d.campaign = c.campaign AND d.edition = c.edition GROUP BY 1, 2, 3, 4),
  sc AS (SELECT s.*, x.product IS NOT NULL AS bad FROM scope s LEFT JOIN (SELECT * FROM cens WHERE days_without_stock > 0) x ON x.campaign = s.campaign AND x.edition = s.edition AND x.product = s.product),
  pairs AS (SELECT a.campaign, a.edition, b.edition AS against, CASE a.nr - b.nr WHEN 1 THEN 'previous' ELSE 'one_before' END AS relation FROM tot a JOIN tot b ON a.campaign = b.campaign AND a.nr - b.nr IN (1, 2)),
  com AS (SELECT p.campaign, p.edition, p.against, s1.product, NOT s1.bad AND NOT s2.bad AS clean FROM pairs p JOIN sc s1 ON s1.campaign = p.campaign AND s1.edition = p.edition JOIN sc s2 ON s2.campaign = p.campaign AND s2.edition = p.against AND s2.product = s1.product),
  cnt AS (SELECT c.campaign, c.edition, c.against, count(*) FILTER (WHERE clean) AS lk, count(*) FILTER (WHERE NOT clean) AS ex, coalesce(sum(p1.u) FILTER (WHERE clean), 0) AS u1, coalesce(sum(p2.u) FILTER (WHERE clean), 0) AS u2
          FROM com c LEFT JOIN pp p1 ON p1.campaign = c.campaign AND p1.edition = c.edition AND p1.product = c.product LEFT JOIN pp p2 ON p2.campaign = c.campaign AND p2.edition = c.against AND p2.product = c.product GROUP BY 1, 2, 3),
  j AS (SELECT p.*, a.days, b.days AS against_days, a.u / a.days AS ud, b.u / b.days AS ud2, a.a / nullif(a.u, 0) AS mp, b.a / nullif(b.u, 0) AS mp2, a.m / nullif(a.a, 0) * 100 AS mg, b.m / nullif(b.a, 0) * 100 AS mg2,
          a.m / a.days AS md, b.m / b.days AS md2, a.products, b.products AS products_against, a.clients, b.clients AS clients_against, coalesce(lk, 0) AS lk, coalesce(ex, 0) AS ex, u1, u2, a.u AS u
        FROM pairs p JOIN tot a ON a.campaign = p.campaign AND a.edition = p.edition JOIN tot b ON b.campaign = p.campaign AND b.edition = p.against LEFT JOIN cnt c ON c.campaign = p.campaign AND c.edition = p.edition AND c.against = p.against),
  z AS (SELECT *, (ud / nullif(ud2, 0) - 1) * 100 AS tc, CASE WHEN lk > 0 THEN ((u1 / days) / nullif(u2 / against_days, 0) - 1) * 100 END AS lc FROM j)
  SELECT campaign, edition, against, relation, days, against_days, {r('ud')} AS units_day, {r('ud2')} AS units_day_against, {r('tc')} AS units_change_pct, {r('(mp / nullif(mp2, 0) - 1) * 100')} AS price_change_pct,
    {r('mg - mg2')} AS margin_change_pp, {r('(md / nullif(md2, 0) - 1) * 100')} AS margin_day_change_pct, products, products_against, lk AS products_like, ex AS excluded_by_stock,
    CASE WHEN lk > 0 THEN {r('u1 / nullif(u, 0) * 100')} END AS like_coverage_pct, {r('lc')} AS like_units_change_pct, {r('tc - lc')} AS mix_effect_pp, clients, clients_against FROM z""")
def edition_comparison(spark, sf):
    cal = calendar(spark, sf)
    return camp.vs_editions(sales(spark, sf), cal, scope(spark, sf), camp.stock_censoring(stock(spark, sf), cal))


LABEL = """CASE WHEN r >= 4 AND f >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 4 THEN 'Loyal' WHEN r >= 4 AND f = 3 THEN 'Potential' WHEN r = 5 AND f <= 2 THEN 'New' WHEN r >= 4 AND f <= 2 THEN 'Promising'
  WHEN r = 3 AND f = 3 THEN 'Need attention' WHEN r = 3 AND f <= 2 THEN 'About to sleep' WHEN r = 2 AND f >= 3 THEN 'At risk' WHEN r = 1 AND f >= 4 THEN 'Cannot lose' WHEN r = 2 AND f <= 2 THEN 'Hibernating' ELSE 'Lost' END"""


def bucket(value, cuts, invert=False):
    """Quintile text over distinct cuts held in a list column."""
    edges = f"list_sort(list_distinct({cuts}))"
    place = f"(1 + len(list_filter({edges}, lambda c: c < {value})))"
    return f"CAST({f'len({edges}) + 2 - {place}' if invert else place} AS BIGINT)"


RFM = f"""cl AS (SELECT client, max(day) AS last_purchase, count(DISTINCT day) AS frequency, sum(amount) AS monetary, sum(units) AS units, DATE '2001-08-01' - max(day) AS recency_days
         FROM sales WHERE day BETWEEN DATE '2001-08-01' - 364 AND DATE '2001-08-01' GROUP BY 1),
  cuts AS (SELECT quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8]) AS kr, quantile_cont(frequency, [0.2, 0.4, 0.6, 0.8]) AS kf, quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS km FROM cl),
  sc0 AS (SELECT cl.*, {bucket('recency_days', 'kr', True)} AS r, {bucket('frequency', 'kf')} AS f, {bucket('monetary', 'km')} AS m FROM cl, cuts),
  rfm AS (SELECT *, {LABEL} AS segment FROM sc0)"""


@q("CMP-13 WIN-15", f"WITH {SALES}, {RFM} SELECT client, last_purchase, frequency, {r('monetary')} AS monetary, {r('units')} AS units, recency_days, r, f, m, segment FROM rfm")
def rfm_segments(spark, sf):
    return camp.rfm(sales(spark, sf), AS_OF)


@q("CMP-14 JN-13", f"""
  WITH {SALES}, {CAMPAIGNS}, {RFM}, g AS (SELECT campaign, edition, coalesce(segment, 'Unclassified') AS segment, count(DISTINCT s.client) AS clients, sum(s.units) AS units, sum(amount) AS amount, sum(cost) AS cost
    FROM sales s JOIN cal ON day BETWEEN from_day AND to_day LEFT JOIN rfm ON rfm.client = s.client GROUP BY 1, 2, 3)
  SELECT campaign, edition, segment, clients, {r('units')} AS units, {r('amount')} AS amount, {r('cost')} AS cost, {r('amount / sum(amount) OVER (PARTITION BY campaign, edition) * 100')} AS amount_share_pct,
         {r('amount - cost')} AS margin, {r('(amount - cost) / amount * 100')} AS margin_pct FROM g""")
def rfm_reach(spark, sf):
    s = sales(spark, sf)
    return camp.rfm_reach(s, camp.rfm(s, AS_OF), calendar(spark, sf))


def cohort_sql(unit, index):
    def at(column):
        return index.format(d=column)

    return f"""{SALES}, ap AS (SELECT client, CAST(date_trunc('{unit}', day) AS DATE) AS period, sum(units) AS units, sum(amount) AS amount, min(day) AS fd FROM sales GROUP BY 1, 2),
      cp AS (SELECT ap.*, min(period) OVER (PARTITION BY client) AS cohort, min(fd) OVER (PARTITION BY client) AS first_purchase FROM ap),
      ix AS (SELECT *, CAST({at('period')} - {at('cohort')} AS BIGINT) AS period_index FROM cp),
      sz AS (SELECT cohort, count(*) AS cohort_clients FROM ix WHERE period_index = 0 GROUP BY 1), la AS (SELECT max(period) AS lp FROM ix),
      out AS (SELECT ix.cohort, period_index, count(*) AS clients, sum(units) AS units, sum(amount) AS amount, max(cohort_clients) AS cohort_clients, max(CAST({at('lp')} - {at('ix.cohort')} AS BIGINT)) AS obs
              FROM ix JOIN sz ON sz.cohort = ix.cohort, la WHERE period_index BETWEEN 0 AND 6 GROUP BY 1, 2)"""


COHORT_INDEX = {
    "monthly": ("month", "(year({d}) * 12 + month({d}))"), "quarterly": ("quarter", "(year({d}) * 4 + quarter({d}))"),
    "weekly": ("week", "floor(({d} - DATE '1970-01-05') / 7)"),
}


def _cohort(granularity):
    def run(spark, sf):
        return camp.cohorts(sales(spark, sf), granularity)

    run.__name__ = f"cohorts_{granularity}"
    q("CMP-15", f"""WITH {cohort_sql(*COHORT_INDEX[granularity])} SELECT cohort, period_index, clients, {r('units')} AS units, {r('amount')} AS amount, cohort_clients,
      {r('clients * 100.0 / cohort_clients')} AS retention_pct, obs AS observable_periods, obs >= 6 AS mature, cohort_clients < 15 AS small_sample FROM out""")(run)


for _g in COHORT_INDEX:
    _cohort(_g)

ORIGINS = f"""{cohort_sql(*COHORT_INDEX['monthly'])}, {CAMPAIGNS},
  fm AS (SELECT client, min(campaign) AS origin FROM (SELECT DISTINCT client, first_purchase FROM ix) JOIN cal ON first_purchase BETWEEN from_day AND to_day GROUP BY 1),
  lb AS (SELECT ix.*, coalesce(origin, 'outside campaigns') AS origin FROM ix LEFT JOIN fm ON fm.client = ix.client),
  os AS (SELECT origin, count(*) AS origin_clients FROM lb WHERE period_index = 0 GROUP BY 1),
  og AS (SELECT lb.origin, period_index, count(*) AS clients, sum(amount) AS amount, max(origin_clients) AS origin_clients FROM lb JOIN os ON os.origin = lb.origin WHERE period_index BETWEEN 0 AND 6 GROUP BY 1, 2)"""


def origins(spark, sf):
    return camp.cohorts_by_origin(sales(spark, sf), calendar(spark, sf))


@q("CMP-16 JN-08", f"WITH {ORIGINS} SELECT origin, period_index, clients, {r('amount')} AS amount, origin_clients, {r('clients * 100.0 / origin_clients')} AS retention_pct, origin_clients < 15 AS small_sample FROM og")
def cohorts_by_origin(spark, sf):
    return origins(spark, sf)


ALERTS = EFFECT.replace(SALES + ", ", "", 1).replace(CAMPAIGNS + ", ", "", 1)
PRICE_TAIL = PRICE[len(PANEL) + 2:]


@q("CMP-17", f"""
  WITH {ORIGINS}, {ALERTS}, {PRICE_TAIL}, {STOCK}
  SELECT campaign, edition, verdict AS alert, CAST(1 AS BIGINT) AS items, NULL AS median_rise_pct, NULL AS median_real_pct, NULL AS median_apparent_pct FROM verdicts
    WHERE dimension = 'TOTAL' AND verdict IN ('pulled_forward', 'sold_more_earned_less', 'worse', 'not_comparable')
  UNION ALL SELECT campaign, edition, 'inflated_discount', count(*), {r('median(rise_before_pct)')}, {r('median(real_discount_pct)')}, {r('median(apparent_discount_pct)')} FROM pr WHERE inflated_before GROUP BY 1, 2
  UNION ALL SELECT '—', '—', 'small_cohort', count(DISTINCT origin), NULL, NULL, NULL FROM og WHERE origin_clients < 15 HAVING count(*) > 0
  UNION ALL SELECT '—', '—', 'censored_measure', count(*), NULL, NULL, NULL FROM cens WHERE days_without_stock > 0 HAVING count(*) > 0""")
def campaign_alerts(spark, sf):
    cal = calendar(spark, sf)
    return camp.campaign_alerts(effect(spark, sf), prices(spark, sf), origins(spark, sf), camp.stock_censoring(stock(spark, sf), cal))


# --- growth ------------------------------------------------------------------

def own():
    return F.col("seller") == "NATION_6"


DIMENSIONS = ["brand", "category", "priority", "flag"]

GROWTH = f"""{SELLER_SALES}, mo AS (SELECT DISTINCT year(day) AS y, month(day) AS m FROM sales), cy AS (SELECT max(y) AS c FROM mo), py AS (SELECT max(y) AS p FROM mo, cy WHERE y < c),
  per AS (SELECT c AS current_year, p AS previous_year, m AS month FROM mo, cy, py WHERE y IN (c, p) GROUP BY 1, 2, 3 HAVING count(*) = 2),
  gs AS (SELECT s.*, seller = 'NATION_6' AS own, year(day) = current_year AS now FROM seller_sales s JOIN per ON month(day) = per.month WHERE year(day) IN (current_year, previous_year)),
  lg AS (SELECT 'brand' AS dimension, brand AS member, own, now, amount FROM gs UNION ALL SELECT 'category', category, own, now, amount FROM gs UNION ALL SELECT 'priority', priority, own, now, amount FROM gs UNION ALL SELECT 'flag', flag, own, now, amount FROM gs),
  mb AS (SELECT dimension, member, coalesce(sum(amount) FILTER (WHERE own AND NOT now), 0) AS own0, coalesce(sum(amount) FILTER (WHERE own AND now), 0) AS own1,
                coalesce(sum(amount) FILTER (WHERE NOT now), 0) AS market0, coalesce(sum(amount) FILTER (WHERE now), 0) AS market1 FROM lg GROUP BY 1, 2),
  tt AS (SELECT dimension, sum(own0) AS o0, sum(own1) AS o1, sum(market0) AS m0, sum(market1) AS m1 FROM mb GROUP BY 1),
  dc AS (SELECT mb.*, own0 / o0 AS weight, market0 / m0 AS market_weight, coalesce(own1 / nullif(own0, 0) - 1, 0) AS own_growth, market1 / market0 - 1 AS market_growth, o1 / o0 - m1 / m0 AS gap FROM mb JOIN tt ON tt.dimension = mb.dimension WHERE market0 <> 0 AND o0 <> 0 AND m0 <> 0 AND m1 <> 0),
  de AS (SELECT *, weight * (own_growth - market_growth) AS performance, (weight - market_weight) * market_growth AS mix, weight * (own_growth - market_growth) + (weight - market_weight) * market_growth AS total,
                own0 / market0 AS prior_share, coalesce(own1 / nullif(market1, 0), 0) AS share FROM dc),
  sm AS (SELECT dimension, count(*) AS members, max(gap) AS gap, sum(performance) AS performance, sum(mix) AS mix, max(gap) - sum(performance) - sum(mix) AS residual, sum(abs(total)) AS weight,
                bool_or(market1 <> 0 AND share > 0 AND share < 0.999) AS competes FROM de GROUP BY 1)"""


@q("MKT-01", f"WITH {GROWTH} SELECT * FROM per")
def growth_periods(spark, sf):
    return growth.comparable_years(sales(spark, sf), "day")


def decomposed(spark, sf):
    return growth.decompose(seller_sales(spark, sf), "day", "amount", own(), DIMENSIONS)


@q("MKT-02", f"""
  WITH {GROWTH} SELECT dimension, member, {', '.join(r(c, 6) + ' AS ' + c for c in ('weight', 'market_weight', 'own_growth', 'market_growth', 'performance', 'mix', 'total', 'prior_share', 'share', 'gap'))},
    {', '.join(r(c) + ' AS ' + c for c in ('own0', 'own1', 'market0', 'market1'))} FROM de""", digits=6)
def growth_decomposition(spark, sf):
    return decomposed(spark, sf).withColumns({c: rounded(F.col(c)) for c in ("own0", "own1", "market0", "market1")})


@q("MKT-02", f"WITH {GROWTH} SELECT dimension, members, {', '.join(r(c, 6) + ' AS ' + c for c in ('gap', 'performance', 'mix', 'residual', 'weight'))}, competes FROM sm", digits=6)
def growth_summary(spark, sf):
    return growth.decomposition_summary(decomposed(spark, sf))


PRICES = f"""{GROWTH}, v AS (SELECT coalesce(sum(amount) FILTER (WHERE own AND NOT now), 0) AS v0, coalesce(sum(amount) FILTER (WHERE own AND now), 0) AS v1, coalesce(sum(units) FILTER (WHERE own AND NOT now), 0) AS u0, coalesce(sum(units) FILTER (WHERE own AND now), 0) AS u1 FROM gs),
  pv AS (SELECT v0 / nullif(u0, 0) AS price0, v1 / nullif(u1, 0) AS price1, (v1 / nullif(u1, 0)) / nullif(v0 / nullif(u0, 0), 0) - 1 AS price_change, u0 AS units0, u1 AS units1, u1 / nullif(u0, 0) - 1 AS units_change, (u1 - u0) * (v0 / nullif(u0, 0)) AS volume_effect,
                (v1 / nullif(u1, 0) - v0 / nullif(u0, 0)) * u1 AS price_effect, v1 - v0 AS value_change, v1 - v0 - (u1 - u0) * (v0 / nullif(u0, 0)) - (v1 / nullif(u1, 0) - v0 / nullif(u0, 0)) * u1 AS residual FROM v)"""


def own_prices(spark, sf):
    return growth.price_volume(seller_sales(spark, sf), "day", "amount", "units", own())


@q("MKT-03", f"WITH {PRICES} SELECT {', '.join(r(c) + ' AS ' + c for c in ('price0', 'price1', 'price_change', 'units0', 'units1', 'units_change', 'volume_effect', 'price_effect', 'value_change', 'residual'))} FROM pv")
def price_volume(spark, sf):
    return own_prices(spark, sf)


EXPLAINED = """ex AS (SELECT row_number() OVER (ORDER BY competes DESC, weight DESC, dimension) AS rank, * FROM sm WHERE members BETWEEN 2 AND 40)"""


@q("MKT-04", f"WITH {GROWTH}, {EXPLAINED} SELECT rank, dimension, members, {', '.join(r(c, 6) + ' AS ' + c for c in ('gap', 'performance', 'mix', 'residual'))}, competes FROM ex WHERE rank <= 4", digits=6)
def growth_explained(spark, sf):
    s = seller_sales(spark, sf).withColumn("brand_copy", F.concat(F.lit("x"), F.col("brand")))
    return growth.explain_growth(s, "day", "amount", own(), [*DIMENSIONS, "brand_copy"])


@q("MKT-05", f"""
  WITH {PRICES}, {EXPLAINED}, ld AS (SELECT de.* FROM de JOIN ex ON ex.dimension = de.dimension AND rank <= 2),
  lo AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total, member) AS rn FROM ld WHERE total < 0), hi AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY total DESC, member) AS rn FROM ld WHERE total > 0)
  SELECT CASE WHEN abs(performance) >= abs(mix) THEN 'performance' ELSE 'mix' END AS kind, dimension, member, {r('abs(total) * 100')} AS weight, {r('own_growth')} AS own_growth, {r('market_growth')} AS market_growth FROM lo WHERE rn <= 3
  UNION ALL SELECT 'strength', dimension, member, {r('abs(total) * 100')}, {r('own_growth')}, {r('market_growth')} FROM hi WHERE rn <= 2
  UNION ALL SELECT 'price', '—', '—', {r('abs(price_effect)')}, {r('units_change')}, NULL FROM pv WHERE abs(price_change) > 0.005""")
def growth_opportunities(spark, sf):
    facts = growth.monthly_facts(seller_sales(spark, sf), "day", ["amount", "units"], own(), DIMENSIONS)
    members = landed(growth.decompose(facts, "day", "amount", F.col("own"), DIMENSIONS))
    return growth.opportunities(members, growth.explain_members(members), growth.price_volume(facts, "day", "amount", "units", F.col("own")))


# --- contact paths -----------------------------------------------------------

def contacts(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    flags = e.where("event_type in ('signup', 'purchase', 'error')").withColumns(
        {"sent": F.lit(1), "opened": (F.col("event_type") != "error").cast("int"), "clicked": (F.col("event_type") == "purchase").cast("int")}
    )
    mail = paths.deepest_flag(flags, ["sent", "opened", "clicked"])
    web = e.where("event_type in ('view', 'click')")
    return {
        "mail": {"df": mail, "entity": "user_id", "date": "ts", "id": "event_id", "result": "result"},
        "web": {"df": web, "entity": "user_id", "date": "ts", "id": "event_id", "channel": "event_type", "result": "event_type"},
    }


PATH = """ev AS (
  SELECT user_id AS entity, ts AS contact_at, event_id AS contact_id, CASE WHEN event_type IN ('view', 'click') THEN 'web' ELSE 'mail' END AS type,
         CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'mail' END AS channel,
         CASE event_type WHEN 'purchase' THEN 'clicked' WHEN 'signup' THEN 'opened' WHEN 'error' THEN 'sent' ELSE event_type END AS result FROM events),
  path AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY contact_at, contact_id) AS contact_order, count(*) OVER (PARTITION BY entity) AS entity_contacts FROM ev)"""


@q("PTH-01", f"WITH {PATH} SELECT * FROM path")
def contact_path(spark, sf):
    return paths.contact_path(contacts(spark, sf))


@q("PTH-02", f"WITH {PATH} SELECT result, count(*) AS contacts FROM path WHERE type = 'mail' GROUP BY 1")
def deepest_flag(spark, sf):
    return contacts(spark, sf)["mail"]["df"].groupBy("result").agg(F.count(F.lit(1)).alias("contacts"))


@q("PTH-03", "SELECT 'event_type' AS channel, event_type AS value, count(*) AS contacts FROM events GROUP BY 2")
def picked_channel(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "props")
    channel = paths.pick_channel(e)
    return e.groupBy(F.lit(channel).alias("channel"), F.col(channel).alias("value")).agg(F.count(F.lit(1)).alias("contacts"))


@q("PTH-04", f"""
  WITH {PATH} SELECT count(*) AS contacts, {r('count(*) * 1.0 / count(DISTINCT entity)')} AS contacts_per_entity, max(contact_order) AS longest_path,
    count(*) FILTER (WHERE result IN ('clicked', 'opened', 'click')) AS effective, {r("count(*) FILTER (WHERE result IN ('clicked', 'opened', 'click')) * 1.0 / count(*)")} AS effectiveness FROM path""")
def path_measures(spark, sf):
    return paths.path_measures(paths.contact_path(contacts(spark, sf)))


# --- transcripts -------------------------------------------------------------

def spoken(spark, sf):
    """Conversations as turns; each role also says a line of meeting talk."""
    c = table(spark, sf, "conversations")
    line = (
        F.when(F.col("role") == "user", "Decidimos usar la base de datos. ¿Quién manda el archivo del modelo?")
        .when(F.col("role") == "assistant", "Te mando el archivo mañana. No tenemos el modelo de calidad.")
        .otherwise("We will send the report next week.")
    )
    return c.select(
        F.col("conv_id").alias("doc"), "turn", F.when(F.col("role") == "assistant", "assistant").otherwise("client").alias("speaker"),
        (F.col("turn") * 10.0).alias("start_s"), (F.col("turn") * 10.0 + 7.5).alias("end_s"), F.concat("text", F.lit("\n"), line).alias("text"),
    )


SPOKEN = """spoken AS (
  SELECT conv_id AS doc, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'client' END AS speaker, turn * 10.0::DOUBLE AS start_s, turn * 10.0::DOUBLE + 7.5 AS end_s,
         text || chr(10) || CASE role WHEN 'user' THEN 'Decidimos usar la base de datos. ¿Quién manda el archivo del modelo?' WHEN 'assistant' THEN 'Te mando el archivo mañana. No tenemos el modelo de calidad.'
           ELSE 'We will send the report next week.' END AS text FROM conversations)"""


@q("TXT-01", """
  SELECT conv_id * 10 + turn AS doc, CAST(i AS BIGINT) AS turn, CASE i WHEN 1 THEN role ELSE 'Ana Paz' END AS speaker, CASE i WHEN 1 THEN 1.0 ELSE 3725.25 END::DOUBLE AS start_s, CASE i WHEN 1 THEN 4.5 ELSE 3730.0 END::DOUBLE AS end_s,
         CASE i WHEN 1 THEN upper(role) || ' speaks' ELSE 'second caption' END AS text FROM conversations, (VALUES (1), (2)) v(i)""")
def parsed_captions(spark, sf):
    c = table(spark, sf, "conversations")
    vtt = F.concat(
        F.lit("WEBVTT\r\n\r\n1\r\n00:00:01.000 --> 00:00:04.500\r\n<v "), F.col("role"), F.lit(">"), F.upper("role"), F.lit(" <i>speaks</i></v>\r\n\r\n2\r\n01:02:05,250 --> 01:02:10,000\r\nAna Paz: second caption\r\n"),
    )
    return tx.parse_transcripts(c.select((F.col("conv_id") * 10 + F.col("turn")).alias("doc"), vtt.alias("text")))


@q("TXT-01", """
  SELECT conv_id * 10 + turn AS doc, CAST(i AS BIGINT) AS turn, CASE i WHEN 0 THEN NULL WHEN 1 THEN 'Ana' ELSE 'Luis Paz' END AS speaker, NULL AS start_s, NULL AS end_s,
         CASE i WHEN 0 THEN 'before anyone' WHEN 1 THEN 'the ' || role || ' said' ELSE 'fine' END AS text FROM conversations, (VALUES (0), (1), (2)) v(i)""")
def parsed_lines(spark, sf):
    c = table(spark, sf, "conversations")
    plain = F.concat(F.lit("before anyone\nAna: the "), F.col("role"), F.lit("\n  said\n\nLuis Paz: fine\n"))
    return tx.parse_transcripts(c.select((F.col("conv_id") * 10 + F.col("turn")).alias("doc"), plain.alias("text")))


def whole_conversations(spark, sf, piece):
    """(doc, text): every conversation as one transcript of its turns, each written by `piece`."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select(F.col("conv_id").alias("doc"), F.array_join(F.transform("turns", piece), "").alias("text"))


@q("TXT-01", """
  SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS turn, role AS speaker, turn * 10.0::DOUBLE AS start_s, turn * 10.0::DOUBLE + 7.5 AS end_s,
         trim(text, chr(32) || chr(10) || chr(9)) AS text FROM conversations""")
def parsed_caption_texts(spark, sf):
    def clock(s, ms):
        return F.format_string(f"%02d:%02d:%02d.{ms}", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)

    def caption(t):
        s = t["turn"].cast("bigint") * 10
        return F.concat(F.lit("\n\n"), clock(s, "000"), F.lit(" --> "), clock(s + 7, "500"), F.lit("\n<v "), t["role"], F.lit(">"), t["text"], F.lit("</v>"))

    docs = whole_conversations(spark, sf, caption)
    return tx.parse_transcripts(docs.withColumn("text", F.concat(F.lit("WEBVTT"), "text")))


@q("TXT-01", """
  SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn, upper(role[1]) || role[2:] AS speaker, NULL AS start_s, NULL AS end_s,
         trim(regexp_replace(trim(text, chr(32) || chr(10) || chr(9)), '\\s*\\n\\s*', ' ', 'g')) AS text FROM conversations""")
def parsed_line_texts(spark, sf):
    return tx.parse_transcripts(whole_conversations(spark, sf, lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), t["text"], F.lit("\n"))))


@q("TXT-02", """
  WITH RECURSIVE s AS (SELECT conv_id AS doc, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'client' END AS speaker, turn * 10.0::DOUBLE AS a, turn * 10.0::DOUBLE + 7.5 AS b, text FROM conversations),
  m(doc, turn, speaker, first_turn, a, b, text) AS (
    SELECT doc, turn, speaker, turn, a, b, text FROM s WHERE turn = 0
    UNION ALL SELECT s.doc, s.turn, s.speaker, CASE WHEN j THEN m.first_turn ELSE s.turn END, CASE WHEN j THEN m.a ELSE s.a END, s.b, CASE WHEN j THEN trim(rtrim(m.text) || ' ' || ltrim(s.text)) ELSE s.text END
      FROM m JOIN (SELECT * FROM s) s ON s.doc = m.doc AND s.turn = m.turn + 1, LATERAL (SELECT m.speaker = s.speaker AND length(m.text) < 700 AS j))
  SELECT doc, first_turn AS turn, speaker, a AS start_s, b AS end_s, text FROM (SELECT *, row_number() OVER (PARTITION BY doc, first_turn ORDER BY turn DESC) AS rn FROM m) WHERE rn = 1""")
def merged_turns(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc"), "turn", F.when(F.col("role") == "assistant", "assistant").otherwise("client").alias("speaker"),
        (F.col("turn") * 10.0).alias("start_s"), (F.col("turn") * 10.0 + 7.5).alias("end_s"), "text",
    )
    return tx.merge_turns(c)


@q("TXT-03", f"""
  WITH {SPOKEN}, g AS (SELECT doc, speaker, count(*) AS turns, CAST(sum(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words, sum(end_s - start_s) AS seconds FROM spoken GROUP BY 1, 2)
  SELECT doc, speaker, turns, words, {r('seconds')} AS seconds, {r('words * 100.0 / sum(words) OVER (PARTITION BY doc)')} AS words_pct FROM g""")
def participants(spark, sf):
    return tx.participants(spoken(spark, sf))


SENTENCES = f"""{SPOKEN}, cut AS (SELECT doc, turn, speaker, start_s, string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+') AS parts FROM spoken),
  sent AS (SELECT doc, turn, CAST(i - 1 AS BIGINT) AS sentence, speaker, start_s, trim(parts[i], chr(32) || chr(10) || chr(9) || chr(13)) AS text FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM cut)
           WHERE length(trim(parts[i], chr(32) || chr(10) || chr(9) || chr(13))) > 12)"""


@q("TXT-04", f"WITH {SENTENCES} SELECT doc, turn, sentence, speaker, {r('start_s')} AS start_s, text FROM sent")
def sentences(spark, sf):
    return tx.sentences(spoken(spark, sf))


def edged(words, group=""):
    return "(?i)(?:^|[^\\p{L}\\p{N}_])" + f"({words.replace(chr(39), chr(39) * 2)})" + "(?:[^\\p{L}\\p{N}_]|$)"


@q("TXT-05", f"""
  WITH {SENTENCES}, m AS (SELECT *, regexp_matches(text, '{edged(tx.DECISION)}') AS decision, regexp_matches(text, '{edged(tx.COMMITMENT)}') AS commitment, regexp_matches(text, '{edged(tx.RISK)}') AS risk,
    suffix(rtrim(text), '?') AS question, regexp_extract(text, '{edged(tx.WHEN)}', 1) AS due FROM sent)
  SELECT doc, turn, sentence, speaker, {r('start_s')} AS start_s, text, decision, commitment, risk, question, CASE WHEN commitment AND due <> '' THEN due END AS due FROM m WHERE decision OR commitment OR risk OR question""")
def meeting_minutes(spark, sf):
    return tx.minutes(tx.sentences(spoken(spark, sf)))


TOPIC_SQL = " UNION ALL ".join(
    f"SELECT *, '{topic}' AS topic FROM folded WHERE regexp_matches(f, '{'|'.join(sorted({tx._fold(w) for w in keys}))}')" for topic, keys in tx.TOPICS.items()
)


@q("TXT-06", f"WITH {SENTENCES}, folded AS (SELECT *, strip_accents(lower(text)) AS f FROM sent), hits AS ({TOPIC_SQL}) SELECT doc, turn, sentence, speaker, {r('start_s')} AS start_s, text, topic FROM hits")
def topic_mentions(spark, sf):
    return tx.topic_mentions(tx.sentences(spoken(spark, sf)))


QUESTIONS = [("files", "¿Quién manda el archivo del modelo de calidad?"), ("report", "Which report will they send next week?"), ("base", "¿Qué base de datos vamos a usar, la del modelo?")]
STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def tokens(c):
    return f"list_distinct(list_filter(regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}_]{{4,}}'), lambda x: x NOT IN ({STOPS})))"


@q("TXT-07", f"""
  WITH {SENTENCES}, qs AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{t}')" for i, t in QUESTIONS)}) v(question_id, question)),
  a AS (SELECT question_id, unnest({tokens('question')}) AS w FROM qs), b AS (SELECT doc, turn, sentence, unnest({tokens('text')}) AS w FROM sent),
  s AS (SELECT question_id, doc, turn, sentence, count(*) AS shared FROM a JOIN b ON a.w = b.w GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, doc, turn, sentence) AS rn FROM s)
  SELECT k.question_id, k.doc, k.turn, k.sentence, shared, speaker, text FROM k JOIN sent t ON t.doc = k.doc AND t.turn = k.turn AND t.sentence = k.sentence WHERE rn = 1""")
def best_passages(spark, sf):
    questions = spark.createDataFrame(QUESTIONS, "question_id string, question string")
    return tx.best_passage(questions, tx.sentences(spoken(spark, sf)))
