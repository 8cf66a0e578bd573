"""Queries over features, splits, metrics, scoring and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scale import exact_sum, ordered_rank
from ..operators import kpis
from ..operators import learning as ml
from .base import Book, r, table

BOOK = Book()
q = BOOK.add


def labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id")


def scored(spark, sf):
    """Labels with a score that repeats, so that ties matter."""
    p = F.round(1 / (1 + F.col("n_chars") / 500.0), 2)
    return labelled(spark, sf).select("doc_id", "quality", p.alias("score"))


SCORED = "scored AS (SELECT l.doc_id, quality, round(1 / (1 + n_chars / 500.0::DOUBLE), 2) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@q("ML-01", """
  WITH top AS (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 30)
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, month(l_shipdate)::DOUBLE AS l_shipdate_month, (isodow(l_shipdate) - 1)::DOUBLE AS l_shipdate_weekday, l_returnflag FROM lineitem""")
def prepared_features(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")
    ready, _, _ = ml.prepare_features(li, ["l_quantity", "l_shipdate", "l_returnflag"])
    return ready.drop("l_shipdate")


@q("ML-01 ML-04", """
  WITH j AS (SELECT l.doc_id, lang, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
  w AS (SELECT 1 + (count(DISTINCT lang) + 2) + (count(DISTINCT source) + 2) AS width FROM j)
  SELECT doc_id, width FROM j, w""")
def encoded_features(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    ready, numeric, text = ml.prepare_features(labelled(spark, sf), ["lang", "source", "n_chars"])
    model = Pipeline(stages=ml.encoder(numeric, text)).fit(ready)
    return model.transform(ready).select("doc_id", F.size(vector_to_array("features")).alias("width"))


@q("ML-02", f"""
  SELECT 'l_quantity' AS column_name, {r('abs(corr(l_quantity, l_extendedprice))', 6)} AS correlation, abs(corr(l_quantity, l_extendedprice)) > 0.98 AS leak FROM lineitem
  UNION ALL SELECT 'l_discount', {r('abs(corr(l_discount, l_extendedprice))', 6)}, false FROM lineitem
  UNION ALL SELECT 'twice', {r('abs(corr(l_extendedprice * 2, l_extendedprice))', 6)}, true FROM lineitem""", digits=6)
def leak_correlations(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", (F.col("l_extendedprice") * 2).alias("twice"), "l_extendedprice", "l_returnflag")
    return ml.leak_correlations(li, "l_extendedprice")


def part_sql(source, order):
    return f"""
      WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY {order}) AS p, count(*) OVER () AS n FROM {source})
      SELECT o_orderkey, CASE WHEN p <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.8::DOUBLE) THEN 'select' ELSE 'holdout' END AS part FROM k"""


@q("ML-03", part_sql("orders", "md5(CAST(o_orderkey AS VARCHAR))"))
def split_by_id(spark, sf):
    return ml.split_60_20_20(table(spark, sf, "orders"), id="o_orderkey").select("o_orderkey", "part")


@q("ML-03", part_sql("orders", "o_orderdate, md5(CAST(o_orderkey AS VARCHAR))"))
def split_by_date(spark, sf):
    return ml.split_60_20_20(table(spark, sf, "orders"), id="o_orderkey", date="o_orderdate").select("o_orderkey", "part")


def classifier(spark, sf):
    return ml.select_and_report(labelled(spark, sf), "quality", id="doc_id", exclude=["toxic"])


@q("ML-04 ML-08")
def classification_report(spark, sf):
    m = classifier(spark, sf)
    return m.table.unionByName(m.metrics.withColumn("model", F.concat("model", F.lit(" (holdout)"))))


@q("ML-05 ML-08")
def regression_report(spark, sf):
    o = table(spark, sf, "orders").join(
        table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("units"), F.count(F.lit(1)).alias("lines")),
        F.col("o_orderkey") == F.col("l_orderkey"),
    ).drop("l_orderkey")
    m = ml.select_and_report(o, "o_totalprice", id="o_orderkey", date="o_orderdate", exclude=["o_custkey"])
    return m.table.unionByName(m.metrics.withColumn("model", F.concat("model", F.lit(" (holdout)"))))


LEARNED = """j AS (SELECT l.*, lang, source, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
  kept AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS p, count(*) OVER () AS n FROM j WHERE quality IS NOT NULL),
  parts AS (SELECT *, CASE WHEN p <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.8::DOUBLE) THEN 'select' ELSE 'holdout' END AS part FROM kept)"""


def small_classifier(spark, sf):
    """What does not depend on how well the models are fitted needs few trees."""
    return ml.select_and_report(labelled(spark, sf), "quality", id="doc_id", exclude=["toxic"], trees=5, rounds=3)


@q("ML-04 ML-08", f"""
  WITH {LEARNED}, s AS (SELECT part, count(*) AS rows, avg(quality) AS base FROM parts GROUP BY 1)
  SELECT m AS model, rows, {r('base')} AS base_rate FROM s, (VALUES ('gradient_boosting'), ('logistic'), ('random_forest')) v(m) WHERE part = 'select'
  UNION ALL SELECT 'chosen', rows, {r('base')} FROM s WHERE part = 'holdout'""")
def classification_parts(spark, sf):
    """Rows and base rate that every candidate, and the chosen one, is judged on."""
    m = small_classifier(spark, sf)
    return m.table.unionByName(m.metrics.withColumn("model", F.lit("chosen"))).select("model", "rows", "base_rate")


@q("ML-05 ML-08", """
  WITH s AS (SELECT CASE WHEN p <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.8::DOUBLE) THEN 'select' ELSE 'holdout' END AS part
             FROM (SELECT row_number() OVER (ORDER BY o_orderdate, md5(CAST(o_orderkey AS VARCHAR))) AS p, count(*) OVER () AS n FROM orders))
  SELECT m AS model, count(*) AS rows FROM s, (VALUES ('gradient_boosting'), ('random_forest'), ('ridge')) v(m) WHERE part = 'select' GROUP BY 1
  UNION ALL SELECT 'chosen', count(*) FROM s WHERE part = 'holdout'""")
def regression_parts(spark, sf):
    m = ml.select_and_report(table(spark, sf, "orders"), "o_totalprice", id="o_orderkey", date="o_orderdate", exclude=["o_custkey"], trees=3, rounds=2)
    return m.table.unionByName(m.metrics.withColumn("model", F.lit("chosen"))).select("model", "rows")


@q("ML-01 ML-09", f"""
  WITH {LEARNED}
  SELECT 'n_chars' AS feature, true AS weighed UNION ALL SELECT DISTINCT 'lang=' || lang, true FROM parts WHERE part = 'train'
  UNION ALL SELECT DISTINCT 'source=' || source, true FROM parts WHERE part = 'train'
  UNION ALL SELECT c || s, true FROM (VALUES ('lang='), ('source=')) a(c), (VALUES ('__unseen'), ('__invalid')) b(s)""")
def weighed_features(spark, sf):
    """Every feature of the fitted vector; weights are not negative and those of a forest sum to one."""
    m = small_classifier(spark, sf)
    weights = m.importance(k=1_000_000)
    sums = weights.agg(F.sum("importance").alias("s"), F.lit(1).alias("one"))
    whole = F.lit(True) if m.name == "logistic" else F.abs(F.col("s") - 1) < 1e-9
    return weights.withColumn("one", F.lit(1)).join(F.broadcast(sums), "one").select("feature", ((F.col("importance") >= 0) & whole).alias("weighed"))


@q("ML-10", "SELECT doc_id, true AS probability FROM documents")
def scored_range(spark, sf):
    """Every document scored once, between 0 and 1, with a language or source the training rows may lack."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return small_classifier(spark, sf).score(docs, "doc_id").select("doc_id", F.col("score").between(0, 1).alias("probability"))


@q("ML-09")
def feature_importance(spark, sf):
    return classifier(spark, sf).importance()


@q("ML-10")
def scored_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return classifier(spark, sf).score(docs, "doc_id")


@q("ML-06", f"""
  WITH {SCORED}, k AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS up, count(*) OVER () AS n, avg(quality) OVER () AS base FROM scored),
  mid AS (SELECT score, avg(up) AS mr, sum(quality) AS pos, count(*) AS rows FROM k GROUP BY 1),
  pr AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(rows) OVER (ORDER BY score DESC) AS called FROM mid),
  a AS (SELECT (sum(mr * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(rows) - sum(pos))) AS auc, sum(pos) AS p FROM mid),
  ap AS (SELECT sum(pos * tp * 1.0 / called) / sum(pos) AS auc_pr FROM pr),
  c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND quality = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND quality = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND quality = 1) AS fn,
               avg(CAST((score >= 0.5) = (quality = 1) AS INTEGER)) AS acc, avg(quality) AS base, count(*) AS n,
               avg(quality) FILTER (WHERE ceil((up - 1) * 10.0 / (n - 1)) = 10) / avg(quality) AS lift FROM k)
  SELECT {r('auc', 6)} AS auc, {r('auc_pr', 6)} AS auc_pr, {r('2.0 * tp / (2 * tp + fp + fn)', 6)} AS f1, {r('acc', 6)} AS accuracy, {r('base', 6)} AS base_rate, {r('lift', 6)} AS lift_top_decile, n AS rows FROM a, ap, c""", digits=6)
def classification_metrics(spark, sf):
    return ml.classification_metrics(scored(spark, sf), "quality", "score", "doc_id")


@q("ML-07", f"""
  WITH s AS (SELECT l_extendedprice AS y, l_quantity * 2900 AS p FROM lineitem)
  SELECT {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))')} AS r2, {r('avg(abs(y - p))')} AS mae, {r('avg(abs((y - p) / y)) * 100')} AS mape, count(*) AS rows FROM s""")
def regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 2900).alias("p"))
    return ml.regression_metrics(li, "l_extendedprice", "p")


PORTFOLIO = """pf AS (SELECT c_custkey AS client, least(1.0::DOUBLE, greatest(0.0::DOUBLE, round(c_acctbal / 10000, 3))) AS p, coalesce(a, 0) AS amount, coalesce(DATE '2001-08-04' - d, 999) AS days
  FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS a, max(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey),
  dc AS (SELECT *, row_number() OVER (ORDER BY p, client) AS rk, count(*) OVER () AS n,
    CASE WHEN p >= 0.65 THEN CASE WHEN days <= 30 THEN 'soft reminder' ELSE 'full payment 5 % off' END WHEN p >= 0.35 THEN CASE WHEN days <= 90 THEN 'instalment plan' ELSE 'instalment plan with reduction' END
         WHEN days <= 90 THEN 'steep reduction' WHEN amount >= 500000 THEN 'referral' ELSE 'maximum discount' END AS strategy FROM pf),
  ds AS (SELECT dc.*, discount, instalments FROM dc JOIN (VALUES ('soft reminder', 0.00::DOUBLE, 1), ('full payment 5 % off', 0.05, 1), ('instalment plan', 0.10, 3), ('instalment plan with reduction', 0.20, 6),
         ('steep reduction', 0.30, 1), ('referral', 0.15, 12), ('maximum discount', 0.45, 1)) v(s, discount, instalments) ON s = strategy),
  fin AS (SELECT client, p, amount, days, CAST(greatest(ceil((rk - 1) * 10.0 / (n - 1)), 1) AS BIGINT) AS decile, CASE WHEN p <= 0.35 THEN 'Low' WHEN p <= 0.65 THEN 'Medium' ELSE 'High' END AS propensity, strategy, discount,
            CAST(instalments AS BIGINT) AS instalments, p * amount * (1 - discount) AS expected FROM ds)"""


def portfolio(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(exact_sum("o_totalprice").alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("d"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    frame = c.select(
        F.col("c_custkey").alias("client"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.col("c_acctbal") / 10000, 3))).alias("p"),
        F.coalesce("a", F.lit(0.0)).alias("amount"), F.coalesce(F.datediff(F.lit("2001-08-04").cast("date"), "d"), F.lit(999)).alias("days"),
    )
    return ml.collections_decision(frame, "p", "amount", "days", "client")


@q("ML-11 WIN-14 WIN-16", f"""
  WITH {PORTFOLIO} SELECT client, {r('p')} AS p, {r('amount')} AS amount, days, decile, propensity, strategy, {r('discount')} AS discount, instalments, {r('expected')} AS expected_recovery,
    row_number() OVER (ORDER BY expected DESC, client) AS priority FROM fin""")
def collections_decision(spark, sf):
    return portfolio(spark, sf)


@q("AGG-24", f"WITH {PORTFOLIO} SELECT strategy, count(*) AS clients, {r('avg(p)')} AS mean_probability, {r('sum(expected)')} AS expected_value FROM fin GROUP BY 1")
def strategy_summary(spark, sf):
    return kpis.strategy_summary(portfolio(spark, sf), "strategy", "p", "expected_recovery")


def _target(column, task, holds, rate="NULL", classes="NULL", points=1):
    return (
        f"SELECT '{column}' AS column_name, '{task}' AS task, CAST({classes} AS BIGINT) AS classes, CAST({rate} AS DOUBLE) AS positive_rate, "
        f"CAST({points} AS BIGINT) AS points FROM j HAVING {holds}"
    )


TARGETS = " UNION ALL ".join(
    [_target(c, "classification", f"count(DISTINCT {c}) = 2", f"round(avg({c}), 4)", 2, 3) for c in ("quality", "toxic")]
    + [_target(c, "regression", f"count(DISTINCT {c}) > 20") for c in ("doc_id", "n_chars")]
)


@q("ML-12", f"WITH j AS (SELECT l.*, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id) {TARGETS}")
def suggested_targets(spark, sf):
    return ml.suggest_targets(labelled(spark, sf))


def measured(spark, sf):
    m = ml.classification_metrics(scored(spark, sf), "quality", "score", "doc_id")
    return m.withColumns({"gap": F.lit(0.06), "model": F.lit("by length")})


SIMPLE = f"""{SCORED}, k AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS up, count(*) OVER () AS n FROM scored),
  mid AS (SELECT score, avg(up) AS mr, sum(quality) AS pos, count(*) AS rows FROM k GROUP BY 1),
  a AS (SELECT (sum(mr * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(rows) - sum(pos))) AS auc FROM mid),
  c AS (SELECT avg(quality) AS base, avg(quality) FILTER (WHERE ceil((up - 1) * 10.0 / (n - 1)) = 10) / avg(quality) AS lift FROM k)"""


@q("ML-13", f"""
  WITH {SIMPLE} SELECT {r('greatest(0, least(100, 70 * greatest(0, least(1, (auc - 0.5) / 0.3)) + 30 * greatest(0, least(1, (lift - 1) / (1 / base - 1))) - least(30, 0.06 * 300) - CASE WHEN auc >= 0.95 THEN 30 ELSE 0 END))')} AS model_score,
    auc >= 0.95 AS suspected_leak FROM a, c""")
def model_score(spark, sf):
    return ml.model_score(measured(spark, sf)).select("model_score", "suspected_leak")


@q("ML-14", f"""
  WITH {SIMPLE}, w AS (SELECT unnest(['suspicious_auc', 'protected_attribute', 'imbalance', 'gap', 'few_origins']) AS warning, unnest(['high', 'high', 'medium', 'medium', 'medium']) AS severity, unnest([auc >= 0.95, true, base < 0.05 OR base > 0.95, true, true]) AS raised FROM a, c)
  SELECT 'by length' AS model, warning, severity FROM w WHERE raised""")
def model_warnings(spark, sf):
    return ml.model_warnings(measured(spark, sf), ["n_chars", "sexo_F", "estado_civil_casado"], origins=4)


@q("WIN-16 SRT-02", """SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY score DESC, doc_id) AS position, count(*) OVER (PARTITION BY quality) AS group_rows
  FROM (SELECT l.doc_id, quality, round(1 / (1 + n_chars / 500.0::DOUBLE), 2) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)""")
def rank_within_class(spark, sf):
    return ordered_rank(scored(spark, sf), "score", "doc_id", ["quality"], descending=True).select("doc_id", "position", "group_rows")
