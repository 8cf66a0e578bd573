"""Queries over quality rules, profiling, governance and freshness."""

from __future__ import annotations

from datetime import date, datetime
from itertools import combinations

from pyspark.sql import functions as F

from ..operators import freshness as fresh
from ..operators import governance, joins, profiling, quality
from .base import COLUMNS, Book, every_table, r, table

BOOK = Book()
q = BOOK.add

AS_OF = date(2001, 8, 4)


def orders_with_defects(spark, sf):
    """Orders with holes the rules must find, made from the orders' own values."""
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        "o_orderkey",
        F.when(status != "P", F.col("o_custkey")).alias("client"),
        F.when(status == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
        F.when(status == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("amount_text"),
        "o_orderstatus", "o_orderpriority", "o_orderdate",
    )


DEFECTS = """defects AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS client,
         CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount,
         o_totalprice AS price, o_orderstatus, o_orderpriority, o_orderdate FROM orders)"""


def rule_query(*rules):
    def run(spark, sf):
        tables = {"defects": orders_with_defects(spark, sf), "customer": table(spark, sf, "customer")}
        return quality.evaluate_rules(spark, tables, rules, AS_OF).drop("detail")

    return run


def rule_sql(*rows):
    """(rule, column, dimension, failing expression, source, pass condition) per rule."""
    parts = []
    for rule, column, dimension, failing, source, passed in rows:
        parts.append(
            f"SELECT '{rule}:defects{'.' + column if column else ''}' AS rule, 'defects' AS table_name, '{column}' AS column_name, "
            f"'{dimension}' AS dimension, {passed or 'n = 0'} AS passed, n AS failing, true AS critical FROM (SELECT CAST({failing} AS BIGINT) AS n FROM {source})"
        )
    return f"WITH {DEFECTS} " + " UNION ALL ".join(parts)


def _register(name, ids, rules, rows):
    run = rule_query(*rules)
    run.__name__ = name
    q(ids, rule_sql(*rows))(run)


def rule(kind, column=None, **more):
    out = {"table": "defects", "type": kind, **more}
    if column:
        out["column"] = column
    return out


_register("rule_not_null", "DQ-01", [rule("not_null", "client"), rule("not_null", "o_orderkey")], [
    ("not_null", "client", "completeness", "count(*) FILTER (WHERE client IS NULL)", "defects", None),
    ("not_null", "o_orderkey", "completeness", "count(*) FILTER (WHERE o_orderkey IS NULL)", "defects", None),
])
_register("rule_unique", "DQ-02", [rule("unique", "client"), rule("unique", "o_orderkey")], [
    ("unique", "client", "uniqueness", "count(*) - count(DISTINCT client) - max(CASE WHEN client IS NULL THEN 1 ELSE 0 END)", "defects", None),
    ("unique", "o_orderkey", "uniqueness", "count(*) - count(DISTINCT o_orderkey)", "defects", None),
])
_register("rule_range", "DQ-03", [rule("range", "amount", min=0, max=400000), rule("range", "amount_text", min=1000)], [
    ("range", "amount", "validity", "count(*) FILTER (WHERE amount < 0 OR amount > 400000)", "defects", None),
    ("range", "amount_text", "validity", "count(*) FILTER (WHERE o_orderstatus <> 'P' AND price < 1000)", "defects", None),
])
_register("rule_allowed", "DQ-04", [rule("allowed", "o_orderstatus", values=["O", "F"]), rule("allowed", "client", values=[1, 2, 3])], [
    ("allowed", "o_orderstatus", "validity", "count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F'))", "defects", None),
    ("allowed", "client", "validity", "count(*) FILTER (WHERE client NOT IN (1, 2, 3))", "defects", None),
])
_register("rule_regex", "DQ-05", [rule("regex", "o_orderpriority", pattern="[1-3]-"), rule("regex", "o_orderpriority", pattern="1|2")], [
    ("regex", "o_orderpriority", "validity", "count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^(?:[1-3]-)'))", "defects", None),
    ("regex", "o_orderpriority", "validity", "count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^(?:1|2)'))", "defects", None),
])
_register("rule_sign", "DQ-06", [rule("positive", "amount"), rule("non_negative", "amount"), rule("non_negative", "amount_text")], [
    ("positive", "amount", "validity", "count(*) FILTER (WHERE amount <= 0)", "defects", None),
    ("non_negative", "amount", "validity", "count(*) FILTER (WHERE amount < 0)", "defects", None),
    ("non_negative", "amount_text", "validity", "count(*) FILTER (WHERE o_orderstatus <> 'P' AND price < 0)", "defects", None),
])
_register("rule_rows", "DQ-07", [rule("rows_min", value=100), rule("rows_exact", value=7)], [
    ("rows_min", "", "completeness", "count(*)", "defects", "n >= 100"),
    ("rows_exact", "", "completeness", "count(*)", "defects", "n = 7"),
])
_register("rule_reference", "DQ-08", [rule("reference", "client", to="customer.c_custkey"), rule("reference", "client", to="customer.c_nationkey")], [
    ("reference", "client", "consistency", "count(*) FILTER (WHERE client IS NOT NULL AND client NOT IN (SELECT c_custkey FROM customer))", "defects", None),
    ("reference", "client", "consistency", "count(*) FILTER (WHERE client IS NOT NULL AND client NOT IN (SELECT c_nationkey FROM customer))", "defects", None),
])
_register("rule_fresh", "DQ-09", [rule("fresh", "o_orderdate", days=5), rule("fresh", "o_orderpriority")], [
    ("fresh", "o_orderdate", "timeliness", "DATE '2001-08-04' - max(CAST(o_orderdate AS DATE))", "defects", "n <= 5"),
    ("fresh", "o_orderpriority", "timeliness", "1000000 + 0 * max(o_orderkey)", "defects", "n <= 1"),
])
_register("rule_expression", "DQ-10", [rule("expression", expression="amount > 0 and client > 10"), rule("expression", expression="amount >")], [
    ("expression", "", "accuracy", "count(*) FILTER (WHERE NOT coalesce(amount > 0 AND client > 10, false))", "defects", None),
    ("expression", "", "accuracy", "CASE WHEN count(*) < 0 THEN 1 END", "defects", "false"),
])


@q("DQ-11", """
  SELECT 'rows_min:orders' AS rule, '' AS column_name, true AS passed, count(*) AS failing, true AS critical FROM orders
  UNION ALL SELECT 'not_null:orders.empty', 'empty', false, count(*), false FROM orders
  UNION ALL SELECT 'rows_min:part', '', true, count(*), true FROM part""")
def automatic_rules(spark, sf):
    tables = {
        "orders": table(spark, sf, "orders").withColumn("empty", F.lit(None).cast("string")),
        "part": table(spark, sf, "part"),
        "customer": table(spark, sf, "customer"),
    }
    declared = [{"table": "customer", "type": "rows_min", "value": 5}]
    rules = quality.auto_rules(tables, declared)
    return quality.evaluate_rules(spark, tables, rules).select("rule", "column_name", "passed", "failing", "critical")


SCORED = [
    rule("not_null", "client"), rule("not_null", "o_orderkey", critical=False), rule("unique", "o_orderkey"),
    rule("non_negative", "amount", critical=False), rule("allowed", "o_orderstatus", values=["O", "F", "P"]),
    rule("reference", "client", to="customer.c_custkey"), rule("expression", expression="amount <> 0", dimension="consistency"),
]

SCORED_SQL = f"""{DEFECTS}, results AS (
  SELECT 'completeness' AS dimension, count(*) FILTER (WHERE client IS NULL) = 0 AS passed, true AS critical FROM defects
  UNION ALL SELECT 'completeness', count(*) FILTER (WHERE o_orderkey IS NULL) = 0, false FROM defects
  UNION ALL SELECT 'uniqueness', count(*) = count(DISTINCT o_orderkey), true FROM defects
  UNION ALL SELECT 'validity', count(*) FILTER (WHERE amount < 0) = 0, false FROM defects
  UNION ALL SELECT 'validity', count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F', 'P')) = 0, true FROM defects
  UNION ALL SELECT 'consistency', count(*) FILTER (WHERE client IS NOT NULL AND client NOT IN (SELECT c_custkey FROM customer)) = 0, true FROM defects
  UNION ALL SELECT 'consistency', count(*) FILTER (WHERE amount = 0) = 0, true FROM defects)"""


def scored(spark, sf):
    tables = {"defects": orders_with_defects(spark, sf), "customer": table(spark, sf, "customer")}
    return quality.evaluate_rules(spark, tables, SCORED)


@q("DQ-12", f"""
  WITH {SCORED_SQL}, names AS (SELECT unnest(['completeness', 'uniqueness', 'validity', 'consistency', 'accuracy', 'timeliness', 'TOTAL']) AS dimension),
  doubled AS (SELECT dimension, passed FROM results UNION ALL SELECT 'TOTAL', passed FROM results)
  SELECT n.dimension, count(passed) AS rules, count(*) FILTER (WHERE passed) AS ok, round(avg(CAST(passed AS INTEGER)) * 100, 1) AS score
  FROM names n LEFT JOIN doubled d ON n.dimension = d.dimension GROUP BY 1""")
def quality_score(spark, sf):
    return quality.score(scored(spark, sf))


@q("DQ-13", f"""
  WITH {SCORED_SQL}
  SELECT count(*) AS rules, round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 1) AS score,
         count(*) FILTER (WHERE critical AND NOT passed) AS critical_failed,
         count(*) FILTER (WHERE passed) * 100.0 / count(*) < 90 AS below_minimum,
         NOT (count(*) FILTER (WHERE critical AND NOT passed) > 0 OR count(*) FILTER (WHERE passed) * 100.0 / count(*) < 90) AS passed FROM results""")
def quality_gate(spark, sf):
    return quality.gate(scored(spark, sf), minimum=90)


@q("DQ-13", f"""
  WITH {SCORED_SQL}
  SELECT count(*) AS rules, round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 1) AS score,
         count(*) FILTER (WHERE critical AND NOT passed) AS critical_failed,
         count(*) FILTER (WHERE passed) * 100.0 / count(*) < 90 AS below_minimum, true AS passed FROM results""")
def quality_gate_warning_only(spark, sf):
    return quality.gate(scored(spark, sf), minimum=90, minimum_cuts=False, critical_cuts=False)


# --- profiling ---------------------------------------------------------------

RULED = ("orders", "customer", "part", "lineitem")


def _proposed(severity, name, rule, column, to, holds, value="NULL"):
    quoted = lambda x: f"'{x}'" if x else "NULL"
    return (
        f"SELECT '{severity}' AS severity, '{name}' AS table_name, '{rule}' AS rule, {quoted(column)} AS column_name, "
        f"CAST({value} AS DOUBLE) AS value, {quoted(to)} AS to FROM {name} HAVING {holds}"
    )


SUGGESTED = " UNION ALL ".join(
    [_proposed("medium", n, "rows_min", None, None, "count(*) > 0", "greatest(1, count(*) // 2)") for n in RULED]
    + [_proposed("high", n, "unique", c, None, f"count(*) = count(DISTINCT {c})")
       for n, c in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"))]
    + [_proposed("low", n, "non_negative", c, None, f"min({c}) >= 0 AND count(DISTINCT {c}) > 2")
       for n, c in (("orders", "o_totalprice"), ("part", "p_retailprice"), ("lineitem", "l_extendedprice"))]
    + [_proposed("high", n, "reference", c, f"{o}.{k}", f"count(*) FILTER (WHERE {c} IN (SELECT {k} FROM {o})) > 0.95 * count({c})")
       for n, c, o, k in (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
                          ("lineitem", "l_partkey", "part", "p_partkey"))]
)


@q("DQ-14", SUGGESTED)
def suggested_rules(spark, sf):
    return profiling.suggest_rules({n: table(spark, sf, n) for n in RULED})


def _starter(item, kind, column, holds="count(*) > 0", value="NULL"):
    named = f"'{column}'" if column else "NULL"
    return (
        f"SELECT 'part' AS table_name, '{item}' AS item, '{kind}' AS kind, {named} AS column_name, CAST({value} AS DOUBLE) AS value "
        f"FROM part HAVING {holds}"
    )


PART = [c for family in COLUMNS["part"].values() for c in family]
STARTER = " UNION ALL ".join(
    [_starter("rule", "rows_min", None, value="greatest(1, count(*) // 2)"), _starter("kpi", "count", None),
     _starter("rule", "unique", "p_partkey", "count(*) = count(DISTINCT p_partkey)")]
    + [_starter("rule", "not_null", c, f"count(*) = count({c})") for c in PART]
    + [_starter("rule", "non_negative", c, f"min({c}) >= 0") for c in ("p_size", "p_retailprice")]
    + [_starter("kpi", "sum", c, f"count({c}) > 0") for c in ("p_size", "p_retailprice")]
)


@q("DQ-15", STARTER)
def starter_rules(spark, sf):
    return profiling.starter_rules(table(spark, sf, "part"), "part")


def _smallest_key(name, order, widest=3):
    """SQL that tries every combination of a table's columns, smallest first."""
    tries = [
        f"WHEN (SELECT count(*) FROM (SELECT DISTINCT {', '.join(k)} FROM {name})) = count(*) THEN '{' + '.join(k)}'"
        for width in range(1, widest + 1) for k in combinations(order, width)
    ]
    return f"SELECT '{name}' AS table_name, CASE {' '.join(tries)} END AS key FROM {name}"


# Key columns in the order in which the tables have them.
IN_ORDER = {
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "embeddings": ["vec_id", "label"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"],
    "conversations": ["conv_id", "turn", "role", "text"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"], "events": ["event_id", "ts", "user_id", "event_type", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"], "pages": ["page_id", "url", "html"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"], "said": ["conv_id", "turn", "role"],
}
KEYS = " UNION ALL ".join(_smallest_key(n, c) for n, c in IN_ORDER.items())


@q("DQ-16", f"""
  WITH said AS (SELECT conv_id, turn, role FROM conversations), keys AS ({KEYS})
  SELECT table_name, key, CAST(len(string_split(key, ' + ')) AS BIGINT) AS columns FROM keys""")
def candidate_keys(spark, sf):
    """The key of every table, and of the conversations without their texts."""
    tables = every_table(spark, sf)
    return profiling.candidate_keys(tables | {"said": tables["conversations"].drop("text")})


@q("DQ-17", """
  SELECT 'key' AS column_name, 1.0::DOUBLE AS share, true AS numeric_text FROM orders GROUP BY 1
  UNION ALL SELECT 'status', 0.0, false FROM orders GROUP BY 1
  UNION ALL SELECT 'mixed', round(count(*) FILTER (WHERE o_orderstatus <> 'P') * 1.0 / count(*), 4), count(*) FILTER (WHERE o_orderstatus <> 'P') * 1.0 / count(*) > 0.95 FROM orders""")
def numeric_text(spark, sf):
    o = table(spark, sf, "orders").select(
        F.format_number("o_orderkey", 2).alias("key"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "P", "x1").otherwise("12").alias("mixed"),
    )
    return profiling.numeric_text_columns(o)


RELATIONS = [
    {"name": "orders_customer", "from_table": "defects", "from_column": "client", "to_table": "customer", "to_column": "c_custkey"},
    {"name": "orders_rich", "from_table": "defects", "from_column": "client", "to_table": "rich", "to_column": "c_custkey"},
    {"name": "orders_nation", "from_table": "defects", "from_column": "client", "to_table": "customer", "to_column": "c_nationkey"},
]


def relation_tables(spark, sf):
    c = table(spark, sf, "customer")
    return {"defects": orders_with_defects(spark, sf), "customer": c, "rich": c.where("c_acctbal > 5000")}


@q("DQ-18", f"""
  WITH {DEFECTS}
  SELECT 'orders_customer' AS relation, count(*) AS rows, count(*) FILTER (WHERE client IS NOT NULL AND client NOT IN (SELECT c_custkey FROM customer)) AS orphans,
         count(*) FILTER (WHERE client IS NULL) AS blanks, CAST(0 AS BIGINT) AS repeated_keys FROM defects
  UNION ALL SELECT 'orders_rich', count(*), count(*) FILTER (WHERE client IS NOT NULL AND client NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)),
         count(*) FILTER (WHERE client IS NULL), 0 FROM defects
  UNION ALL SELECT 'orders_nation', count(*), count(*) FILTER (WHERE client IS NOT NULL AND client NOT IN (SELECT c_nationkey FROM customer)),
         count(*) FILTER (WHERE client IS NULL), (SELECT count(*) FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)) FROM defects""")
def relation_integrity(spark, sf):
    return profiling.relation_integrity(relation_tables(spark, sf), RELATIONS)


@q("DQ-19", """
  SELECT 'orders_customer' AS relation, true AS ends_exist, true AS types_match, count(*) = count(DISTINCT c_custkey) AS one_side_unique,
         count(*) FILTER (WHERE c_custkey IS NULL) = 0 AS one_side_filled, true AS only_active FROM customer
  UNION ALL SELECT 'orders_rich', true, true, count(*) = count(DISTINCT c_custkey), count(*) FILTER (WHERE c_custkey IS NULL) = 0, true FROM customer WHERE c_acctbal > 5000
  UNION ALL SELECT 'orders_nation', true, true, count(*) = count(DISTINCT c_nationkey), true, false FROM customer
  UNION ALL SELECT 'orders_name', true, false, count(*) = count(DISTINCT c_name), true, true FROM customer
  UNION ALL SELECT 'broken', false, false, false, count(*) < 0, true FROM customer""")
def relation_preconditions(spark, sf):
    more = [
        {"name": "orders_name", "from_table": "defects", "from_column": "client", "to_table": "customer", "to_column": "c_name", "active": False},
        {"name": "broken", "from_table": "defects", "from_column": "client", "to_table": "nowhere", "to_column": "x", "active": False},
    ]
    return profiling.relation_preconditions(relation_tables(spark, sf), [*RELATIONS, *more])


VALUES = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, {i} AS ti, {j} AS ci, '{family}' AS f, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY ALL"
    for i, t in enumerate(COLUMNS)
    for j, (c, family) in enumerate(sorted(
        ((c, f) for f, cs in COLUMNS[t].items() for c in cs if f != "fraction"),
        key=lambda x: IN_ORDER[t].index(x[0]) if x[0] in IN_ORDER[t] else 99))
)

RELATED = f"""
  v AS ({VALUES}),
  own AS (SELECT t, c, ti, ci, f, sum(n) AS rows, coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0) AS filled, count(v) AS values,
          regexp_replace(lower(c), '^[a-z]{{1,2}}_', '') AS stem FROM v GROUP BY ALL),
  shared AS (SELECT a.t AS t, a.c AS c, b.t AS u, b.c AS d, count(*) AS found, sum(a.n) AS found_rows
             FROM v a JOIN v b ON a.f = b.f AND a.v = b.v AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)"""


@q("DQ-20", f"""
  WITH {RELATED},
  named AS (
    SELECT a.t, a.c, b.t AS u, b.c AS d, a.ti, a.ci, b.ti AS ui, b.ci AS di, a.rows AS ra, b.rows AS rb,
           a.rows = a.filled AND a.filled = a.values AS ua, b.rows = b.filled AND b.filled = b.values AS ub
    FROM own a JOIN own b ON a.ti < b.ti AND a.f = b.f AND (a.stem = b.stem
      OR regexp_replace(a.stem, '(id|key|code)$', '') = b.t OR regexp_replace(b.stem, '(id|key|code)$', '') = a.t)),
  turned AS (
    SELECT *, CASE WHEN ua AND ub AND ra = rb THEN 'ambiguous' WHEN ub AND (NOT ua OR ra > rb) THEN 'first' WHEN ua THEN 'second' END AS side FROM named),
  sided AS (
    SELECT CASE WHEN side = 'second' THEN u ELSE t END AS from_table, CASE WHEN side = 'second' THEN d ELSE c END AS from_column,
           CASE WHEN side = 'second' THEN t ELSE u END AS to_table, CASE WHEN side = 'second' THEN c ELSE d END AS to_column,
           side, ti, ui, ci, di FROM turned WHERE side IS NOT NULL),
  measured AS (
    SELECT s.*, coalesce(h.found, 0) * 1.0 / o.values AS share
    FROM sided s JOIN own o ON o.t = from_table AND o.c = from_column
         LEFT JOIN shared h ON h.t = from_table AND h.c = from_column AND h.u = to_table AND h.d = to_column)
  SELECT from_table, from_column, to_table, to_column, 'many_to_one' AS kind, {r('share')} AS share FROM measured
  WHERE side <> 'ambiguous' AND share >= 0.9 QUALIFY row_number() OVER (PARTITION BY ti, ui ORDER BY ci, di) = 1
  UNION ALL SELECT from_table, from_column, to_table, to_column, 'ambiguous', NULL FROM measured WHERE side = 'ambiguous'""")
def inferred_relations(spark, sf):
    """Relations among all tables."""
    return profiling.infer_relations(every_table(spark, sf))


@q("DQ-20", f"""
  WITH {RELATED}
  SELECT h.t AS from_table, h.c AS from_column, h.u AS to_table, h.d AS to_column, o.rows::BIGINT AS rows, o.filled::BIGINT AS filled,
         o.values::BIGINT AS values, h.found::BIGINT AS found, h.found_rows::BIGINT AS found_rows
  FROM shared h JOIN own o ON o.t = h.t AND o.c = h.c WHERE h.found >= 0.9 * o.values""")
def inclusion_dependencies(spark, sf):
    """Every column of every table that lies, but for a tenth of its values, in another one, whatever its name."""
    tables = {n: df.select(*[c for f, cs in COLUMNS[n].items() if f != "fraction" for c in cs]) for n, df in every_table(spark, sf).items()}
    found = profiling.inclusions(tables).where("(from_table, from_column) <> (to_table, to_column) AND found >= 0.9 * values")
    return found.drop("most")


@q("DQ-20", """
  SELECT count(DISTINCT l_orderkey) AS values, count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) AS found,
         round(count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) * 1.0 / count(DISTINCT l_orderkey), 4) AS share FROM lineitem""")
def containment(spark, sf):
    return profiling.contained(table(spark, sf, "lineitem"), "l_orderkey", table(spark, sf, "orders").where("o_orderstatus = 'O'"), "o_orderkey")


@q("DQ-21", """
  SELECT 'data' AS area, 85.0::DOUBLE + 15 * CAST(count(*) = count(DISTINCT c_custkey) AS INTEGER) AS score FROM customer
  UNION ALL SELECT 'quality', round(0.7 * 80 + 0.3 * 100 * count(DISTINCT 1) / 2, 1) FROM orders""")
def measured_health(spark, sf):
    return profiling.health({n: table(spark, sf, n) for n in ("orders", "customer")}, 80.0, ["orders"])


# --- governance --------------------------------------------------------------

LABELS = {"customer.c_name": "Client name", "o_custkey": "Client of the order"}


def catalog_rows(spark, sf, exact=True):
    layers = {
        "silver": {"customer": table(spark, sf, "customer"), "defects": orders_with_defects(spark, sf).select("o_orderkey", "client")},
        "gold": {"fact": table(spark, sf, "orders").select(F.col("o_custkey"), F.col("o_custkey").alias("client_key"))},
    }
    return governance.catalog(layers, LABELS, ["o_custkey"], exact)


def _entry(layer, name, column, kind, source, value, key, pii, label):
    return (
        f"SELECT '{layer}' AS layer, '{name}' AS table_name, '{column}' AS column_name, '{kind}' AS type, "
        f"{r(f'count(*) FILTER (WHERE {value} IS NULL) * 100.0 / count(*)')} AS null_pct, count(DISTINCT {value}) AS distinct_values, "
        f"{key} AS is_key, {pii} AS pii, '{label}' AS description FROM {source}"
    )


CATALOG = " UNION ALL ".join([
    _entry("silver", "customer", "c_custkey", "bigint", "customer", "c_custkey", "false", "false", ""),
    _entry("silver", "customer", "c_name", "string", "customer", "c_name", "false", "true", "Client name"),
    _entry("silver", "customer", "c_nationkey", "int", "customer", "c_nationkey", "false", "false", ""),
    _entry("silver", "customer", "c_acctbal", "double", "customer", "c_acctbal", "false", "false", ""),
    _entry("silver", "customer", "c_mktsegment", "string", "customer", "c_mktsegment", "false", "false", ""),
    _entry("silver", "defects", "o_orderkey", "bigint", "defects", "o_orderkey", "false", "false", ""),
    _entry("silver", "defects", "client", "bigint", "defects", "client", "false", "false", ""),
    _entry("gold", "fact", "o_custkey", "bigint", "orders", "o_custkey", "false", "true", "Client of the order"),
    _entry("gold", "fact", "client_key", "bigint", "orders", "o_custkey", "true", "false", ""),
])


@q("GOV-01", f"WITH {DEFECTS} {CATALOG}")
def column_catalog(spark, sf):
    return catalog_rows(spark, sf)


@q("GOV-01")
def column_catalog_sketched(spark, sf):
    return catalog_rows(spark, sf, exact=False)


@q("GOV-02", f"""
  WITH {SCORED_SQL}, entries AS ({CATALOG})
  SELECT {r("count(*) FILTER (WHERE description <> '') * 100.0 / count(*)")} AS documented_pct, count(*) FILTER (WHERE pii) AS pii_columns,
         count(DISTINCT layer || '.' || table_name) AS tables, (SELECT round(avg(CAST(passed AS INTEGER)) * 100, 1) FROM results) AS quality_score FROM entries""")
def governance_scores(spark, sf):
    return governance.governance_scores(catalog_rows(spark, sf), quality.score(scored(spark, sf)))


# --- freshness ---------------------------------------------------------------

NOW = datetime(2024, 1, 31, 6, 0, 0)


def dated(spark, sf):
    """Orders with a planned date far ahead, which must not count as fresh."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return o.withColumn("planned", F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")) + F.expr("interval 1 day"))


@q("FRS-01", """
  SELECT 'orders' AS table_name, count(*) AS rows, max(o_orderdate) AS data_date, 'o_orderdate' AS date_column FROM orders
  UNION ALL SELECT 'events', count(*), max(ts), 'ts' FROM events
  UNION ALL SELECT 'fact', count(*), max(date_trunc('day', o_orderdate)), 'date_key' FROM orders""")
def max_business_date(spark, sf):
    fact = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key"))
    return joins.union_all([
        fresh.max_business_date(dated(spark, sf), "orders", NOW),
        fresh.max_business_date(table(spark, sf, "events"), "events", NOW),
        fresh.max_business_date(fact, "fact", NOW),
    ])


def _hours(expression):
    return f"round(epoch(TIMESTAMP '2024-01-31 06:00:00' - {expression}) / 3600, 1)"


@q("FRS-02", f"""
  SELECT 'events' AS table_name, count(*) AS rows, max(ts) AS data_date, 'ts' AS date_column, NULL AS load_date, {_hours('max(ts)')} AS hours_since_data, NULL AS hours_since_load,
         'daily' AS every, 27.6::DOUBLE AS tolerance_hours, 'up_to_date' AS state, max(ts) + INTERVAL 24 HOUR AS next_load FROM events
  UNION ALL SELECT 'orders', count(*), max(o_orderdate), 'o_orderdate', TIMESTAMP '2024-01-31 00:00:00', {_hours('max(o_orderdate)')}, 6.0, 'weekly', 193.2, 'late', TIMESTAMP '2024-02-07 00:00:00' FROM orders
  UNION ALL SELECT 'customer', count(*), NULL, NULL, TIMESTAMP '2024-01-30 00:00:00', NULL, 30.0, 'daily', 27.6, 'late', TIMESTAMP '2024-01-31 00:00:00' FROM customer
  UNION ALL SELECT 'part', count(*), NULL, NULL, NULL, NULL, NULL, 'daily', 27.6, 'no_date', NULL FROM part""")
def table_freshness(spark, sf):
    tables = {"events": table(spark, sf, "events"), "orders": dated(spark, sf), "customer": table(spark, sf, "customer"), "part": table(spark, sf, "part")}
    return fresh.freshness(
        tables, NOW, {"orders": {"every": "weekly"}},
        {"orders": datetime(2024, 1, 31), "customer": datetime(2024, 1, 30)},
    )


def _run(day):
    return (f"SELECT 'events' AS table_name, count(*) AS rows, max(ts) AS data_date, 'up_to_date' AS state, '2024-01-{day}T06-00-00' AS run "
            f"FROM events WHERE ts < TIMESTAMP '2024-01-{day} 06:00:00'")


@q("FRS-03", f"{_run(30)} UNION ALL {_run(31)}")
def run_history(spark, sf):
    from .base import scratch

    path = scratch(spark)
    events = table(spark, sf, "events")
    for day in (30, 31):
        now = datetime(2024, 1, day, 6)
        rows = fresh.freshness({"events": events.where(F.col("ts") < F.lit(now.isoformat()).cast("timestamp_ntz"))}, now)
        fresh.record_history(rows.select("table_name", "rows", "data_date", "state"), now, path)
    return fresh.read_history(spark, path)


@q("WIN-19", f"""
  WITH d AS (SELECT event_type AS table_name, date_trunc('hour', ts) AS data_date FROM events GROUP BY 1, 2),
  g AS (SELECT table_name, round(epoch(data_date - lag(data_date) OVER (PARTITION BY table_name ORDER BY data_date)) / 3600, 1) AS gap FROM d)
  SELECT table_name, count(*) AS observations, {r('median(gap)')} AS median_hours, {r('min(gap)')} AS min_hours, {r('max(gap)')} AS max_hours FROM g GROUP BY 1""")
def real_frequency(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("table_name"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("data_date"))
    return fresh.real_frequency(e)


CADENCE = """CASE WHEN abs(g - 1) <= least(abs(g - 7), abs(g - 15), abs(g - 30), abs(g - 91)) THEN 'daily' WHEN abs(g - 7) <= least(abs(g - 15), abs(g - 30), abs(g - 91)) THEN 'weekly'
  WHEN abs(g - 15) <= least(abs(g - 30), abs(g - 91)) THEN 'fortnightly' WHEN abs(g - 30) <= abs(g - 91) THEN 'monthly' ELSE 'quarterly' END"""


@q("WIN-20", f"""
  WITH d AS (SELECT DISTINCT o_custkey AS client, CAST(o_orderdate AS DATE) AS day FROM orders),
  gaps AS (SELECT client, day - lag(day) OVER (PARTITION BY client ORDER BY day) AS gap FROM d),
  m AS (SELECT client, count(gap) + 1 AS dates, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gs FROM gaps GROUP BY 1 HAVING count(gap) >= 2),
  p AS (SELECT client, dates, CAST(gs[len(gs) // 2 + 1] AS BIGINT) AS g FROM m),
  c AS (SELECT *, {CADENCE} AS near FROM p)
  SELECT client, dates, g AS median_gap,
         CASE WHEN abs(g - d) <= d THEN near END AS cadence, CAST(CASE WHEN abs(g - d) <= d THEN t END AS BIGINT) AS tolerance_days
  FROM c JOIN (VALUES ('daily', 1, 3), ('weekly', 7, 10), ('fortnightly', 15, 20), ('monthly', 30, 40), ('quarterly', 91, 115)) v(name, d, t) ON near = name""")
def inferred_cadence(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("client"), "o_orderdate")
    return fresh.infer_cadence(o, "o_orderdate", ("client",))


@q("FRS-04", """
  SELECT 'orders' AS table_name, count(*) AS rows, max(o_orderdate)::DATE AS data_date, DATE '2001-08-04' - max(o_orderdate)::DATE AS days, 'daily' AS cadence,
         CASE WHEN DATE '2001-08-04' - max(o_orderdate)::DATE <= 3 THEN 'up_to_date' ELSE 'late' END AS state, true AS worst FROM orders
  UNION ALL SELECT 'lineitem', count(*), max(l_shipdate)::DATE, DATE '2001-08-04' - max(l_shipdate)::DATE, 'daily', 'up_to_date', false FROM lineitem
  UNION ALL SELECT 'part', count(*), NULL, NULL, NULL, 'no_date', false FROM part""")
def freshness_by_rhythm(spark, sf):
    tables = {"orders": (table(spark, sf, "orders"), "o_orderdate"), "lineitem": (table(spark, sf, "lineitem"), "l_shipdate"), "part": (table(spark, sf, "part"), None)}
    return fresh.freshness_inferred(tables, AS_OF)
