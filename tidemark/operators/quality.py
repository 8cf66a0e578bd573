"""Declared quality rules, their score and the gate that stops a load.

Row-level rules of one table share one aggregation.  Only uniqueness and
reference rules shuffle, and both count per value first, so one hot value
crosses the network as one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reasons import reason
from ..functions.scalars import to_number

# The six quality dimensions and each rule's default one.
DIMENSIONS = ["completeness", "uniqueness", "validity", "consistency", "accuracy", "timeliness"]
DEFAULT_DIMENSION = {
    "not_null": "completeness",
    "unique": "uniqueness",
    "range": "validity",
    "allowed": "validity",
    "regex": "validity",
    "positive": "validity",
    "non_negative": "validity",
    "rows_min": "completeness",
    "rows_exact": "completeness",
    "reference": "consistency",
    "fresh": "timeliness",
    "expression": "accuracy",
}
TABLE_RULES = {"rows_min", "rows_exact", "expression"}
NO_DATE_DAYS = 1_000_000
RESULT = "rule string, table_name string, column_name string, dimension string, passed boolean, failing bigint, critical boolean, detail string"


def _label(rule: Mapping) -> str:
    tail = f".{rule['column']}" if rule.get("column") else ""
    return f"{rule['type']}:{rule['table']}{tail}"


def _row(rule: Mapping, passed, failing, detail):
    return F.struct(
        F.lit(_label(rule)).alias("rule"),
        F.lit(rule["table"]).alias("table_name"),
        F.lit(rule.get("column", "")).alias("column_name"),
        F.lit(rule.get("dimension") or DEFAULT_DIMENSION.get(rule["type"], "validity")).alias("dimension"),
        passed.alias("passed"),
        failing.cast("long").alias("failing"),
        F.lit(bool(rule.get("critical", True))).alias("critical"),
        F.lit(detail).alias("detail"),
    )


def _count_if(condition):
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _single_pass(rule: Mapping, df: DataFrame, as_of: date | None):
    """(passed, measured) aggregates of one row-level rule."""
    kind, name = rule["type"], rule.get("column")
    c = F.col(name) if name else None
    if kind == "not_null":
        missing = c.isNull()
        if dict(df.dtypes)[name] in ("double", "float"):
            missing = missing | F.isnan(c)
        n = F.count_if(missing)
        return n == 0, n
    if kind == "range":
        v = to_number(c, dict(df.dtypes)[name])
        low, high = rule.get("min"), rule.get("max")
        out = F.lit(False)
        if low is not None:
            out = out | (v < float(low))
        if high is not None:
            out = out | (v > float(high))
        n = _count_if(out)
        return n == 0, n
    if kind == "allowed":
        n = _count_if(~c.cast("string").isin([str(x) for x in rule["values"]]))
        return n == 0, n
    if kind == "regex":
        n = _count_if(~c.cast("string").rlike("^(?:" + rule["pattern"] + ")"))
        return n == 0, n
    if kind in ("positive", "non_negative"):
        v = to_number(c, dict(df.dtypes)[name])
        n = _count_if(v <= 0 if kind == "positive" else v < 0)
        return n == 0, n
    if kind in ("rows_min", "rows_exact"):
        n = F.count(F.lit(1))
        wanted = int(rule["value"])
        return (n >= wanted if kind == "rows_min" else n == wanted), n
    if kind == "fresh":
        if as_of is None:
            raise ValueError("a `fresh` rule needs an explicit as_of date")
        d = F.max(c.try_cast("date"))
        days = F.coalesce(F.datediff(F.lit(as_of).cast("date"), d), F.lit(NO_DATE_DAYS))
        return days <= int(rule.get("days", 1)), days
    if kind == "expression":
        n = F.count_if(~F.coalesce(F.expr(rule["expression"]), F.lit(False)))
        return n == 0, n
    raise KeyError(kind)


def _unique(rule: Mapping, df: DataFrame) -> DataFrame:
    per_value = df.groupBy(F.col(rule["column"]).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return per_value.agg(extra.alias("n")).select(
        F.inline(F.array(_row(rule, F.col("n") == 0, F.col("n"), "repeated values")))
    )


def _reference(rule: Mapping, df: DataFrame, target: DataFrame, target_column: str) -> DataFrame:
    per_value = (
        df.where(F.col(rule["column"]).isNotNull())
        .groupBy(F.col(rule["column"]).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = target.select(F.col(target_column).alias("k")).where("k is not null").distinct()
    lost = per_value.join(known, F.col("v") == F.col("k"), "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.inline(F.array(_row(rule, F.col("n") == 0, F.col("n"), f"orphans against {rule['to']}")))
    )


def _failed(spark: SparkSession, rule: Mapping, why: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(_row(rule, F.lit(False), F.lit(None).cast("long"), why))))


def evaluate_rules(spark: SparkSession, tables: Mapping[str, DataFrame], rules: Sequence[Mapping],
                   as_of: date | None = None) -> DataFrame:
    """One result row per rule; a missing table or column is a failed rule."""
    parts: list[DataFrame] = []
    single: dict[str, list] = {}
    for rule in rules:
        kind, table, column = rule["type"], rule["table"], rule.get("column")
        df = tables.get(table)
        if df is None:
            parts.append(_failed(spark, rule, f"table {table} does not exist"))
        elif kind not in DEFAULT_DIMENSION:
            parts.append(_failed(spark, rule, f"unknown rule type {kind}"))
        elif kind not in TABLE_RULES and column not in df.columns:
            parts.append(_failed(spark, rule, f"column {column} does not exist"))
        elif kind == "unique":
            parts.append(_unique(rule, df))
        elif kind == "reference":
            other, other_column = rule["to"].split(".", 1)
            target = tables.get(other)
            if target is None or other_column not in target.columns:
                parts.append(_failed(spark, rule, f"reference {rule['to']} does not exist"))
            else:
                parts.append(_reference(rule, df, target, other_column))
        elif kind == "expression" and (why := _expression_error(df, rule["expression"])):
            parts.append(_failed(spark, rule, f"invalid expression: {why}"))
        else:
            passed, measured = _single_pass(rule, df, as_of)
            single.setdefault(table, []).append(_row(rule, passed, measured, kind))
    for table, rows in single.items():
        parts.append(tables[table].agg(F.array(*rows).alias("r")).select(F.inline("r")))
    if not parts:
        return spark.createDataFrame([], RESULT)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _expression_error(df: DataFrame, expression: str) -> str | None:
    try:
        kind = df.select(F.expr(expression)).schema[0].dataType.simpleString()
    except (AnalysisException, ParseException) as error:
        return reason(error)
    return None if kind == "boolean" else f"{kind} is not boolean"


def auto_rules(tables: Mapping[str, DataFrame], declared: Sequence[Mapping] = ()) -> list[dict]:
    """Always watched: every table has rows, no column is entirely empty.

    A declared rule on the same table, type and column suppresses its twin.
    """
    taken = {(r["table"], r["type"], r.get("column")) for r in declared}
    out = []
    for name, df in tables.items():
        out.append({"table": name, "type": "rows_min", "value": 1, "critical": True, "dimension": "completeness"})
        filled = df.agg(*[F.count(c).alias(str(i)) for i, c in enumerate(df.columns)]).first()
        for i, column in enumerate(df.columns):
            if filled[i] == 0:
                out.append({"table": name, "column": column, "type": "not_null",
                            "critical": False, "dimension": "completeness"})
    return [r for r in out if (r["table"], r["type"], r.get("column")) not in taken]


def score(results: DataFrame) -> DataFrame:
    """Pass rate per dimension plus the total, null where nothing was declared."""
    spark = results.sparkSession
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, [*DIMENSIONS, "TOTAL"]))).alias("dimension"))
    measured = (
        results.select(F.explode(F.array("dimension", F.lit("TOTAL"))).alias("dimension"), "passed")
        .groupBy("dimension")
        .agg(
            F.count(F.lit(1)).alias("rules"),
            F.count_if("passed").alias("ok"),
            F.round(F.avg(F.col("passed").cast("int")) * 100, 1).alias("score"),
        )
    )
    return names.join(measured, "dimension", "left").select(
        "dimension",
        F.coalesce("rules", F.lit(0)).alias("rules"),
        F.coalesce("ok", F.lit(0)).alias("ok"),
        "score",
    )


class GateClosed(RuntimeError):
    """Raised by `require_gate`: the next layer must not be written."""


def gate(results: DataFrame, minimum: float | None = None, minimum_cuts: bool = True,
         critical_cuts: bool = True) -> DataFrame:
    """One decision row: does the load go on, and what holds it back."""
    total = F.count(F.lit(1))
    points = F.when(total > 0, F.round(F.count_if("passed") * 100.0 / total, 1)).otherwise(100.0)
    broken = F.count_if(F.col("critical") & ~F.col("passed"))
    below = (points < float(minimum)) if minimum is not None else F.lit(False)
    return results.agg(
        total.alias("rules"),
        points.alias("score"),
        broken.alias("critical_failed"),
        below.alias("below_minimum"),
        (~((F.lit(critical_cuts) & (broken > 0)) | (F.lit(minimum_cuts) & below))).alias("passed"),
    )


def require_gate(results: DataFrame, **kwargs) -> dict:
    row = gate(results, **kwargs).first().asDict()
    if not row["passed"]:
        raise GateClosed(f"quality gate closed: {row}")
    return row
