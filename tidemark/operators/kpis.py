"""KPIs, control totals and concentration.

All KPIs of one table are fused into one aggregation: a dashboard of twenty
numbers reads each table once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.reasons import reason
from ..functions.scalars import format_number, safe_div
from ..functions.scale import column_counts, with_totals
from .profiling import is_numeric

PLAIN = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def measure(aggregation: str, column: str | None = None, where: str | None = None, approx: bool = False) -> Column:
    """One aggregate expression, optionally over the rows that meet a filter."""
    if aggregation == "count":
        return F.count_if(F.expr(where)) if where else F.count(F.lit(1))
    value = F.when(F.expr(where), F.col(column)) if where else F.col(column)
    if aggregation == "count_distinct":
        return F.approx_count_distinct(value) if approx else F.countDistinct(value)
    return PLAIN[aggregation](value)


def _part(spec: Mapping) -> Column:
    return measure(spec.get("aggregation", "sum"), spec.get("column"), spec.get("filter"))


def kpi_values(tables: Mapping[str, DataFrame], kpis: Sequence[Mapping]) -> DataFrame:
    """One row (name, value, text, ok, error) per KPI, one job per table.

    A KPI that does not analyse is reported in its row and costs the others
    nothing; ratios across tables join two one-row aggregates.
    """
    spark = next(iter(tables.values())).sparkSession
    fused: dict[str, list] = {}
    parts: list[DataFrame] = []
    for k in kpis:
        name, mask = k["name"], k.get("format")
        try:
            if k.get("type") == "sql":
                one = spark.sql(k["sql"])
                value = one.select(F.col(one.columns[0]).cast("double").alias("v"))
                parts.append(value.select(F.inline(F.array(_kpi_row(name, F.col("v"), mask)))))
            elif k.get("type") == "ratio":
                n, d = k["numerator"], k["denominator"]
                if n["table"] == d["table"]:
                    value = safe_div(_part(n), _part(d))
                    _check(tables, n["table"], value)
                    fused.setdefault(n["table"], []).append(_kpi_row(name, value, mask))
                else:
                    _check(tables, n["table"], _part(n))
                    _check(tables, d["table"], _part(d))
                    top = tables[n["table"]].agg(_part(n).alias("n"), F.lit(1).alias("one"))
                    bottom = tables[d["table"]].agg(_part(d).alias("d"), F.lit(1).alias("one"))
                    value = top.join(bottom, "one").select(safe_div("n", "d").alias("v"))
                    parts.append(value.select(F.inline(F.array(_kpi_row(name, F.col("v"), mask)))))
            else:
                value = _part(k).cast("double")
                _check(tables, k["table"], value)
                fused.setdefault(k["table"], []).append(_kpi_row(name, value, mask))
        except (AnalysisException, KeyError) as error:
            why = reason(error)
            parts.append(
                spark.range(1).select(
                    F.lit(name).alias("name"), F.lit(None).cast("double").alias("value"),
                    F.lit("—").alias("text"), F.lit(False).alias("ok"), F.lit(why).alias("error"),
                )
            )
    for table, rows in fused.items():
        parts.append(tables[table].agg(F.array(*rows).alias("k")).select(F.inline("k")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _check(tables, table, value):
    tables[table].agg(value.alias("v")).schema  # analysis only, no job


def _kpi_row(name: str, value: Column, mask: str | None) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        value.cast("double").alias("value"),
        format_number(value, mask or "#,0").alias("text"),
        F.lit(True).alias("ok"),
        F.lit(None).cast("string").alias("error"),
    )


def kpi_by(df: DataFrame, by: str, value: Column, k: int = 12) -> DataFrame:
    """A KPI by one column, best first; the k best are the report."""
    return df.groupBy(by).agg(value.alias("value")).orderBy(F.desc_nulls_last("value"), by).limit(k)


def kpi_by_attribute(fact: DataFrame, dim: DataFrame, key: str, attribute: str, column: str, k: int = 12) -> DataFrame:
    """Sum by a dimension attribute: facts shrink to one row per key first."""
    per_key = fact.groupBy(key).agg(F.sum(column).alias("__v"))
    joined = per_key.join(dim.select(key, attribute), key)
    return (
        joined.groupBy(attribute).agg(F.sum("__v").alias("value"))
        .orderBy(F.desc_nulls_last("value"), attribute)
        .limit(k)
    )


def monthly_series(fact: DataFrame, calendar: DataFrame, column: str, key: str = "date_key") -> DataFrame:
    per_day = fact.groupBy(key).agg(F.sum(column).alias("__v"))
    return (
        per_day.join(calendar.select(key, "year_month"), key)
        .groupBy("year_month")
        .agg(F.sum("__v").alias("value"))
    )


def auto_kpis(tables: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Default dashboard: rows per non-dimension table, sums of its measures.

    Numeric non-key columns with more than two distinct values are measures
    (the sketch is exact for so few); `limit` cuts for display.
    """
    parts = []
    for name, df in tables.items():
        if name.startswith("dim_"):
            continue
        rows = [F.struct(F.lit(f"{name} rows").alias("name"), F.count(F.lit(1)).cast("double").alias("value"), F.lit(3).cast("bigint").alias("spread"))]
        for column, kind in df.dtypes:
            if is_numeric(kind) and not column.lower().endswith("key"):
                rows.append(
                    F.struct(
                        F.lit(f"{name}.{column} total").alias("name"),
                        F.sum(F.col(column).cast("double")).alias("value"),
                        F.approx_count_distinct(column).alias("spread"),
                    )
                )
        parts.append(df.agg(F.array(*rows).alias("k")).select(F.posexplode("k").alias("at", "k"), F.lit(len(parts)).alias("table_at")).select("table_at", "at", "k.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    kept = out.where("spread > 2").orderBy("table_at", "at")
    return (kept if limit is None else kept.limit(limit)).select("name", "value")


def margin(df: DataFrame, amount: str, cost: str, by: Sequence[str] = ()) -> DataFrame:
    gross = F.sum(amount) - F.sum(cost)
    return df.groupBy(*by).agg(gross.alias("margin"), safe_div(gross, F.sum(amount)).alias("margin_pct"))


def uniques_per_dimension(fact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct members of each dimension that occur in the fact.

    Each key is de-duplicated on its own, so no row is expanded per key.
    """
    parts = [
        fact.select(F.col(k).cast("string").alias("m")).where("m is not null").distinct()
        .agg(F.count(F.lit(1)).alias("members"))
        .select(F.lit(k).alias("dimension"), "members")
        for k in keys
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sum_product(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(F.col(a) * F.col(b)).alias("value"))


def average_ticket(df: DataFrame, amount: str, operation: str, by: Sequence[str] = ()) -> DataFrame:
    """Amount per distinct operation, which is not the mean of the lines."""
    per_operation = df.groupBy(*by, operation).agg(F.sum(amount).alias("__a"))
    return per_operation.groupBy(*by).agg(
        F.count(operation).alias("operations"),
        safe_div(F.sum("__a"), F.count(operation)).alias("ticket"),
    )


def filtered_kpi(df: DataFrame, by: str, column: str, condition: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.sum(column).alias("value"), measure("sum", column, condition).alias("filtered_value")
    )


def pct_of_total(df: DataFrame, by: str, column: str, selection: str | None = None) -> DataFrame:
    """Member share of the grand total and, with a selection, of its total."""
    grouped = df.groupBy(by).agg(F.sum(column).alias("value"))
    inside = F.when(F.expr(selection), F.col("value")) if selection else F.lit(None).cast("double")
    out = with_totals(grouped, __all=F.sum("value"), __inside=F.sum(inside))
    out = out.withColumn("share", safe_div("value", "__all"))
    if selection:
        out = out.withColumn("share_of_selection", safe_div(inside, "__inside"))
    return out.drop("__all", "__inside")


def ratio_vs_total_pp(df: DataFrame, by: str, numerator: Column, denominator: Column) -> DataFrame:
    """Points between a member's ratio and the ratio of the totals."""
    grouped = df.groupBy(by).agg(numerator.alias("n"), denominator.alias("d"))
    ratio = safe_div("n", "d")
    return with_totals(grouped, __total=safe_div(F.sum("n"), F.sum("d"))).select(
        by, ratio.alias("ratio"), ((ratio - F.col("__total")) * 100).alias("vs_total_pp")
    )


def which(df: DataFrame, label: str, column: str) -> DataFrame:
    """The top member; one row for each that ties for it."""
    grouped = df.groupBy(F.col(label).cast("string").alias("l")).agg(F.sum(column).alias("v"))
    best = grouped.agg(F.max("v").alias("b"))
    return grouped.join(F.broadcast(best), F.col("v") == F.col("b")).select(F.col("l").alias("winner"), F.col("v").alias("value"))


def control_totals(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Sum, mean, filled and rows per measure over raw data, one scan."""
    rows = []
    for c in columns:
        v = F.col(c).try_cast("double")
        rows.append(
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.sum(v).alias("sum"),
                F.avg(v).alias("mean"),
                F.count(v).alias("filled"),
                F.count(F.lit(1)).alias("rows"),
            )
        )
    return df.agg(F.array(*rows).alias("c")).select(F.inline("c"))


def twin_measures(totals: DataFrame, name: str, value: str) -> DataFrame:
    """Groups of measures whose non-zero values agree at six decimals."""
    return (
        totals.where(F.col(value) != 0)
        .groupBy(F.round(value, 6).alias("value"))
        .agg(F.sort_array(F.collect_list(name)).alias("names"))
        .where(F.size("names") > 1)
        .select("value", F.array_join("names", ", ").alias("names"), F.size("names").cast("bigint").alias("twins"))
    )


def concentration(df: DataFrame, member: str, column: str, top: int = 10) -> DataFrame:
    """The top members, the share of each and their running share.

    Amounts without a member are kept apart in `unassigned`.
    """
    v = F.col(column).try_cast("double")
    key = F.trim(F.col(member).cast("string"))
    blank = key.isNull() | (key == "")
    grouped = df.groupBy(F.when(~blank, key).alias("member")).agg(F.sum(v).alias("value"))
    totals = grouped.agg(
        F.sum(F.when(F.col("member").isNotNull(), F.col("value"))).alias("total"),
        F.coalesce(F.sum(F.when(F.col("member").isNull(), F.col("value"))), F.lit(0.0)).alias("unassigned"),
        F.count("member").alias("members"),
        F.lit(1).alias("one"),
    )
    best = grouped.where("member is not null and value is not null").orderBy(F.desc("value"), "member").limit(top)
    order = Window.orderBy(F.desc("value"), "member")  # at most `top` rows
    return (
        best.withColumns(
            {
                "position": F.row_number().over(order).cast("bigint"),
                "running": F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                "one": F.lit(1),
            }
        )
        .join(F.broadcast(totals), "one")
        .select(
            "position", "member", "value",
            safe_div("value", "total").alias("share"),
            safe_div("running", "total").alias("running_share"),
            "members", "unassigned",
        )
    )


def best_cut(df: DataFrame, dimensions: Sequence[str], measures: Sequence[str], used: Sequence[str] = ()) -> DataFrame:
    """The (dimension, measure) most worth a Pareto: a used measure with the
    biggest sum, a dimension of at least eight members (fewest first).  Members are
    counted exactly, all dimensions in one aggregation."""
    row = df.agg(*[F.sum(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(measures)]).first()
    members = column_counts(df, dimensions).groupBy("c").agg(F.count("v").alias("n")).collect()
    wide = [(r.n, dimensions[r.c]) for r in members if r.n >= 8]
    ranked = sorted(
        ((c in used, row[f"m{i}"] or 0.0, c) for i, c in enumerate(measures)), reverse=True
    )
    picked = [(min(wide)[1], ranked[0][2], float(ranked[0][1]))] if wide and ranked else []
    return df.sparkSession.createDataFrame(picked, "dimension string, measure string, total double")


def cross_facts(dim: DataFrame, key: str, label: str,
                facts: Mapping[str, tuple[DataFrame, str, Sequence[str]]], top: int | None = 12) -> DataFrame:
    """Per group of a dimension: members, and each fact's total and mean each.

    `top` is for display; `misalignment` judges the table of all groups (None).

    A fact is (table, foreign key, candidate measures); its measure is the
    candidate with the largest sum.  Facts are summed to the key, then to the
    group, and only those aggregates meet: facts never join facts.
    """
    side = dim.select(F.col(key).alias("__k"), F.col(label).cast("string").alias("member_group"))
    out = side.groupBy("member_group").agg(F.count(F.lit(1)).alias("members"))
    names = []
    for name, (df, foreign, candidates) in facts.items():
        sums = df.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in candidates]).first()
        column = max(candidates, key=lambda c: sums[c] or 0.0)
        per_key = df.groupBy(F.col(foreign).alias("__k")).agg(F.sum(column).alias("__v"))
        per_group = (
            per_key.join(side, "__k").groupBy("member_group").agg(F.sum("__v").alias(f"{name}_total"))
        )
        out = out.join(per_group, "member_group", "left").withColumn(
            f"{name}_total", F.coalesce(f"{name}_total", F.lit(0.0))
        ).withColumn(f"{name}_each", safe_div(f"{name}_total", "members"))
        names.append(name)
    weight = sum((F.col(f"{n}_total") for n in names), F.lit(0.0))
    return out if top is None else out.orderBy(weight.desc(), "member_group").limit(top)


def misalignment(cross: DataFrame, facts: Sequence[str], minimum_spread: float = 1.5) -> DataFrame:
    """Is effort spent where it does not return?

    The fact that varies most between groups is the result, the others are
    effort.  An effort is flagged when the worst group gets at least as much
    per member as the best one.
    """
    spreads = cross.agg(
        F.array(
            *[
                F.struct(
                    safe_div(
                        F.max(F.when(F.col(f"{n}_each") > 0, F.col(f"{n}_each"))),
                        F.min(F.when(F.col(f"{n}_each") > 0, F.col(f"{n}_each"))),
                    ).alias("spread"),
                    F.lit(n).alias("result"),
                    F.max_by("member_group", F.struct(f"{n}_each", "member_group")).alias("best"),
                    F.min_by("member_group", F.struct(f"{n}_each", "member_group")).alias("worst"),
                    F.array(
                        *[
                            F.struct(
                                F.lit(o).alias("effort"),
                                F.max_by(f"{o}_each", F.struct(f"{n}_each", "member_group")).alias("in_best"),
                                F.min_by(f"{o}_each", F.struct(f"{n}_each", "member_group")).alias("in_worst"),
                            )
                            for o in facts
                            if o != n
                        ]
                    ).alias("efforts"),
                )
                for n in facts
            ]
        ).alias("all")
    )
    top = spreads.select(F.array_max("all").alias("r")).select("r.*")
    return top.where(F.col("spread") >= minimum_spread).select(
        "result", "spread", "best", "worst", F.inline("efforts")
    ).withColumn("misaligned", F.col("in_worst") >= F.col("in_best"))


def strategy_summary(scores: DataFrame, by: str, probability: str, expected: str) -> DataFrame:
    return scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("clients"),
        F.avg(probability).alias("mean_probability"),
        F.sum(expected).alias("expected_value"),
    )


def column_stats(df: DataFrame, name: str, samples: int = 3, display: int | None = None) -> DataFrame:
    """Per column: distinct, blanks and a few sample values (the smallest), whole unless `display` cuts what is shown.

    All columns are unpivoted in one scan to (column, value, rows); counts and
    samples read the same shuffled rows, and the samples of a column are
    picked inside the tasks before they meet.
    """
    shown = lambda v: v if display is None else F.substring(v, 1, display)
    values = column_counts(df, df.columns)
    blank = F.col("v").isNull() | (F.trim(F.col("v")) == "")
    counts = values.groupBy("c").agg(
        F.sum("n").alias("rows"),
        F.count("v").alias("distinct_values"),
        F.coalesce(F.sum(F.when(blank, F.col("n"))), F.lit(0)).alias("blanks"),
    )
    # every count is above 0; naming it keeps the rows those that `counts` reads, so that Spark shuffles them once
    filled = values.where(F.when(F.col("n") > 0, ~blank))
    firsts = filled.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy("v"))).where(F.col("place") <= samples)
    firsts = firsts.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list("v")), shown), " | ").alias("samples"))
    listed = df.sparkSession.range(1).select(F.posexplode(F.lit(df.columns)).alias("c", "column_name"))
    out = listed.join(counts, "c", "left").join(firsts, "c", "left").select(
        F.lit(name).alias("table_name"), "column_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "distinct_values", "blanks")],
        F.coalesce("samples", F.lit("")).alias("samples"),
    )
    place = Window.orderBy(F.desc("distinct_values"), "column_name")  # one row per column
    return out.withColumn("cardinality_rank", F.row_number().over(place).cast("bigint"))


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Ad-hoc SELECT over the registered views and tables."""
    return spark.sql(sql)
