"""Conformance of landed tables: one pure DataFrame step per operation.

The declared order is rename, types, decode, dates, filter, dedup, unpivot,
derive, drop; later steps see the result of earlier ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reasons import ARRIVAL
from ..functions.scalars import NUMBER_TEXT, is_true, number_of, number_text


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Lossy casts by declared kind; columns that are absent are ignored."""
    kinds = dict(df.dtypes)
    numbers = [n for n, k in types.items() if k == "decimal" and kinds.get(n) == "string"]
    df = numbers_from_text(df, numbers)
    out = {}
    for name, kind in types.items():
        if name not in kinds or name in numbers:
            continue
        c, text = F.col(name), kinds[name] == "string"
        if kind == "integer":
            number = c.try_cast("double")
            out[name] = F.when(number == F.floor(number), number).try_cast("long") if text else c.try_cast("long")
        elif kind == "decimal":
            out[name] = c.try_cast("double")
        elif kind == "date":
            out[name] = c.try_cast("timestamp_ntz")
        elif kind == "boolean":
            out[name] = is_true(c)
        elif kind == "text":
            out[name] = c.cast("string")
        else:
            raise ValueError(f"unknown type {kind!r} for column {name!r}")
    return df.withColumns(out) if out else df


def numbers_from_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text columns to doubles in two projections, so each text is cleaned once."""
    if not names:
        return df
    cleaned = df.withColumns({n: number_text(n) for n in names})
    return cleaned.withColumns({n: number_of(F.col(n)) for n in names})


def text_votes(df: DataFrame) -> dict[str, dict]:
    """Per text column: share of number-like and date-like values, in one pass."""
    texts = [n for n, t in df.dtypes if t == "string"]
    if not texts:
        return {}
    exprs = []
    for i, name in enumerate(texts):
        t = F.trim(F.col(name))
        filled = F.length(t) > 0
        exprs += [
            F.count_if(filled).alias(f"n{i}"),
            F.avg(F.when(filled, t.rlike(NUMBER_TEXT).cast("int"))).alias(f"num{i}"),
            F.avg(F.when(filled, t.try_cast("timestamp_ntz").isNotNull().cast("int"))).alias(f"date{i}"),
            F.percentile_approx(F.when(filled, F.length(t)), 0.5).alias(f"len{i}"),
        ]
    row = df.agg(*exprs).first()
    return {
        name: {
            "values": row[f"n{i}"],
            "number_share": row[f"num{i}"] or 0.0,
            "date_share": row[f"date{i}"] or 0.0,
            "median_length": row[f"len{i}"] or 0,
        }
        for i, name in enumerate(texts)
    }


def infer_types(df: DataFrame) -> DataFrame:
    """Retype text columns that hold numbers or dates (over 95 % of values).

    The vote reads the whole column in one aggregation rather than a head
    sample, so a late run of text cannot be lost in a numeric column.
    """
    out, numbers = {}, []
    for name, vote in text_votes(df).items():
        if not vote["values"]:
            continue
        if vote["number_share"] > 0.95:
            numbers.append(name)
        elif vote["date_share"] > 0.95 and vote["median_length"] >= 8:
            out[name] = F.trim(F.col(name)).try_cast("timestamp_ntz")
    df = numbers_from_text(df, numbers)
    return df.withColumns(out) if out else df


# The text forms each strict type accepts.
STRICT_FORMS = (
    ("date", r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})([ T]\d{1,2}:\d{2}(:\d{2})?)?$"),
    ("integer", r"^-?\d+$"),
    ("number", r"^-?\d+([.,]\d+)?$"),
    ("boolean", r"(?i)^(true|false|si|sí|no|verdadero|falso)$"),
)


def strict_types(df: DataFrame) -> DataFrame:
    """One row per column with the narrowest type that fits EVERY value."""
    per_column = []
    for name in df.columns:
        t = F.trim(F.col(name).cast("string"))
        filled = F.length(t) > 0
        verdict = F.lit("string")
        for kind, form in reversed(STRICT_FORMS):
            fits = F.coalesce(F.bool_and(F.when(filled, t.rlike(form))), F.lit(False))
            verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
        per_column.append(
            F.struct(
                F.lit(name).alias("column_name"),
                verdict.alias("type"),
                F.count_if(filled).alias("filled"),
            )
        )
    return df.agg(F.array(*per_column).alias("c")).select(F.inline("c"))


def resolve_day_month(df: DataFrame, column: str) -> DataFrame:
    """Whole-column vote on which part of `a/b/yyyy` is the day."""
    form = r"^(\d{1,2})[/-](\d{1,2})[/-]\d{2,4}"
    t = F.trim(F.col(column))
    hit = t.rlike(form)
    day = F.coalesce(F.bool_or(F.when(hit, F.regexp_extract(t, form, 1).try_cast("int") > 12)), F.lit(False))
    month = F.coalesce(F.bool_or(F.when(hit, F.regexp_extract(t, form, 2).try_cast("int") > 12)), F.lit(False))
    return df.agg(day.alias("d"), month.alias("m"), F.count_if(hit).alias("values")).select(
        F.lit(column).alias("column_name"),
        F.when(F.col("m") & ~F.col("d"), F.lit("month")).otherwise(F.lit("day")).alias("first_part"),
        (~F.col("m") & ~F.col("d") & (F.col("values") > 0)).alias("ambiguous"),
        "values",
    )


def count_unconvertible(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Per declared column: values that do not fit the type, one example each."""
    targets = {"integer": "long", "decimal": "double", "date": "timestamp_ntz", "boolean": "boolean"}
    rows = []
    for name, kind in types.items():
        c = F.col(name).cast("string")
        bad = c.isNotNull() & (F.length(F.trim(c)) > 0) & c.try_cast(targets[kind]).isNull()
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("type"),
                F.count_if(bad).alias("unconvertible"),
                F.min(F.when(bad, c)).alias("example"),
            )
        )
    return df.agg(F.array(*rows).alias("c")).select(F.inline("c"))


def decode(df: DataFrame, column: str, codes: Mapping, otherwise: str = "Unknown") -> DataFrame:
    """Replace codes by labels; unmatched values, nulls too, take `otherwise`."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind in ("double", "float"):
        text = F.when(c == F.floor(c), c.try_cast("long").cast("string")).otherwise(c.cast("string"))
    else:
        text = c.cast("string")
    labels = {str(k): v for k, v in codes.items()}
    lookup = df.sparkSession.createDataFrame(list(labels.items()), "__code string, __label string")
    return (
        df.withColumn("__code", text)
        .join(lookup, "__code", "left")
        .withColumn(column, F.coalesce("__label", F.lit(otherwise)))
        .drop("__code", "__label")
        .select(*df.columns)
    )


def to_date(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    out = {c: F.col(c).try_cast("timestamp_ntz") for c in columns if kinds.get(c) == "string"}
    return df.withColumns(out) if out else df


def keep(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(F.expr(condition))


def dedup(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last arrival per key by `order`; absent keys are ignored.

    Keeping a maximum per key combines map-side, so a key holding much of the
    table never gathers in one task.  With no usable key the whole row is it.
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        keys = [c for c in df.columns if c != order]
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order]))
    return df.groupBy(*keys).agg(packed.alias("__row")).select(
        *[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns]
    )


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None,
            variable: str = "variable", value: str = "value") -> DataFrame:
    columns = list(columns or [c for c in df.columns if c not in ids])
    return df.unpivot(list(ids), columns, variable, value)


def unpivot_labelled(df: DataFrame, ids: Sequence[str], labels: Mapping[str, str],
                     variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long with the column name replaced by its label."""
    renamed = df.select(*ids, *[F.col(c).alias(label) for c, label in labels.items()])
    return renamed.unpivot(list(ids), list(labels.values()), variable, value)


def unpivot_groups(df: DataFrame, ids: Sequence[str], period: str,
                   groups: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Several measure groups over shared periods: one row per id and period."""
    periods = list(next(iter(groups.values())))
    rows = [
        F.struct(
            F.lit(p).alias(period),
            *[F.col(columns[p]).alias(measure) for measure, columns in groups.items()],
        )
        for p in periods
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def derive(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Named SQL expressions, each seeing the columns derived before it."""
    for name, expression in expressions.items():
        df = df.withColumn(name, F.expr(expression))
    return df


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def conform(df: DataFrame, spec: Mapping | None, order: str | None = None) -> DataFrame:
    """All declared steps of one table in their fixed order.

    Dedup keeps the last arrival: by the declared `order`, else by the arrival
    column of a landed table (`read_bronze(..., with_arrival=True)`), which goes after it.
    """
    spec = spec or {}
    order = spec.get("order", order) or (ARRIVAL if ARRIVAL in df.columns else None)
    if spec.get("rename"):
        df = rename(df, spec["rename"])
    types = spec.get("types", "auto")
    df = cast(df, types) if isinstance(types, Mapping) else infer_types(df)
    for column, codes in (spec.get("decode") or {}).items():
        if column in df.columns:
            codes = dict(codes)
            other = codes.pop("_other", "Unknown")
            df = decode(df, column, codes, other)
    dates = spec.get("dates") or []
    df = to_date(df, dates)
    if spec.get("filter"):
        df = keep(df, spec["filter"])
    if spec.get("dedup") is not None:
        keys = [c for c in spec["dedup"] if c in df.columns]
        if not keys:
            df = df.drop(ARRIVAL).distinct() if order in (None, ARRIVAL) else dedup(df, keys, order)
        elif order is None:
            raise ValueError("dedup by key needs an `order` column: Spark keeps no arrival order")
        else:
            df = dedup(df, keys, order)
    df = df.drop(ARRIVAL)
    if spec.get("unpivot"):
        u = dict(spec["unpivot"])
        if "groups" in u:
            df = unpivot_groups(df, u["ids"], u.get("period", "period"), u["groups"])
        elif "labels" in u:
            df = unpivot_labelled(df, u.get("ids", []), u["labels"], u.get("variable", "variable"), u.get("value", "value"))
        else:
            df = unpivot(df, u.get("ids", []), u.get("columns"), u.get("variable", "variable"), u.get("value", "value"))
        df = to_date(df, dates)
    df = derive(df, spec.get("derive") or {})
    return drop(df, spec.get("drop") or [])
