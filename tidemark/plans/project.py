"""Declared projects: a plain dict (or YAML file) that only calls operators."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..operators import model, quality, silver
from ..sources import readers, workbooks

# What each block of a declaration may say.
SOURCE_TYPES = ("csv", "excel", "parquet", "json", "folder", "jdbc", "sqlite", "duckdb")
RULE_TYPES = tuple(quality.DEFAULT_DIMENSION)
AGGREGATIONS = ("sum", "avg", "min", "max", "count", "count_distinct")
BLOCKS = ("name", "sources", "silver", "quality", "model", "views", "kpis", "governance", "freshness", "ml", "campaigns")


def load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def problems(spec: Mapping) -> list[str]:
    """Everything wrong with a declaration, before any row is read."""
    out = [f"unknown block {k!r}" for k in spec if k not in BLOCKS]
    names = []
    for s in spec.get("sources", []):
        names.append(s.get("name"))
        if not s.get("name"):
            out.append("a source has no name")
        if s.get("type") not in SOURCE_TYPES:
            out.append(f"source {s.get('name')}: unknown type {s.get('type')!r}")
    out += [f"source {n} declared twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
    out += [f"silver.{t} has no source" for t in spec.get("silver", {}) if t not in names]
    for r in (spec.get("quality") or {}).get("rules", []):
        if r.get("type") not in RULE_TYPES:
            out.append(f"rule on {r.get('table')}: unknown type {r.get('type')!r}")
    dims = [d["name"] for d in (spec.get("model") or {}).get("dimensions", [])]
    for f in (spec.get("model") or {}).get("facts", []):
        out += [f"fact {f['name']}: unknown dimension {d}" for d in (f.get("keys") or {}).values() if d not in dims]
    for k in spec.get("kpis", []):
        if k.get("type", "aggregation") == "aggregation" and k.get("aggregation", "sum") not in AGGREGATIONS:
            out.append(f"kpi {k.get('name')}: unknown aggregation {k.get('aggregation')!r}")
    return out


def read_source(spark: SparkSession, s: Mapping, base: str | None = None) -> DataFrame:
    """One declared source; a `row_limit` means the same for every type."""
    options = dict(s.get("options") or {})
    kind = s["type"]
    path = readers.resolve(s["path"], base) if s.get("path") else None
    if kind == "csv":
        df = readers.read_csv(spark, path, **options)
    elif kind == "excel":
        df = workbooks.read_excel(spark, path, s.get("sheet", 0))
    elif kind == "parquet":
        df = readers.read_parquet(spark, path)
    elif kind == "json":
        df = readers.read_json(spark, path, **options)
    elif kind == "folder":
        df = readers.read_folder(spark, path, s.get("pattern", "*.parquet"), **options)
    elif kind == "jdbc":
        df = readers.read_jdbc(spark, s["url"], s.get("query"), s.get("table"), **options)
    else:
        df = readers.read_embedded(spark, path, s.get("table", s["name"]), s.get("query"), kind)
    df = readers.clean_headers(df)
    if s.get("row_limit"):
        df = readers.limit_rows(df, int(s["row_limit"]))
    return readers.require_non_empty(df, s["name"])


def conform_all(tables: Mapping[str, DataFrame], spec: Mapping, order: str | None = None) -> dict[str, DataFrame]:
    return {n: silver.conform(df, (spec.get("silver") or {}).get(n), order) for n, df in tables.items()}


def check(spark: SparkSession, tables: Mapping[str, DataFrame], spec: Mapping, as_of: date | None = None) -> DataFrame:
    declared = list((spec.get("quality") or {}).get("rules", []))
    rules = [*declared, *quality.auto_rules(tables, declared)]
    return quality.evaluate_rules(spark, tables, rules, as_of)


def build_model(spark: SparkSession, tables: Mapping[str, DataFrame], spec: Mapping, as_of: date,
                previous: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Dimensions, calendar and facts as declared; plain copies when nothing is."""
    declared = spec.get("model") or {}
    previous = previous or {}
    gold: dict[str, DataFrame] = {}
    natural = {}
    for d in declared.get("dimensions", []):
        source, name = tables[d["from"]], d["name"]
        surrogate = f"{name}_key"
        natural[name] = d["key"]
        if int(d.get("scd", 1)) == 2:
            gold[name] = model.dimension_scd2(source, d["key"], as_of, previous.get(name), d.get("attributes"), d.get("order"), surrogate)
        else:
            gold[name] = model.dimension_scd1(source, d["key"], d.get("attributes"), d.get("order"), surrogate)
    cal = declared.get("calendar", "auto")
    if cal == "auto":
        span = model.date_range(list(tables.values()))
        ml = spec.get("ml") or {}
        if span and ml.get("type") == "series":
            span = model.extend_range(span, ml.get("frequency", "monthly"), int(ml.get("horizon", 3)), spark)
    else:
        span = (cal["from"], cal["to"]) if cal else None
    if span:
        gold["dim_calendar"] = model.calendar(spark, *span)
    for f in declared.get("facts", []):
        keys = {c: (gold[d], natural[d], f"{d}_key") for c, d in (f.get("keys") or {}).items()}
        gold[f["name"]] = model.fact(tables[f["from"]], keys, f.get("date"))
    if not declared.get("dimensions") and not declared.get("facts"):
        gold.update({f"tbl_{n}": model.passthrough(df) for n, df in tables.items()})
    return gold
