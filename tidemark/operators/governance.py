"""Catalogue of columns and the scores read from it."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import column_counts

# Column names that point at a person.
PII_NAMES = re.compile(
    r"(dni|cuit|cuil|cpf|ssn|documento|email|mail|telefono|tel[eé]fono|phone|celular|direccion|"
    r"address|nombre|apellido|name|surname|tarjeta|card)", re.I
)


def is_key_name(column: str) -> bool:
    return column.endswith("_key") or column.startswith("id_") or column.lower() == "id"


def catalog(layers: Mapping[str, Mapping[str, DataFrame]], descriptions: Mapping[str, str] | None = None,
            pii: list[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: type, null share, distinct values, key and PII flags; one scan a table.

    Exact distinct counts group all columns of a table by (column, value) at
    once; `exact=False` sketches them, the choice for wide scans.
    """
    descriptions, declared = dict(descriptions or {}), set(pii or [])
    frames = []
    for layer, tables in layers.items():
        for table, df in tables.items():
            rows = []
            for i, (column, kind) in enumerate(df.dtypes):
                label = descriptions.get(f"{table}.{column}", descriptions.get(column, ""))
                flagged = column in declared or f"{table}.{column}" in declared or bool(PII_NAMES.search(column))
                fixed = {
                    "c": i, "layer": layer, "table_name": table, "column_name": column, "type": kind,
                    "is_key": is_key_name(column), "pii": flagged, "description": label,
                }
                rows.append(F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()]))
            listed = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
            frames.append(listed.join(counts(df, exact), "c", "left").select(
                "layer", "table_name", "column_name", "type", "null_pct",
                F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "is_key", "pii", "description",
            ))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def counts(df: DataFrame, exact: bool) -> DataFrame:
    """(c, null_pct, distinct_values) of every column."""
    if exact:
        return column_counts(df, df.columns).groupBy("c").agg(
            (F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("null_pct"),
            F.count("v").alias("distinct_values"),
        )
    rows = [
        F.struct(
            F.lit(i).alias("c"), (F.avg(F.col(c).isNull().cast("int")) * 100).alias("null_pct"),
            F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(
                F.xxhash64(F.col(c).cast("string")) if kind.startswith(("map", "variant")) else F.when(F.col(c).isNotNull(), F.xxhash64(c)), F.lit(12),
            )), F.lit(0)).alias("distinct_values"),
        )
        for i, (c, kind) in enumerate(df.dtypes)
    ]
    return df.agg(F.array(*rows).alias("c")).select(F.inline("c"))


def governance_scores(entries: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Share documented, PII columns, tables, and the quality total if given."""
    out = entries.agg(
        (F.avg((F.col("description") != "").cast("int")) * 100).alias("documented_pct"),
        F.count_if("pii").alias("pii_columns"),
        F.countDistinct("layer", "table_name").alias("tables"),
        F.lit(1).alias("one"),
    )
    if quality is not None:
        total = quality.where("dimension = 'TOTAL'").select("score", F.lit(1).alias("one"))
        out = out.join(F.broadcast(total), "one", "left").withColumnRenamed("score", "quality_score")
    return out.drop("one")
