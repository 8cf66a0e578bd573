"""Landing, layers, warehouse and publication."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reasons import ARRIVAL, reason
from .readers import mask_url

def arrival(df: DataFrame) -> Column:
    """The place a row arrived at, whatever task reads it.

    Rows of files order by (file, block, row): the row number inside the file where
    the format knows it, else the row's place in its block's one task.  Rows that come
    from elsewhere have only the order in which Spark numbers them.
    """
    numbered = F.monotonically_increasing_id()
    for place in (
        ("_metadata.file_path", F.lit(0).cast("long"), F.col("_metadata.row_index")),
        ("_metadata.file_path", F.col("_metadata.file_block_start"), numbered),
    ):
        try:
            df.select(F.col(place[0]), *place[1:])
        except AnalysisException:
            continue
        return F.struct(F.col(place[0]).alias("file"), place[1].alias("block"), place[2].alias("row"))
    return F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), numbered.alias("row"))


def stamp(df: DataFrame, source: str, loaded_at: datetime, content_hash: str = "") -> DataFrame:
    """Lineage columns and an arrival order; nested values travel as text."""
    place = arrival(df)
    flat = {
        n: F.to_json(n) for n, t in df.dtypes if t.startswith(("array", "map", "struct"))
    }
    return df.withColumns(
        flat
        | {
            "_source": F.lit(source),
            "_loaded_at": F.lit(loaded_at.strftime("%Y-%m-%dT%H:%M:%S+00:00")),
            "_source_hash": F.lit(content_hash),
            ARRIVAL: place,
        }
    )


def layer_path(root: str, layer: str, name: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{name}"


def write_bronze(df: DataFrame, root: str, name: str, source: str, loaded_at: datetime, content_hash: str = "") -> str:
    """As-landed copy, the whole table replaced: landing twice changes nothing."""
    path = layer_path(root, "bronze", name)
    stamp(df, source, loaded_at, content_hash).write.mode("overwrite").parquet(path)
    return path


def hide_lineage(df: DataFrame) -> DataFrame:
    return df.select([c for c in df.columns if not c.startswith("_")])


def read_bronze(spark: SparkSession, root: str, name: str, with_arrival: bool = False) -> DataFrame:
    """A landed table; `with_arrival` hands on the order that `conform` needs to keep the last arrival."""
    landed = spark.read.parquet(layer_path(root, "bronze", name))
    return landed.select(*hide_lineage(landed).columns, *([ARRIVAL] if with_arrival else []))


def bronze_metadata(df: DataFrame) -> DataFrame:
    """Source, load time and hash of a landed table; only those columns are read."""
    return df.agg(
        F.max("_source").alias("source"), F.max("_loaded_at").alias("loaded_at"), F.max("_source_hash").alias("source_hash")
    )


def _files(spark: SparkSession, path: str):
    """(Hadoop's Path class, the file system of a path)."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind, kind(path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the published versions of a layer table, oldest first."""
    kind, fs = _files(spark, path)
    marks = kind(f"{path}/_published")
    return sorted(f.getPath().getName() for f in fs.listStatus(marks)) if fs.exists(marks) else []


def read_layer(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    """The version of a layer table that was published last."""
    path = layer_path(root, layer, name)
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no published version")
    return spark.read.parquet(f"{path}/versions/{found[-1]}")


def write_layer(df: DataFrame, root: str, layer: str, name: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """Replace a layer table without a moment in which it is missing; returns the new version's folder.

    A version is a folder of its own, written whole before an empty file of its
    name in `_published` makes it the current one.  That file is a single created
    object, so nothing is renamed, copied or overwritten on any store.  Readers that
    opened the version before go on reading it; versions older than the last `keep` go.
    `df` may read the table it replaces.
    """
    spark = df.sparkSession
    path = layer_path(root, layer, name)
    kind, fs = _files(spark, path)
    before = versions(spark, path)
    version = f"{int(before[-1].split('-')[0]) + 1 if before else 1:08d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/versions/{version}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(folder)
    fs.create(kind(f"{path}/_published/{version}"), False).close()
    for old in before[: max(0, len(before) + 1 - max(1, keep))]:
        fs.delete(kind(f"{path}/_published/{old}"), False)
        fs.delete(kind(f"{path}/versions/{old}"), True)
    return folder


def load_warehouse(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = "gold", location: str | None = None) -> DataFrame:
    """Create or replace each table and count it as the warehouse sees it; a new schema may lie at `location`."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}" + (f" LOCATION '{location}'" if location else ""))
    parts = []
    for name, df in tables.items():
        df.write.mode("overwrite").format("parquet").saveAsTable(f"{schema}.{name}")
        parts.append(spark.table(f"{schema}.{name}").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def register_views(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Register tables as session views and report their row counts."""
    parts = []
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
        parts.append(df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class ViewsFailed(RuntimeError):
    """At least one declared view does not run."""


def create_views(spark: SparkSession, views: Mapping[str, str]) -> dict[str, str | None]:
    """Create every view and probe it; failures are collected, not fatal."""
    outcome: dict[str, str | None] = {}
    for name, sql in views.items():
        try:
            spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {sql}")
            spark.table(name).limit(1).collect()
            outcome[name] = None
        except PySparkException as error:
            outcome[name] = reason(error)
    return outcome


def require_views(outcome: Mapping[str, str | None]) -> None:
    broken = {n: e for n, e in outcome.items() if e}
    if broken:
        raise ViewsFailed(f"views that failed: {broken}")


def publish_jdbc(tables: Mapping[str, DataFrame], url: str, schema: str | None = None, batch: int = 5000, **options) -> dict[str, str]:
    """Replace tables in a relational engine, one by one, in batches.

    An existing table is truncated rather than dropped, so grants survive.
    """
    done = {}
    for name, df in tables.items():
        target = f"{schema}.{name}" if schema else name
        try:
            df.write.format("jdbc").mode("overwrite").options(
                url=url, dbtable=target, truncate=True, batchsize=batch, **options
            ).save()
        except Exception as error:
            raise ConnectionError(f"{target}: {mask_url(str(error))}") from None
        done[target] = mask_url(url)
    return done


def export_csv(tables: Mapping[str, DataFrame], root: str, max_rows: int | None = None) -> dict[str, str]:
    """Tables as headed CSV folders; `max_rows` is the demonstration variant."""
    out = {}
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        chosen = df.limit(max_rows) if max_rows else df
        chosen.write.mode("overwrite").option("header", True).csv(path)
        out[name] = path
    return out
