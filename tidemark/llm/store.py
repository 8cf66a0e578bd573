"""Intermediate tables in the shared folder of the session, and connected components over them."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scale

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; only a session of one machine (tests) may leave that unset."""
    return scale.shared_folder(spark)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, each finished execution frees its shuffle files; tables carry what is needed on."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage ends here and survives
    the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    schema = df.schema
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge; edges are (a, b) longs.

    Alternating large-star and small-star steps: each step groups by node and
    links neighbours to a minimum, so the number of rounds is logarithmic and
    no task holds more than aggregates.  Every round is a written table.
    Nulls and loops are ignored; an empty table gives an empty result.
    """
    now = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = written(small.where("a != b").distinct(), "small")
        # every step lowers labels; equal counts and sums twice running mean a fixed point
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark or not seen.n:
            break
        mark = seen
    star = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return written(star.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "components")
