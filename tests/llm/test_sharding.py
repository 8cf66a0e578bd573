"""Histogram sort against its SQL twin, a plain sort, and the awkward rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import registry, sharding

SF = "/root/testdata/sf0.001"
AWKWARD = [(1, None), (None, None), (None, None), (2, ""), (2, ""), (3, "x" * 30_000), (None, "é" * 10), (4, "same"), (4, "same")]


def per_shard(df, shards):
    rows = df.groupBy("shard").agg(
        F.sum(sharding.size()).alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")
    )
    found = {r.shard: r for r in rows.collect()}
    assert set(found) <= set(range(shards)) and all(r.d == r.n == r.m + 1 for r in found.values())
    return [found[s].b if s in found else 0 for s in range(shards)]


def test_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.execute(sharding.DIGESTS_SQL).fetchall()
    got = registry.op13_sharding(spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def plain_cuts(rows, shards, tolerance):
    """Rows below each splitter, from a sort of all rows."""
    total, out, at = sum(r[2] for r in rows), [], 0
    edges, groups = [0], [0]
    for i, (h, _, size) in enumerate(rows):
        at += size
        edges.append(at)
        if i + 1 == len(rows) or rows[i + 1][0] != h:
            groups.append(at)
    for i in range(1, shards):
        def near(places):
            return min(places, key=lambda p: (abs(p * shards - total * i), p))  # noqa: B023
        whole = near(groups)
        out.append(whole if abs(whole * shards - total * i) <= tolerance * total else near(edges))
    return out


@pytest.mark.parametrize("shards,tolerance,piece", [(16, 0.001, 1 << 25), (5, 0.3, 2000), (3, 0.0, 50)])
def test_splitters_are_the_nearest_boundaries(spark, shards, tolerance, piece):
    rows = [(i, f"text {i % 37} " + "w" * (i * 7919 % 400)) for i in range(300)] + [(i, "copy " * 40) for i in range(1000, 1150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = docs.select(sharding.digest(F.col("text")), sharding.digest(F.col("doc_id").cast("string")), sharding.size())
    want = plain_cuts(sorted(map(tuple, keyed.collect())), shards, tolerance)
    got = per_shard(sharding.shard_sorted(docs, shards, tolerance, piece), shards)
    assert [sum(got[:i]) for i in range(1, shards)] == want


def test_small_groups_stay_whole(spark):
    rows = [(i, f"t{i // 10} " * 20) for i in range(4000)]
    placed = sharding.shard_sorted(spark.createDataFrame(rows, "doc_id long, text string"), 4, tolerance=0.05)
    assert placed.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in AWKWARD * 3], "doc_id long, text string, shard int, key int, piece int")
    placed = sharding.shard_sorted(docs, 4, piece_bytes=100)
    assert placed.columns == ["doc_id", "text", "key", "piece", "shard", "slot"]
    per_shard(placed, 4)
    key = lambda r: (r[0] or -1, r[1] or "")
    assert sorted((tuple(r) for r in placed.select("doc_id", "text").collect()), key=key) == sorted(AWKWARD * 3, key=key)
    digest = {(r.doc_id, r.size): r.text_crc32 for r in sharding.digests(docs).collect()}
    assert digest[1, 1] == digest[2, 1] == 0


def test_one_group_fills_the_table(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("again " * 50).alias("text"))
    assert max(per_shard(sharding.shard_sorted(rows, 8, piece_bytes=4000), 8)) <= 301 * 251
    same = spark.range(999).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert per_shard(sharding.shard_sorted(same, 3, piece_bytes=20), 3) == [333, 333, 333]


def test_empty(spark):
    assert sharding.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
