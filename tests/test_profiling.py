"""Inclusions, keys and column profiles against plain versions, and how many jobs and scans they take."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import governance, kpis, profiling


def jobs(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(tracker.getJobIdsForGroup(group))


def test_inclusions_match_sets(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(6)]), rng.choice(["a", "b", None, ""]), Decimal(rng.randint(0, 8)), rng.randint(0, 3) * 1.0) for _ in range(80)]
    a = spark.createDataFrame(rows, "i int, s string, d decimal(9,2), f double")
    b = spark.createDataFrame([(r[0], r[1], "2020-01-01") for r in rows[:20]], "i bigint, s string, t string")
    got = {(r.from_table, r.from_column, r.to_table, r.to_column): r for r in profiling.inclusions({"a": a, "b": b}).collect()}
    cells = {("a", c): [r[k] for r in rows] for k, c in enumerate("isdf")} | {("b", "i"): [r[0] for r in rows[:20]], ("b", "s"): [r[1] for r in rows[:20]]}
    for x, left in cells.items():
        for y, right in cells.items():
            there, have = {v for v in right if v is not None}, [v for v in left if v is not None]
            found = {v for v in have if v in there}
            r = got.get((*x, *y))
            if r is None:
                assert not found
                continue
            assert (r.rows, r.filled, r["values"], r.found, r.found_rows) == (
                len(left), len(have), len(set(have)), len(found), sum(v in there for v in have))
            assert r.most == max(map(have.count, have))


def test_inclusions_of_dates_and_empty_tables(spark):
    days = spark.sql("SELECT DATE '2024-05-01' AS d, TIMESTAMP_NTZ '2024-05-01 00:00:00' AS t, array(1) AS nested")
    got = profiling.inclusions({"x": days}).where("from_column <> to_column").collect()
    assert {(r.from_column, r.to_column, r.found) for r in got} == {("d", "t", 1), ("t", "d", 1)}
    assert profiling.inclusions({"x": days.limit(0)}).collect() == []
    assert profiling.infer_relations({"x": days.limit(0), "y": days}).collect() == []


def test_relations_take_one_job_however_many_pairs(spark):
    one = spark.range(50).select(F.col("id").alias("a_key"), (F.col("id") % 3).alias("b_key"), F.col("id").alias("c_key"))
    many = spark.range(200).select(*[(F.col("id") % 50).alias(c) for c in ("a_key", "b_key", "c_key")], F.col("id").alias("row_id"))
    tables = {f"t{i}": many for i in range(4)} | {f"u{i}": one for i in range(4)}
    found, n = jobs(spark, lambda: profiling.infer_relations(tables))
    assert found.where("kind = 'many_to_one'").count() == 16 + 6  # t to u, and b_key of one u to another
    _, few = jobs(spark, lambda: profiling.infer_relations({"t0": many, "u0": one}))
    assert n <= few + 2  # AQE may run a small side as a job of its own


def test_key_search(spark):
    rows = [(a, b, c, d, e, "x") for a in range(2) for b in range(3) for c in range(2) for d in range(3) for e in range(2)]
    wide = spark.createDataFrame(rows, "a int, b string, c int, d int, e int, f string")
    assert profiling.candidate_key(wide) == ["a", "b", "c", "d", "e"]
    assert profiling.candidate_key(wide, exhaustive=5) == ["a", "b", "c", "d", "e"]
    assert profiling.candidate_key(wide.union(wide)) is None
    assert profiling.candidate_key(wide.where("e = 0").drop("e")) == ["a", "b", "c", "d"]
    assert profiling.candidate_key(wide.withColumn("g", F.monotonically_increasing_id())) == ["g"]
    assert profiling.candidate_key(wide.limit(0)) == ["a"]
    nulls = spark.createDataFrame([(1, None), (1, "x")], "a int, b string")
    assert profiling.candidate_key(nulls) is None
    joined = spark.createDataFrame([("a", "b,c"), ("a,b", "c"), ('a"', "b")], "s string, t string")
    assert profiling.unique_among(joined, [["s", "t"], ["s"], ["t"]]) == [True, True, True]


def test_key_search_takes_a_few_jobs_a_level(spark):
    df = spark.range(3000).select(*[(F.floor(F.col("id") / 3**k) % 3).alias(f"c{k}") for k in range(8)])
    key, n = jobs(spark, lambda: profiling.candidate_key(df))
    assert key == [f"c{k}" for k in range(8)] and n < 60  # 162 combinations up to four columns alone


def test_near_keys_are_told_from_keys(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 19_999, 0).otherwise(F.col("id")).alias("almost"), (F.col("id") % 2).alias("z"), F.col("id").alias("k"))
    assert profiling.candidate_key(df) == ["k"]
    assert profiling.candidate_key(df.drop("k")) == ["almost", "z"]


def test_near_keys_move_a_share_of_their_values(spark, monkeypatch):
    """One repeat in many rows is found whichever share holds it, and the copies of a key are not all counted."""
    df = spark.range(3000).select(F.when(F.col("id") == 2999, 7).otherwise(F.col("id")).alias("a"), *[F.col("id").alias(f"k{i}") for i in range(3)])
    asked, unique = [], profiling.unique
    monkeypatch.setattr(profiling, "unique", lambda d, combo, rows=None: asked.append(list(combo)) or unique(d, combo, rows))
    assert profiling.first_unique(df, [["a"], ["k0"], ["k1"], ["k2"]], 3000) == ["k0"]
    assert asked in ([["k0"]], [["a"], ["k0"]])
    assert profiling.repeating(df.union(df), [["a"], ["k0"]]) == [True, True]
    assert not unique(df, ["a"]) and unique(df, ["a", "k0"])


def test_no_rule_is_cut(spark):
    df = spark.range(30).select("id", *[(F.col("id") + i).alias(f"amount_{i}") for i in range(12)])
    rules = profiling.suggest_rules({"t": df}).where("rule = 'non_negative'")
    assert rules.count() == 12 and profiling.suggest_rules({"t": df}, signs=3).where("rule = 'non_negative'").count() == 3
    assert profiling.starter_rules(df, "t").where("item = 'kpi'").count() == 13
    assert profiling.starter_rules(df, "t", kpis=8).where("item = 'kpi'").count() == 8


@pytest.mark.parametrize("profile", [
    lambda df: kpis.column_stats(df, "t"), lambda df: governance.catalog({"l": {"t": df}}),
    lambda df: governance.catalog({"l": {"t": df}}, exact=False)])
def test_profiles_scan_a_table_once(spark, tmp_path, profile):
    spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("s"), (F.col("id") / 3).alias("f")).write.parquet(f"{tmp_path}/t")
    out = profile(spark.read.parquet(f"{tmp_path}/t"))
    rows = out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    reused = final.count("ReusedExchange")
    assert len(rows) == 3 and final.count("FileScan") <= 1 + reused and (reused or final.count("FileScan") == 1)


def test_profiles_of_empty_and_blank_columns(spark):
    df = spark.createDataFrame([(None, " ", -0.0), (None, "b", 0.0), (None, None, None)], "n int, s string, f double")
    stats = {r.column_name: r for r in kpis.column_stats(df, "t").collect()}
    assert (stats["n"].distinct_values, stats["n"].blanks, stats["n"].samples) == (0, 3, "")
    assert (stats["s"].distinct_values, stats["s"].blanks, stats["s"].samples) == (2, 2, "b")
    assert stats["f"].distinct_values == 1
    rows = {r.column_name: r for r in governance.catalog({"l": {"t": df.limit(0)}}).collect()}
    assert len(rows) == 3 and rows["n"].null_pct is None and rows["n"].distinct_values == 0
