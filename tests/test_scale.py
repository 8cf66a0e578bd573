"""The distributed ranks and quantiles must equal the plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scale
from tidemark.operators import model


@pytest.fixture
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        v = 7.0 if rng.random() < 0.4 else round(rng.gauss(0, 5), 2)
        rows.append((i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", None if rng.random() < 0.03 else v, f"s{rng.randrange(400):03d}"))
    return spark.createDataFrame(rows, "id bigint, k string, v double, s string").repartition(6)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("order", ["v", "s"])
def test_ranks_built_in_pieces(skewed, keys, order, descending):
    direction = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    span = Window.partitionBy(*keys)
    plain = skewed.select(
        "id", F.row_number().over(span.orderBy(direction, "id")).cast("long").alias("position"),
        F.count(F.lit(1)).over(span).alias("group_rows"),
    )
    ours = scale.ordered_rank(skewed, order, "id", keys, descending).select("id", "position", "group_rows")
    assert sorted(ours.collect()) == sorted(plain.collect())


def test_no_piece_holds_a_hot_value(spark, skewed):
    """40 % of the rows share one value and half of them one key; pieces must still stay small."""
    for order in ([F.col("v"), F.col("id")], [F.col("k"), F.col("v"), F.col("id")]):
        with_pieces = scale.sorted_pieces(skewed, order)
        sizes = [r["count"] for r in with_pieces.groupBy("__piece").count().collect()]
        assert len(sizes) == 1 or max(sizes) < 1000


def test_versions_of_many_keys(spark):
    """History of 30,000 keys, half of which change: surrogates stay dense in (key, version) order."""
    import datetime as dt

    keys = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit("a").alias("x"))
    first = model.dimension_scd2(keys, "key", dt.date(2024, 1, 1))
    changed = keys.withColumn("x", F.when(F.crc32("key") % 2 == 0, "b").otherwise("a"))
    second = model.dimension_scd2(changed, "key", dt.date(2024, 2, 1), previous=first)
    rows = second.select("dim_key", "key", "version").collect()
    assert 44_000 < len(rows) < 46_000
    assert [r.dim_key for r in sorted(rows, key=lambda r: (r.key, r.version))] == list(range(1, len(rows) + 1))


def test_quantiles(spark):
    values = np.round(np.random.default_rng(1).normal(size=501), 2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = scale.exact_quantiles(df, "v", (0.2, 0.37, 0.8))
    assert np.allclose(got, np.quantile(values, (0.2, 0.37, 0.8)))


@pytest.mark.parametrize("n", [1, 2, 10, 23, 100, 101])
def test_deciles_follow_the_edges(spark, n):
    df = spark.range(n).withColumn("p", -F.col("id").cast("double"))
    got = [r.decile for r in scale.deciles(df, "p", "id").orderBy("p").collect()]
    edges = np.quantile(np.arange(1, n + 1), np.arange(1, 10) / 10)
    assert got == [1 + int((edges < i - 1e-9).sum()) for i in range(1, n + 1)]


def test_quintile_rules(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (None,)], "v double")
    got = df.select(scale.quintile(F.col("v"), [2.0]).alias("q"), scale.quintile(F.col("v"), [2.0], invert=True).alias("i")).collect()
    assert [tuple(r) for r in got] == [(1, 2), (1, 2), (2, 1), (1, 1)]


def test_cluster_without_a_shared_folder_is_refused(spark):
    assert scale.shared_folder(spark) != scale.shared_folder(spark)

    class Elsewhere:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda *a: None)}), type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        scale.shared_folder(Elsewhere())


def test_totals_need_no_window(spark):
    df = scale.with_totals(spark.range(5), total=F.sum("id"))
    assert {r.total for r in df.collect()} == {10}
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_grouped_quantiles_match_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.random(), float(rng.randint(0, 3))]), rng.randint(-5, 5)) for _ in range(700)]
    rows += [("c", None, 1), ("d", 2.0, 7)]
    df = spark.createDataFrame(rows, "g string, x double, y int").repartition(6)
    got = {r.g: r for r in scale.quantiles(df, ["x", "y"], [0.1, 0.5, 0.83], ["g"]).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        for i, name in ((1, "x"), (2, "y")):
            values = [row[i] for row in rows if row[0] == g and row[i] is not None]
            assert (r[name] is None) == (not values)
            assert not values or r[name] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.83])))
    assert scale.quantiles(df.limit(0), ["x"], [0.5], ["g"]).collect() == []
    assert scale.exact_quantiles(df.limit(0), "x", [0.5]) == []
    assert scale.cut_points(df, "x", "y")["y"] == sorted(set(np.quantile([r[2] for r in rows], [0.2, 0.4, 0.6, 0.8])))


def test_running_sums_cross_pieces(spark):
    rows = [(k, i, (i * 7) % 5) for k in ("a", None) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(5)
    got = {(r.k, r.i): (r.s, r.t) for r in scale.running_sums(df, {"s": "v", "t": "i"}, [F.col("i")], ["k"]).collect()}
    for k in ("a", None):
        s = t = 0
        for i in range(500):
            s, t = s + (i * 7) % 5, t + i
            assert got[k, i] == (s, t)


def test_stored_history_writes_only_what_changed(spark, tmp_path):
    from datetime import date

    path = str(tmp_path / "dim")
    first = spark.createDataFrame([(i, f"n{i % 5}") for i in range(200)] + [(None, "x")], "k int, name string")

    def files():
        return {f.relative_to(path): f.stat().st_mtime_ns for f in (tmp_path / "dim").rglob("*.parquet")}

    def rows():
        return {(r.k, r.version): r for r in spark.read.parquet(path).collect()}

    out = model.merge_scd2(first, path, "k", date(2024, 1, 1))
    assert out.count() == 201 and [r.dim_key for r in out.orderBy("dim_key").collect()] == list(range(1, 202))
    before, had = files(), rows()
    assert model.merge_scd2(first, path, "k", date(2024, 2, 1)).count() == 201 and files() == before
    second = first.where("k is null or k <> 7").withColumn("name", F.when(F.col("k") == 3, "new").when(F.col("k").isNull(), "y").otherwise(F.col("name")))
    second = second.union(spark.createDataFrame([(500, "z")], first.schema))
    model.merge_scd2(second, path, "k", date(2024, 3, 1))
    now, touched = rows(), {str(p).split("/")[0] for p in set(files().items()) ^ set(before.items()) for p in [p[0]]}
    assert len(touched) <= 3 and len(now) == 204
    assert all(now[k].dim_key == r.dim_key for k, r in had.items())
    assert sorted(r.dim_key for r in now.values()) == list(range(1, 205))
    assert (now[3, 1].is_current, now[3, 1].valid_to, now[3, 2].name, now[3, 2].is_current) == (False, date(2024, 3, 1), "new", True)
    assert now[7, 1].is_current and now[None, 2].name == "y" and not now[None, 1].is_current
    plain = model.dimension_scd2(second, "k", date(2024, 3, 1), model.dimension_scd2(first, "k", date(2024, 1, 1)))
    shown = ["k", "name", "valid_from", "valid_to", "is_current", "version"]
    a, b = plain.where("k is not null").select(shown), spark.read.parquet(path).where("k is not null").select(shown)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    from tidemark.functions.scale import exact_sum

    values = [0.1, 1e9, 0.2, 0.3, -1e9, 0.7]
    got = {
        spark.createDataFrame([(v,) for v in some], "v double").coalesce(1).agg(exact_sum("v").alias("s")).first().s
        for some in (values, values[::-1], sorted(values))
    }
    assert got == {1.3}
