from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, model, profiling, quality


def results(spark, tables, rules, as_of=None):
    return {(r.rule, r.column_name): (r.passed, r.failing) for r in quality.evaluate_rules(spark, tables, rules, as_of).collect()}


def test_rules_on_a_small_frame(spark):
    t = spark.createDataFrame([(1, 30, "a1"), (1, 200, "b"), (2, 40, None), (None, 5, "a2"), (None, 6, "a")], "id int, age int, code string")
    got = results(spark, {"t": t}, [
        {"table": "t", "column": "id", "type": "unique"}, {"table": "t", "column": "age", "type": "range", "min": 0, "max": 120},
        {"table": "t", "column": "code", "type": "regex", "pattern": "a"}, {"table": "t", "column": "nope", "type": "not_null"},
        {"table": "gone", "column": "x", "type": "not_null"}, {"table": "t", "type": "expression", "expression": "age * 2 > 100 or id = 1"},
    ])
    assert got[("unique:t.id", "id")] == (False, 2)  # a repeated null counts as a duplicate
    assert got[("range:t.age", "age")] == (False, 1)
    assert got[("regex:t.code", "code")] == (False, 1)  # anchored at the start, nulls apart
    assert got[("not_null:t.nope", "nope")] == (False, None)
    assert got[("not_null:gone.x", "x")] == (False, None)
    assert got[("expression:t", "")] == (False, 3)


def test_orphans_and_nan(spark):
    a = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,), (float("nan"),)], "k double")
    b = spark.createDataFrame([(1.0,), (2.0,), (None,)], "k double")
    got = results(spark, {"a": a, "b": b}, [{"table": "a", "column": "k", "type": "reference", "to": "b.k"}, {"table": "a", "column": "k", "type": "not_null"}])
    assert got[("reference:a.k", "k")] == (False, 2)
    assert got[("not_null:a.k", "k")] == (False, 2)


def test_gate(spark):
    t = spark.createDataFrame([(1,), (2,), (-3,), (-4,)], "x int")
    rules = [{"table": "t", "column": "x", "type": "positive", "critical": False}, {"table": "t", "type": "rows_min", "value": 2}]
    r = quality.evaluate_rules(spark, {"t": t}, rules)
    assert quality.require_gate(r)["score"] == 50.0
    with pytest.raises(quality.GateClosed):
        quality.require_gate(r, minimum=90)
    assert quality.require_gate(r, minimum=90, minimum_cuts=False)["below_minimum"]
    critical = quality.evaluate_rules(spark, {"t": t}, [{**rules[0], "critical": True}])
    with pytest.raises(quality.GateClosed):
        quality.require_gate(critical)


def test_null_and_empty_are_different_attributes(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id int, zone string")
    a, b = [r[0] for r in df.select(model.attr_hash(["zone"])).collect()]
    assert a != b


def test_scd2_history(spark):
    def at(rows, day, before=None):
        df = spark.createDataFrame(rows, "id int, cap double")
        return model.dimension_scd2(df, "id", day, before)

    one = at([(1, 10.0), (2, None)], date(2024, 1, 1))
    again = at([(1, 10.0), (2, None)], date(2024, 1, 2), one)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, one.collect()))
    two = at([(1, 11.0), (3, 5.0)], date(2024, 2, 1), one)
    rows = {(r.id, r.version): (r.dim_key, r.cap, r.valid_to, r.is_current) for r in two.collect()}
    far = date(9999, 12, 31)
    assert rows == {
        (1, 1): (1, 10.0, date(2024, 2, 1), False), (1, 2): (2, 11.0, far, True), (2, 1): (3, None, far, True), (3, 1): (4, 5.0, far, True),
    }
    back = at([(1, 10.0)], date(2024, 3, 1), two)
    assert back.where("id = 1 and is_current").first().version == 3
    assert back.groupBy("id").agg(F.count_if("is_current").alias("n")).where("n <> 1").isEmpty()


def test_history_starts_over_without_history_columns(spark):
    df = spark.createDataFrame([(1, "a")], "id int, z string")
    old = model.dimension_scd1(df, "id")
    assert model.dimension_scd2(df, "id", date(2024, 1, 1), old).first().version == 1


def test_fact_keeps_rows_and_checks_the_key(spark):
    clients = spark.createDataFrame([(1, "a"), (2, "b")], "id int, n string")
    dim = model.dimension_scd1(clients, "id", surrogate="client_key")
    pay = spark.createDataFrame([(1, "2024-01-05", 5.0), (9, None, 6.0), (None, "2024-01-06", 7.0)], "id int, f string, m double")
    got = model.fact(pay, {"id": (dim, "id", "client_key")}, "f")
    assert got.columns == ["client_key", "date_key", "m"]
    assert sorted(map(str, got.collect())) == sorted(map(str, [
        type(got.first())(client_key=1, date_key=20240105, m=5.0), type(got.first())(client_key=None, date_key=0, m=6.0),
        type(got.first())(client_key=None, date_key=20240106, m=7.0)]))
    with pytest.raises(joins.NotUnique):
        model.fact(pay, {"id": (dim.union(dim), "id", "client_key")}, "f")


def test_drill_levels():
    assert model.drill_levels(["year", "month", "quarter"]) == ["year", "quarter", "month"]
    assert model.drill_levels(["city", "brand", "region", "category"]) == ["region", "category", "brand"]


def test_relations_need_values_not_names(spark):
    one = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "client_id int, label string")
    good = spark.createDataFrame([(i % 20, float(i)) for i in range(60)], "client_id int, v double")
    bad = spark.createDataFrame([(i + 100, i) for i in range(60)], "client_id int, w int").union(spark.createDataFrame([(100, 1)], "client_id int, w int"))
    got = [(r.from_table, r.to_table) for r in profiling.infer_relations({"client": one, "pay": good, "other": bad}).where("kind = 'many_to_one'").collect()]
    assert ("pay", "client") in got and ("other", "client") not in got


def test_composite_key(spark):
    df = spark.createDataFrame([(d, s, 1.0) for d in ("a", "b", "c") for s in ("x", "y")], "d string, s string, v double")
    assert profiling.candidate_key(df) == ["d", "s"]
    assert profiling.candidate_key(df, ["s", "d"]) == ["s", "d"]
    assert profiling.candidate_key(df.union(df)) is None
