import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import silver


@pytest.mark.parametrize("text, number", [
    ("$ 1.234,50", 1234.5), ("2.000,00", 2000.0), ("15", 15.0), ("1,234.5", 1234.5), ("1,234", 1234.0), ("1,23", 1.23),
    ("1,234,567", 1234567.0), ("-7,5", -7.5), (" 12 000 ", 12000.0), ("s/d", None), ("", None), (None, None), ("1.5d", None),
    ("NaN", None), ("1.234.567,8", 1234567.8),
])
def test_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(scalars.parse_number("t")).first()[0] == number
    assert silver.cast(df, {"t": "decimal"}).first().t == number


def test_inference_reads_whole_columns(spark):
    rows = [(f"{i}.000,{i % 100:02d}", f"2024-01-{i % 28 + 1:02d}", "x", str(i)) for i in range(1, 101)]
    df = silver.infer_types(spark.createDataFrame(rows, "money string, day string, word string, code string"))
    assert dict(df.dtypes) == {"money": "double", "day": "timestamp_ntz", "word": "string", "code": "double"}
    late = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id").cast("string")).otherwise("n/a").alias("c"))
    assert dict(silver.infer_types(late).dtypes)["c"] == "string"


def test_declared_steps_in_order(spark):
    df = spark.createDataFrame([(1, 1, 10.0, 1), (2, 0, 20.0, 2), (1, 2, 30.0, 3)], "id int, sex int, x double, n int")
    out = silver.conform(
        df, {"types": {}, "decode": {"sex": {1: "M", 2: "F"}}, "dedup": ["id"], "derive": {"y": "x * 2"}, "drop": ["n"]}, order="n"
    )
    assert sorted(map(tuple, out.collect())) == [(1, "F", 30.0, 60.0), (2, "Unknown", 20.0, 40.0)]


def test_dedup_without_order_is_refused(spark):
    with pytest.raises(ValueError):
        silver.conform(spark.range(3), {"types": {}, "dedup": ["id"]})


def test_group_unpivot(spark):
    df = spark.createDataFrame([(7, 1, 2, 10, 20)], "id int, p1 int, p2 int, m1 int, m2 int")
    out = silver.unpivot_groups(df, ["id"], "month", {"paid": {"apr": "p1", "may": "p2"}, "amount": {"apr": "m1", "may": "m2"}})
    assert sorted(map(tuple, out.collect())) == [(7, "apr", 1, 10), (7, "may", 2, 20)]


def test_unpivoted_labels_become_dates(spark):
    df = spark.createDataFrame([(1, 5.0, 6.0)], "id int, a double, b double")
    out = silver.conform(df, {"types": {}, "dates": ["month"], "unpivot": {"ids": ["id"], "labels": {"a": "2024-01-01", "b": "2024-02-01"}, "variable": "month"}})
    assert dict(out.dtypes)["month"] == "timestamp_ntz" and out.count() == 2


def test_decode_joins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "c double")
    assert [r.c for r in silver.decode(df, "c", {1: "a", 2: "b"}).orderBy("c").collect()] == ["Unknown", "a", "b"]


def test_keys_to_dates(spark):
    df = spark.createDataFrame([("20240131",), ("0",), ("20241350",), ("2024-02-03",), ("x",)], "k string")
    got = [str(r[0]) for r in df.select(scalars.date_from_key("k")).collect()]
    assert got == ["2024-01-31", "None", "None", "2024-02-03", "None"]


@pytest.mark.parametrize("value, mask, text", [
    (1234567.891, "#,0.00", "1.234.567,89"), (0.1234, "#,0.0 %", "12,3 %"), (None, "#,0", "—"), (12.0, "#,0", "12"), (0.5, "0%", "50 %"),
])
def test_number_format(spark, value, mask, text):
    assert spark.createDataFrame([(value,)], "v double").select(scalars.format_number("v", mask)).first()[0] == text
