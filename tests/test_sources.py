import zipfile
from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import kpis
from tidemark.plans import project
from tidemark.sources import layers, readers, workbooks


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters_and_bom(spark, tmp_path, sep):
    p = tmp_path / "t.csv"
    p.write_bytes(("﻿" + "\n".join(sep.join(r) for r in (("a", "b", "c"), ("1", "x y", "2,5" if sep == ";" else "2"), ("3", "z", "4")))).encode())
    df = readers.read_csv(spark, str(p))
    assert df.columns == ["a", "b", "c"] and df.count() == 2 and set(dict(df.dtypes).values()) == {"string"}


def test_one_column_and_explicit_delimiter(spark, tmp_path):
    p = tmp_path / "one.csv"
    p.write_text("\n\nname\nana\nluis\n")
    assert [r.name for r in readers.read_csv(spark, str(p)).collect()] == ["ana", "luis"]
    q = tmp_path / "two.csv"
    q.write_text("a;b,c,d\n1;2,3,4\n")
    assert readers.read_csv(spark, str(q), sep=";").columns == ["a", "b,c,d"]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(readers.EmptySource):
        readers.read_csv(spark, str(empty))


def test_names():
    assert readers.clean_names([" a ", "", "a", None, "a"]) == ["a", "Column2", "a (2)", "Column4", "a (3)"]


def test_json_document_and_lines(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read_json(spark, str(tmp_path / "d.json")).count() == readers.read_json(spark, str(tmp_path / "l.json"), lines=True).count() == 2


def test_folder_of_drifting_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x;y\n1;2\n")
    (tmp_path / "a.csv").write_text("y,x,z\n5,4,6\n")
    rows = readers.read_folder(spark, str(tmp_path), "*.csv", "csv").select("x", "y", "z", "_file").orderBy("_file").collect()
    assert [tuple(r) for r in rows] == [("4", "5", "6", "a.csv"), ("1", "2", None, "b.csv")]


def sheet_xml(rows):
    cells = "".join(
        f'<row r="{i}">' + "".join(
            (f'<c r="{chr(64 + j)}{i}" t="s"><v>{v[1:]}</v></c>' if isinstance(v, str) and v.startswith("@") else
             f'<c r="{chr(64 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(64 + j)}{i}"><v>{v}</v></c>')
            for j, v in enumerate(row, 1) if v is not None) + "</row>" for i, row in enumerate(rows, 1))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'


def workbook(path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Items" sheetId="1" r:id="r1"/><sheet name="Note" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>sku</t></si><si><r><t>pri</t></r><r><t>ce</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet_xml([["@0", "@1", "note"], ["a1", 2.5, None], ["a2", 3, "ok"]]))
        z.writestr("xl/worksheets/sheet2.xml", sheet_xml([["only a title"]]))


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    path = str(tmp_path / "w.xlsx")
    df = workbooks.read_excel(spark, path)
    assert df.columns == ["sku", "price", "note"]
    assert sorted(map(tuple, df.collect())) == [("a1", "2.5", None), ("a2", "3", "ok")]
    assert workbooks.read_excel(spark, path, "Items").count() == 2
    assert list(workbooks.read_workbook(spark, path)) == ["Items"]


def test_provenance_reads_all_rows_in_any_order(spark):
    a = spark.range(20_000).withColumn("x", F.col("id") * 2)
    h = lambda df: readers.provenance(df, "n", "t", "o").first()
    assert h(a).content_hash == h(a.repartition(7)).content_hash
    assert h(a).content_hash != h(a.withColumn("x", F.when(F.col("id") == 19_999, 0).otherwise(F.col("x")))).content_hash
    p = readers.provenance(a.limit(5), "n", "jdbc", "jdbc:postgresql://u:secret@h/db", limit=5).first()
    assert p.partial and "secret" not in p.origin


def test_jdbc_options(monkeypatch):
    monkeypatch.setenv("DB_PASS", "pw")
    o = readers.jdbc_options("jdbc:postgresql://h/db?password=${DB_PASS}", query="select 1", partition={"column": "id", "lower": 0, "upper": 9, "count": 3})
    assert o["dbtable"] == "(select 1) src" and o["numPartitions"] == 3 and "READ ONLY" in o["sessionInitStatement"]
    assert "pw" in o["url"] and "pw" not in readers.mask_url(o["url"])
    with pytest.raises(KeyError):
        readers.expand_env("${NOT_SET_ANYWHERE}")


def test_missing_driver_hides_the_password(spark):
    with pytest.raises(ConnectionError) as e:
        readers.read_jdbc(spark, "jdbc:nosuch://user:hunter2@h/db", table="t")
    assert "hunter2" not in str(e.value)
    with pytest.raises(ConnectionError):
        layers.publish_jdbc({"t": spark.range(1)}, "jdbc:nosuch://user:hunter2@h/db")


def test_paths():
    assert readers.resolve("s3://b/k", "/p") == "s3://b/k" and readers.resolve("d/x.csv", "/p") == "/p/d/x.csv"


def test_bronze_and_layers(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, {"k": "v"})], "id int, m map<string,string>")
    layers.write_bronze(df, root, "t", "csv:t", datetime(2024, 1, 1))
    layers.write_bronze(df, root, "t", "csv:t", datetime(2024, 1, 2))
    assert layers.read_bronze(spark, root, "t").collect()[0].m == '{"k":"v"}'
    meta = layers.bronze_metadata(spark.read.parquet(layers.layer_path(root, "bronze", "t"))).first()
    assert meta.loaded_at == "2024-01-02T00:00:00+00:00"
    layers.write_layer(spark.range(3).toDF("id"), root, "gold", "d", None)
    opened = layers.read_layer(spark, root, "gold", "d")
    path = layers.write_layer(opened.unionAll(spark.range(5, 6).toDF("id")), root, "gold", "d")
    assert spark.read.parquet(path).count() == layers.read_layer(spark, root, "gold", "d").count() == 4


def test_a_reader_of_the_old_version_goes_on(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        layers.read_layer(spark, root, "gold", "t")
    opened = []
    for n in range(1, 5):
        layers.write_layer(spark.range(n), root, "gold", "t", keep=2)
        opened.append(layers.read_layer(spark, root, "gold", "t"))
        assert opened[-1].count() == n and (n == 1 or opened[-2].count() == n - 1)
    assert [int(v.split("-")[0]) for v in layers.versions(spark, layers.layer_path(root, "gold", "t"))] == [3, 4]
    with pytest.raises(ZeroDivisionError):
        layers.write_layer(_broken(), root, "gold", "t")
    assert layers.read_layer(spark, root, "gold", "t").count() == 4


def _broken():
    raise ZeroDivisionError


def test_a_write_that_dies_publishes_nothing(spark, tmp_path):
    root = str(tmp_path)
    layers.write_layer(spark.range(2), root, "gold", "t")
    with pytest.raises(PySparkException):
        layers.write_layer(spark.range(9).select(F.raise_error(F.lit("lost")).alias("id")), root, "gold", "t")
    assert layers.read_layer(spark, root, "gold", "t").count() == 2


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_the_last_arrival_wins_whatever_reads_it(spark, tmp_path, kind):
    from tidemark.operators import silver

    for part, n in (("b", 3000), ("a", 20), ("c", 700)):  # the largest file is read first, the last by name arrives last
        df = spark.range(n).select((F.col("id") % 10).alias("k"), F.concat(F.lit(part), "id").alias("v")).coalesce(1)
        getattr(df.write.option("header", True) if kind == "csv" else df.write, kind)(f"{tmp_path}/in/{part}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = spark.read.option("header", True) if kind == "csv" else spark.read
        df = getattr(read, kind)(f"{tmp_path}/in/*")
        layers.write_bronze(df, str(tmp_path), "t", "x", datetime(2024, 1, 1))
        landed = layers.read_bronze(spark, str(tmp_path), "t", with_arrival=True)
        out = silver.conform(landed.repartition(7), {"types": {"k": "integer"}, "dedup": ["k"]})
        assert out.columns == ["k", "v"]
        assert {r.v for r in out.collect()} == {f"c{i}" for i in range(690, 700)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert layers.read_bronze(spark, str(tmp_path), "t").columns == ["k", "v"]


def test_many_headers_are_one_scan(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.csv").write_text(f"\ufeffa,b{i},c\r\n1,\"x,{i}\",\r\n\r\na,b{i},c\r\n2,y,z\r\n")
    (tmp_path / "blank.csv").write_text("")
    (tmp_path / "late.csv").write_text("\n\n  \na|c\n5|6\n")
    out = readers.read_folder(spark, str(tmp_path), "*.csv", "csv")
    assert out.columns[0] == "a" and set(out.columns) == {"a", "c", "_file", *[f"b{i}" for i in range(6)]}
    rows = {(r._file, r.a): r for r in out.collect()}
    assert len(rows) == 13 and rows["3.csv", "1"].b3 == "x,3" and rows["3.csv", "1"].c is None and rows["late.csv", "5"].c == "6"
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan text") == 1
    with pytest.raises(readers.EmptySource):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "e.csv").write_text("")
        readers.read_folder(spark, str(tmp_path / "none"), "*.csv", "csv")


def test_warehouse_and_views(spark):
    counts = {r.table_name: r.rows for r in layers.load_warehouse(spark, {"tm_t": spark.range(7)}, "tm_gold").collect()}
    assert counts == {"tm_t": 7}
    out = layers.create_views(spark, {"tm_ok": "SELECT * FROM tm_gold.tm_t", "tm_bad": "SELECT zz FROM tm_gold.tm_t"})
    assert out["tm_ok"] is None and out["tm_bad"]
    with pytest.raises(layers.ViewsFailed):
        layers.require_views(out)
    assert kpis.query(spark, "SELECT count(*) AS n FROM tm_ok").first().n == 7


def test_declared_project(spark, tmp_path):
    (tmp_path / "clients.csv").write_text("id;zone;born\n1;N;2020-01-05\n2;S;2020-02-01\n2;W;2020-02-01\n")
    (tmp_path / "pay.csv").write_text("who;day;amount\n1;2020-03-01;1.234,50\n2;2020-03-09;2.000,00\n7;2020-04-01;5,00\n")
    spec = {
        "name": "p",
        "sources": [{"name": "clients", "type": "csv", "path": "clients.csv"}, {"name": "pay", "type": "csv", "path": "pay.csv"}],
        "silver": {"clients": {"types": {"id": "integer", "born": "date"}, "dedup": ["id"], "order": "zone"},
                   "pay": {"types": {"who": "integer", "day": "date", "amount": "decimal"}}},
        "quality": {"rules": [{"table": "pay", "column": "amount", "type": "positive"}, {"table": "pay", "column": "who", "type": "reference", "to": "clients.id", "critical": False}]},
        "model": {"dimensions": [{"name": "dim_client", "from": "clients", "key": "id", "scd": 2}],
                  "facts": [{"name": "fact_pay", "from": "pay", "date": "day", "keys": {"who": "dim_client"}}]},
    }
    assert project.problems(spec) == []
    landed = {s["name"]: project.read_source(spark, s, str(tmp_path)) for s in spec["sources"]}
    silver = project.conform_all(landed, spec)
    checked = project.check(spark, silver, spec)
    assert checked.where("not passed").select("rule").first().rule == "reference:pay.who"
    gold = project.build_model(spark, silver, spec, date(2024, 1, 1))
    assert gold["dim_client"].where("id = 2").first().zone == "W"
    assert gold["dim_calendar"].count() == 31 + 29 + 31 + 30
    assert sorted((r.dim_client_key, r.date_key, r.amount) for r in gold["fact_pay"].where("dim_client_key is not null").collect()) == [(1, 20200301, 1234.5), (2, 20200309, 2000.0)]
    assert set(project.build_model(spark, silver, {}, date(2024, 1, 1))) == {"tbl_clients", "tbl_pay", "dim_calendar"}
    broken = {"sources": [{"name": "a", "type": "tape"}], "silver": {"b": {}}, "kpis": [{"name": "k", "aggregation": "mode"}], "color": 1}
    assert len(project.problems(broken)) == 4
