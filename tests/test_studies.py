from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import freshness, growth, kpis, model, paths, timeintel
from tidemark.operators import transcripts as tx


@pytest.fixture
def market(spark):
    rows = []
    for year, scale in ((2023, 1.0), (2024, 1.2)):
        for month in range(1, 13 if year == 2023 else 7):
            for i, area in enumerate(("north", "south", "new")):
                for seller, base in (("us", 10 + i), ("them", 30 - i)):
                    if area == "new" and year == 2023:
                        continue
                    rows.append((date(year, month, 5), area, seller, base * scale * (1 + 0.1 * i), float(base)))
    return spark.createDataFrame(rows, "day date, area string, seller string, amount double, units double")


def test_identity_closes_up_to_the_published_residual(market):
    own = F.col("seller") == "us"
    members = growth.decompose(market.where("area <> 'new'"), "day", "amount", own, ["area"])
    s = growth.decomposition_summary(members).first()
    assert s.residual == pytest.approx(0) and s.competes and s.members == 2
    assert s.gap == pytest.approx(s.performance + s.mix)
    late = growth.decomposition_summary(growth.decompose(market, "day", "amount", own, ["area"])).first()
    assert late.residual != pytest.approx(0)  # a member without a prior market


def test_years_are_trimmed_to_common_months(market):
    assert sorted(r.month for r in growth.comparable_years(market, "day").collect()) == [1, 2, 3, 4, 5, 6]


def test_price_and_volume_add_up(market):
    r = growth.price_volume(market, "day", "amount", "units", F.col("seller") == "us").first()
    assert r.volume_effect + r.price_effect == pytest.approx(r.value_change) and r.residual == pytest.approx(0)


def test_ragged_year_is_not_a_fall(market):
    flat = market.withColumn("amount", F.lit(1.0)).where("area <> 'new'")
    change = {r.year: r.change for r in timeintel.comparable_yoy(flat, "day", "amount").collect()}
    assert change == {2024: pytest.approx(0)}


def test_prior_period_survives_gaps(spark):
    m = spark.createDataFrame([(date(2024, 1, 1), 1.0), (date(2024, 3, 1), 3.0), (date(2024, 4, 1), 4.0)], "month date, value double")
    got = {str(r.month): r.previous for r in timeintel.previous_month(m).collect()}
    assert got == {"2024-01-01": None, "2024-03-01": None, "2024-04-01": 3.0}


def test_ranks_with_ties(spark):
    g = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 3.0), ("d", 9.0)], "k string, value double")
    assert {r.k: r["rank"] for r in timeintel.ranked(g).collect()} == {"d": 1, "a": 2, "b": 2, "c": 4}
    assert {r.k: r["rank"] for r in timeintel.ranked(g, dense=True).collect()} == {"d": 1, "a": 2, "b": 2, "c": 3}


def test_every_tied_winner_is_a_row(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 1.0), ("c", 1.0)], "k string, v double")
    assert sorted(tuple(r) for r in kpis.which(df, "k", "v").collect()) == [("a", 2.0), ("b", 2.0)]


def test_misalignment_sees_groups_beyond_the_display_cut(spark):
    """Twenty groups; the worst one is the smallest, which a display of twelve would hide."""
    ids = spark.range(20).select(F.col("id").cast("int").alias("id"), F.format_string("g%02d", "id").alias("g"))
    sold = ids.select("id", (F.lit(100.0) - 5 * F.col("id")).alias("v"))
    visits = ids.select("id", F.lit(1.0).alias("n"))
    facts = {"sold": (sold, "id", ["v"]), "visits": (visits, "id", ["n"])}
    assert kpis.cross_facts(ids, "id", "g", facts).count() == 12
    r = kpis.misalignment(kpis.cross_facts(ids, "id", "g", facts, top=None), ["sold", "visits"]).first()
    assert (r.best, r.worst) == ("g00", "g19")


def test_no_measure_or_sample_is_cut(spark):
    df = spark.createDataFrame([("x" * 18 + "a", 1, 2, 3, 4, 5), ("x" * 18 + "b", 1, 2, 3, 4, 5)], "k string, a int, b int, c int, d int, e int")
    assert model.summary_table(df, "k", list("abcde")).columns == ["k", "rows", "sum_a", "sum_b", "sum_c", "sum_d", "sum_e"]
    r = kpis.column_stats(df.select("k"), "t").first()
    assert r.samples == "x" * 18 + "a | " + "x" * 18 + "b"


def test_ties_at_the_nth_member_are_kept(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(1500)] + [(9999, 5.0)], "m int, v double")
    r = timeintel.top_n_total(df, "m", "v", 1200).first()
    assert (r.value, r.members) == (1505.0, 1501)


def test_dropped_breakdowns_say_why(spark):
    rows = [("wide", f"m{i}", 0.1) for i in range(50)] + [("one", "m", 0.1)] + [("fine", m, 0.1) for m in "ab"]
    got = growth.left_out(spark.createDataFrame(rows, "dimension string, member string, total double")).collect()
    assert sorted(tuple(r) for r in got) == [("one", 1, "fewer than 2 members"), ("wide", 50, "more than 40 members")]


def test_misaligned_effort_is_named(spark):
    dim = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "id int, g string")
    sold = spark.createDataFrame([(1, 50.0), (2, 50.0), (3, 10.0)], "id int, v double")
    visits = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "id int, n double")
    cross = kpis.cross_facts(dim, "id", "g", {"sold": (sold, "id", ["v"]), "visits": (visits, "id", ["n"])})
    r = kpis.misalignment(cross, ["sold", "visits"]).first()
    assert (r.result, r.best, r.worst, r.effort, r.misaligned) == ("sold", "A", "B", "visits", True)


def test_path_order_and_results(spark):
    mail = paths.deepest_flag(spark.createDataFrame([(1, 1, date(2024, 1, 2), 1, 1, 0), (2, 1, date(2024, 1, 1), 1, 0, 0), (3, 2, date(2024, 1, 1), 0, 0, 0)],
                              "id int, who int, d date, sent int, opened int, clicked int"), ["sent", "opened", "clicked"])
    visit = spark.createDataFrame([(9, 1, date(2024, 1, 3), "phone", "Realizada")], "id int, who int, d date, canal string, estado string")
    path = paths.contact_path({
        "mail": {"df": mail, "entity": "who", "date": "d", "id": "id", "result": "result"},
        "visit": {"df": visit, "entity": "who", "date": "d", "id": "id", "channel": paths.pick_channel(visit, "estado"), "result": "estado"},
    })
    one = [(r.contact_id, r.contact_order, r.channel, r.result) for r in path.where("entity = 1").orderBy("contact_order").collect()]
    assert one == [(2, 1, "mail", "sent"), (1, 2, "mail", "opened"), (9, 3, "phone", "Realizada")]
    m = paths.path_measures(path).first()
    assert (m.contacts, m.longest_path, m.effective) == (4, 3, 2)
    with pytest.raises(ValueError):
        paths.contact_path({"visit": {"df": visit, "entity": "who", "date": "d", "id": "id"}})


def test_table_states(spark):
    from datetime import datetime

    now = datetime(2024, 5, 10, 12)
    def stamped(*days):
        return spark.createDataFrame([(d,) for d in days], "d date")
    got = {r.table_name: r.state for r in freshness.freshness(
        {"old": stamped(date(2024, 1, 1)), "new": stamped(date(2024, 5, 10)), "plans": stamped(date(2030, 1, 1)), "none": stamped(), "loaded": spark.range(2)},
        now, loads={"loaded": datetime(2024, 5, 10, 6), "plans": datetime(2024, 5, 10, 11)}).collect()}
    assert got == {"old": "late", "new": "up_to_date", "plans": "up_to_date", "none": "empty", "loaded": "up_to_date"}
    assert freshness.tolerance_hours("daily") == 27.6 and freshness.tolerance_hours("hourly") == 3.0


VTT = """WEBVTT

00:00:01.000 --> 00:00:03.000
<v Ana>Hola, empezamos.</v>

00:00:03.000 --> 00:00:06.000
<v Ana>Decidimos usar el archivo diario.</v>

00:00:06.000 --> 00:00:09.500
<v Luis>Te mando el detalle el lunes.</v>

00:00:10.000 --> 00:00:15.000
<v Ana>No tenemos permiso todavía. ¿Quién lo pide?</v>
"""


def test_captions_to_minutes(spark):
    docs = spark.createDataFrame([("m1", VTT), ("m2", "Ana: uno\nsigue acá\nLuis: dos"), ("m3", "sin nombres acá"), ("m4", "  ")], "doc string, text string")
    turns = tx.merge_turns(tx.parse_transcripts(docs))
    one = [(r.speaker, r.start_s, r.end_s) for r in turns.where("doc = 'm1'").orderBy("turn").collect()]
    assert one == [("Ana", 1.0, 6.0), ("Luis", 6.0, 9.5), ("Ana", 10.0, 15.0)]
    assert [(r.speaker, r.text) for r in turns.where("doc = 'm2'").orderBy("turn").collect()] == [("Ana", "uno sigue acá"), ("Luis", "dos")]
    assert tx.participants(turns).where("doc = 'm3'").first().speaker == "?"
    marks = {(r.decision, r.commitment, r.risk, r.question, r.due) for r in tx.minutes(tx.sentences(turns)).where("doc = 'm1'").collect()}
    assert marks == {(True, False, False, False, None), (False, True, False, False, "el lunes"), (False, False, True, False, None), (False, False, False, True, None)}
    assert {r.topic for r in tx.topic_mentions(tx.sentences(turns)).where("doc = 'm1'").collect()} == {"sources", "governance"}


def test_long_runs_are_cut_in_turn(spark):
    rows = [("d", i, "A" if i < 8 else "B", None, None, "x" * 300) for i in range(9)]
    turns = spark.createDataFrame(rows, "doc string, turn bigint, speaker string, start_s double, end_s double, text string")
    assert [(r.turn, r.speaker, len(r.text)) for r in tx.merge_turns(turns).orderBy("turn").collect()] == [
        (0, "A", 902), (3, "A", 902), (6, "A", 601), (8, "B", 300)]


def test_growth_reads_its_facts_once(spark, tmp_path):
    rows = [(date(y, m, 3), who, area, 10.0 * m, 1.0 * m) for y in (2023, 2024) for m in (1, 2) for who in ("us", "them") for area in ("n", None)]
    spark.createDataFrame(rows, "day date, seller string, area string, amount double, units double").write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    members = growth.decompose(facts, "day", "amount", F.col("seller") == "us", ["area"])
    assert not [f for f in members.inputFiles() if str(tmp_path) in f]
    assert {(r.member, r.own0, r.own1, r.market1) for r in members.collect()} == {("n", 30.0, 30.0, 60.0), ("—", 30.0, 30.0, 60.0)}
