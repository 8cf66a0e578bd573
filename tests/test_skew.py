"""Joins, passages and merged turns under hot and null keys: the same rows as plain versions, spread over tasks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scale
from tidemark.operators import joins
from tidemark.operators import transcripts as tx

TURNS = "doc string, turn bigint, speaker string, start_s double, end_s double, text string"


@pytest.fixture
def shuffled(spark):
    """No broadcast of a join side and no help from adaptive execution, so that tasks show how keys fall."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def balance(df):
    """Rows of the largest task over those of the median one."""
    rows = sorted(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    return rows[-1] / rows[len(rows) // 2]


@pytest.fixture
def fact(spark):
    n = F.col("id")
    key = F.when(n % 2 == 0, F.lit(7)).when(n % 10 == 1, F.lit(None)).otherwise(n % 5000)
    return spark.range(80_000).select(n.alias("row"), key.cast("int").alias("k"))


@pytest.fixture
def dim(spark):
    return spark.range(4000).select(F.col("id").alias("natural"), (F.col("id") * 10).alias("surrogate"), F.concat(F.lit("s"), F.col("id") % 9).alias("name"))


def test_dimension_joins_spread_a_key_of_half_the_rows(shuffled, fact, dim):
    plain = fact.join(dim, F.col("k") == F.col("natural"), "left")
    assert balance(plain) > 6
    for made in (
        joins.lookup_key(fact.withColumn("code", F.col("k")), dim, "k", "natural", "surrogate"),
        joins.denormalise(fact, dim, "k", "natural", ["name"]),
        joins.segment_lookup(fact.withColumnRenamed("k", "natural"), dim, "natural", "name"),
    ):
        assert balance(made) < 2.5


def test_dimension_joins_equal_plain_joins(spark, fact, dim):
    twice = dim.union(dim.where("natural < 20").withColumn("name", F.lit("again")))
    made = joins.denormalise(fact, twice, "k", "natural", ["name"])
    plain = fact.join(twice.select("natural", "name"), F.col("k") == F.col("natural"), "left").drop("natural")
    assert made.columns == plain.columns and made.exceptAll(plain).isEmpty() and plain.exceptAll(made).isEmpty()
    keyed = joins.lookup_key(fact, dim, "k", "natural", "surrogate")
    assert keyed.columns == ["row", "surrogate"] and keyed.where("surrogate is null").count() == fact.where("k is null or k >= 4000").count()
    named = joins.segment_lookup(fact.withColumnRenamed("k", "natural"), dim, "natural", "name")
    assert set(named.columns) == {"row", "natural", "name"} and named.where("name = 'Unclassified'").count() == fact.where("k is null or k >= 4000").count()


@pytest.mark.parametrize("kind", ["string", "date", "decimal(10,2)", "boolean", "double"])
def test_spread_join_takes_keys_of_any_type(spark, kind):
    left = spark.createDataFrame([(i, v) for i, v in enumerate(["1", "1", "1", None, "0", "2"])], "i int, raw string")
    typed = F.col("raw") if kind == "string" else F.date_add(F.lit("2024-01-01").cast("date"), F.col("raw").cast("int")) if kind == "date" else F.col("raw").cast("int").cast(kind)
    left = left.select("i", typed.alias("k"))
    right = left.where("i in (0, 4)").select(F.col("k").alias("r"), F.col("i").alias("hit"))
    got = {r.i: r.hit for r in scale.spread_join(left, right, "k", "r").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: None, 4: 4, 5: 0 if kind == "boolean" else None}
    none = scale.spread_join(left.limit(0), right, "k", "r")
    assert none.columns == ["i", "k", "r", "hit"] and none.count() == 0
    assert scale.spread_join(left, right.limit(0), "k", "r").where("hit is not null").count() == 0


def test_hot_values_are_bounded(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("id")).alias("k"))
    counted = df.groupBy("k").agg(F.count("*").alias("n"))
    assert [r.k for r in scale.hot_counted(counted, "k", "n").collect()] == [-1]
    assert -1 in {r.v for r in scale.frequent(df, "k").collect()}


def folded(rows):
    out = []
    for doc, turn, speaker, start, end, text in sorted(rows, key=lambda r: (r[0], r[1])):
        if out and out[-1][0] == doc and out[-1][2] == speaker and len(out[-1][5]) < tx.MERGE_BELOW:
            out[-1][4:] = [end, (out[-1][5].rstrip() + " " + text.lstrip()).strip()]
        else:
            out.append([doc, turn, speaker, start, end, text])
    return sorted(map(tuple, out), key=lambda r: r[:2])


def merged(spark, rows):
    got = tx.merge_turns(spark.createDataFrame(rows, TURNS).repartition(5)).select(*[c.split()[0] for c in TURNS.split(", ")])
    return sorted(map(tuple, got.collect()), key=lambda r: r[:2])


def test_merged_turns_equal_a_fold(spark):
    rng = random.Random(3)
    rows = []
    for d in range(25):
        for t in range(rng.randint(1, 70)):
            edge = "z" * rng.choice([349, 350, 690, 698, 699, 700, 701, 702, 1500])
            text = rng.choice(["", " ", "\n\x1c ", "x" * rng.randint(1, 40), " y" * rng.randint(1, 60) + " ", edge, " " * rng.choice([3, 699, 700, 705])])
            rows.append((f"d{d}", t * 3 + 1, rng.choice("AAAAAB") if d % 3 else "A", t * 1.0, t + 0.5, text if rng.random() < 0.6 else "w" * rng.randint(1, 300)))
    assert merged(spark, rows) == folded(rows)
    assert merged(spark, [("d", 1, None, None, None, "a"), ("d", 2, None, None, 2.0, "b")]) == [("d", 1, None, None, 2.0, "a b")]
    assert merged(spark, rows[:0]) == []


def test_a_speaker_who_never_stops(spark):
    rng = random.Random(5)
    rows = [("d", i, "A", i * 1.0, i + 0.5, "word " * rng.randint(1, 25)) for i in range(30_000)]
    assert merged(spark, rows) == folded(rows)


def words_of(text):
    return {w for w in re.findall(r"\w{4,}", text.lower()) if w not in tx.STOP_WORDS}


def passages(rows, questions):
    out = set()
    for q, text in questions:
        scored = [(-len(words_of(text) & words_of(s)), d, t, i) for d, t, i, _, s in rows]
        best = min(scored, default=(0,))
        if best[0] <= -2:
            out.add((q, *best[1:], -best[0]))
    return out


def test_best_passages_equal_a_scan(spark):
    rng = random.Random(8)
    vocabulary = ["report", "model", "every", *[f"word{i}" for i in range(30)], "the", "un"]
    rows = [(f"d{i % 7}", i // 7, i % 2, "A", " ".join(["every", *rng.choices(vocabulary, k=rng.randint(0, 9))])) for i in range(400)]
    questions = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)))) for i in range(40)]
    questions += [("none", "missing words"), ("one", "every"), ("two", "every report")]
    lines = spark.createDataFrame(rows, "doc string, turn long, sentence long, speaker string, text string")
    asked = spark.createDataFrame(questions, "question_id string, question string")
    got = {(r.question_id, r.doc, r.turn, r.sentence, r.shared) for r in tx.best_passage(asked, lines).collect()}
    assert got == passages(rows, questions)
    assert tx.best_passage(asked, lines.limit(0)).count() == 0 and tx.best_passage(asked.limit(0), lines).count() == 0


def test_words_in_every_sentence_are_spread(shuffled):
    n = F.col("id")
    lines = shuffled.range(20_000).select(
        F.lit("d").alias("doc"), n.alias("turn"), F.lit(0).cast("long").alias("sentence"), F.lit("A").alias("speaker"),
        F.concat(F.lit("always every report word"), n % 3000).alias("text"),
    )
    asked = shuffled.createDataFrame([("q", "always every report")], "question_id string, question string")
    real = tx.best_passage(asked, lines)
    plan = real._jdf.queryExecution().executedPlan().toString()
    assert "w#" in plan and "__part" in plan
    assert [(r.turn, r.shared) for r in real.collect()] == [(0, 3)]
