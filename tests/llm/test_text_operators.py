"""Join, decontamination and packing against plain versions, with the awkward rows of every contract."""

import random
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
from plain import contaminated, jaccard_components
from pyspark.sql import functions as F

from tidemark.llm import decontam, ngram_join, packing, registry, store

SF = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, n_shingles string, hits string, start string, __extra int"


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], schema)


def noisy(seed, families=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([4, 15, 60, 200]))
        for _ in range(copies):
            text = [w if rng.random() > 0.01 * rng.randint(0, 3) else rng.choice(vocabulary) for w in base]
            rows.append((at, " ".join(text[: len(text) - rng.randint(0, 2)])))
            at += 1
    return rows


AWKWARD = [(900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "One"), (905, "one two"), (906, "a " * 3000),
           (907, "a " * 2999 + "b"), (None, "one two three four"), (None, None), (908, "x" * 100_000)]


@pytest.mark.parametrize("seed,n,percent,block", [(1, 3, 90, 4000), (2, 5, 80, 4000), (3, 3, 90, 7), (4, 2, 60, 5)])
def test_jaccard_components(spark, seed, n, percent, block):
    rows = noisy(seed) + AWKWARD + [(3, noisy(seed)[3][1])]
    got = ngram_join.similar_components(frame(spark, rows), n, percent, block).collect()
    want = jaccard_components(rows, n, percent) + [(None, 2 if n == 3 else 0, None), (None, 0, None)]
    got = [tuple(r) if r[0] is not None else (None, 2 if n == 3 and r[1] else 0, None) for r in got]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_jaccard_empty(spark):
    assert ngram_join.similar_components(frame(spark, [])).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_part_keys(percent):
    rng = np.random.default_rng(percent)
    draw = lambda n: rng.integers(0, 2**64, n, np.uint64)

    def keys(sets):
        sets = [np.sort(s) for s in sets]
        doc, key = ngram_join.part_keys(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), percent)
        return [set(key[doc == i].tolist()) for i in range(len(sets))]

    for size in [*range(1, 40), 150, 700]:
        for _ in range(6):  # a subset and a set with as many elements exchanged as a link allows share a key
            whole = draw(size)
            fewer = whole[: max(1, -(-percent * size // 100))]
            moved = int(size * (100 - percent) / (100 + percent))
            x, y, z = keys([whole, fewer, np.concatenate([whole[moved:], draw(moved)])])
            assert x & y and x & z
    if percent > 60:  # sets without a common element meet in no part
        found = keys([draw(300) for _ in range(200)])
        assert sum(map(len, found)) == len(set().union(*found))


def test_large_groups_take_the_sketch_test(spark, monkeypatch):
    rng = random.Random(8)
    hot = [f"h{i}" for i in range(40)]  # whole parts of it are in every text
    rows = [(i, " ".join(hot + rng.choices([f"w{k}" for k in range(5000)], k=60))) for i in range(60)]
    rows += [(100 + i, t + " more") for i, t in rows[:50]]
    monkeypatch.setattr(ngram_join, "UNSKETCHED", 8)
    blocks, known = [], ngram_join.candidate_blocks

    def kept(shared, *more):
        assert shared.agg(F.max("classes")).first()[0] > 8
        blocks.append(known(shared, *more))
        return blocks[-1]

    monkeypatch.setattr(ngram_join, "candidate_blocks", kept)
    got = ngram_join.similar_components(frame(spark, rows), 1, 60).collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_components(rows, 1, 60))
    assert blocks[0].groupBy("root").count().agg(F.max("count")).first()[0] == 2


def test_queries_of_a_large_block_are_dealt(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[: len(base) - rng.randint(0, 90)] + [f"own{i}"])) for i in range(120)]
    tasks, links = [], ngram_join.shard_links

    def counted(sets, percent):
        tasks.append(sets.groupBy("block", "shard", "part").count().agg(F.max("count")).first()[0])
        return links(sets, percent)

    monkeypatch.setattr(ngram_join, "shard_links", counted)
    got = ngram_join.similar_components(frame(spark, rows), 3, 90, 10).collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_components(rows))
    assert tasks[0] <= 50


def test_one_of_each_keeps_columns(spark):
    docs = frame(spark, noisy(5) + AWKWARD)
    kept = ngram_join.one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    want = {c for i, n, c in jaccard_components(noisy(5) + AWKWARD)}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == want


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    base = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    near = base["a"].replace("a59", "z")
    rows = [(1, base["a"]), (1, base["b"]), (2, near), (3, base["b"]), (3, base["c"]), (3, base["c"]), (4, base["d"]), (5, base["d"]),
            (6, ""), (6, None), (6, base["a"]), (7, None), (None, base["a"]), (0, base["c"] + " c60")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(frame(spark, rows)).where("doc_id is not null").collect())
    assert got == sorted([(1, 58, 1), (1, 58, 1), (2, 58, 1), (3, 58, 1), (3, 58, 0), (3, 58, 0), (4, 58, 4), (5, 58, 4), (6, 0, 6), (6, 0, 6), (6, 58, 1), (7, 0, 7), (0, 59, 0)])
    kept = [(r.doc_id, r.text) for r in ngram_join.one_of_each(frame(spark, rows)).collect()]
    want = [(1, base["a"]), (1, base["b"]), (0, base["c"] + " c60"), (4, base["d"]), (6, ""), (6, None), (7, None), (None, base["a"])]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
    assert ngram_join.one_of_each(frame(spark, [])).collect() == []


def test_components_of_long_chains(spark):
    n = 300
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.createDataFrame([(1000, 1000), (2000, 1001), (1001, 2000), (5, None)], "a long, b long"))
    got = {r.node: r.root for r in store.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1001: 1001, 2000: 1001}


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, short):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["Ünder", "naïve", "42"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(10, 40)))) for i in range(30)] + [(31, None), (32, "!!"), (None, "w1 w2")]
    if short:
        items += [(40, "w1 w2 w3"), (41, "W5")]
    rows = []
    for i in range(60):
        body = rng.choices(words, k=rng.randint(0, 120))
        if i % 3 == 0:
            source = items[rng.randrange(30)][1].split()
            cut = rng.randint(0, max(0, len(source) - 10))
            body[5:5] = source[cut : cut + rng.randint(8, 14)]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(body)))
    rows += AWKWARD + [(0, rows[3][1]), (0, rows[3][1])]
    docs, bench = frame(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    got = decontam.report(docs, bench.union(bench)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(contaminated(rows, items), key=key)
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r.contaminated for r in got)


def test_a_short_item_moves_no_clean_document(spark, monkeypatch):
    kept = []
    real = store.written
    monkeypatch.setattr(store, "written", lambda df, name="part": kept.append((name, out := real(df, name))) or out)
    items = [(1, " ".join(f"q{i}" for i in range(20))), (2, "needle"), (3, "two words")]
    rows = [(i, f"doc{i} " + " ".join(f"x{i}y{j}" for j in range(30))) for i in range(300)]
    rows += [(900, "a Needle here"), (901, "words two two words"), (902, " ".join(f"q{i}" for i in range(9)))]
    got = {r.doc_id: r for r in decontam.report(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sorted(map(tuple, got.values())) == sorted(contaminated(rows, items))
    assert {r.doc_id for r in dict(kept)["suspects"].collect()} <= {900, 901, 902} | {i for i in got if i < 10}


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(frame(spark, []), bench).collect() == []
    assert [r.n_hit for r in decontam.report(frame(spark, [(1, "a b")]), bench).collect()] == [0]


def test_spans_point_at_the_passage(spark):
    text = "Vor—dem Text: " + " ".join(f"q{i}" for i in range(12)) + " danach"
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(12)))], "item_id long, text string")
    row = decontam.marked(frame(spark, [(1, text)]), bench).first()
    (a, b), = row["__hits"].spans
    assert text.encode()[a:b].decode() == " ".join(f"q{i}" for i in range(12))


def test_best_fit_takes_the_tightest():
    import numpy as np

    number, offset, opened = packing.best_fit(np.array([600, 500, 424, 520, 4, 1024]), 1024)
    assert opened == 3
    assert {(int(n), int(o)) for n, o in zip(number, offset)} == {(1, 0), (2, 520), (1, 600), (2, 0), (2, 1020), (0, 0)}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ds.dataset(f"{SF}/documents.parquet").to_table().to_pydict()["text"]
    odd = ["a  b", "a \n b ", " ", "", None, "x y 　z é Élan's  l'été", "<|endoftext|> a <|endoftext|>b", "  a", "n" * 9000,
           "tail  ", "tail ", "  lead", "1 2  3\t4", "🙂 🙂", "Ää\r\n  öö"]
    rows = list(enumerate(odd + texts)) + [(None, "no id"), (2, "twice"), (2, "twice")]
    got = packing.pack(frame(spark, rows).repartition(3), registry.byte_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(registry.byte_tokenizer())
    want = sorted(str((i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    pieces, windows = {}, {}
    for n, r in enumerate(got):
        assert len(r.ids) == 4 * r.length
        key = (r.doc_id, r.doc_tokens) if r.doc_id != 2 or r.doc_tokens > 3 else (2, n)
        pieces.setdefault(key, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    back = []
    for (i, _), rs in pieces.items():
        blob = b"".join(bytes(r.ids) for r in sorted(rs, key=lambda r: r.start))
        back.append(str((i if not isinstance(i, tuple) else 2, [int.from_bytes(blob[k : k + 4], "little") for k in range(0, len(blob), 4)])))
    assert sorted(back) == want
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(r.length for r in got)
    assert used / (1024 * len(windows)) > 0.9
    digest = packing.pack_digest(frame(spark, rows), registry.byte_tokenizer()).collect()
    assert sorted(r.ids_crc32 for r in digest) == sorted(zlib.crc32(bytes(r.ids)) for r in got)


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, []), registry.byte_tokenizer()).collect() == []


def test_memory_of_token_pieces_does_not_grow_with_a_batch():
    """Texts of a batch are encoded in slices, as two tasks and what earlier stages left share an executor's memory."""
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa

    from tidemark.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = packing.Encoder(path)
    text = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(12), pa.int64()), "text": [text + str(i) for i in range(12)]})
    was, packing.Encoder = packing.Encoder, lambda _: encoder
    try:
        tracemalloc.start()
        total = sum(p.num_rows for p in packing.pieces_of(iter([batch]), path, 1024, 0))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        packing.Encoder = was
    assert total > 12 and peak < 100e6
