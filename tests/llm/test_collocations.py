"""Collocations against a plain count of all phrases, with dense, thin and unranked pairs, and the awkward rows."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from tidemark.llm import collocations, registry
from tidemark.llm import tokens as tk

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain(rows, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    wanted = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in wanted.items():
        longer = [b for (x, v), b in wanted.items() if x == lang and len(v) > len(w)
                  and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    found = []
    for lang, phrases in out.items():
        for i, (s, a, p, l, r) in enumerate(sorted(phrases)[:top]):  # noqa: E741
            found.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(found)


def corpus(seed):
    rng = random.Random(seed)
    words = ["The", "the", "of", "São", "x\x00y", "b\x1fc", "été", "w8", "-", "A"]
    rows = []
    for i in range(250):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"]) for _ in range(rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (None, None), ("one", "xx"), ("go " * 9000, "en"), ("...", "de"), ("q" * 90_000, "de")]


@pytest.mark.parametrize("ranked,crowded,held", [(1 << 15, 1, 1 << 20), (4, 2048, 50), (300, 40, 3), (1, 1, 1)])
def test_matches_a_plain_count(spark, ranked, crowded, held):
    rows = corpus(ranked)
    df = spark.createDataFrame([(t, l, 1, "k", 2) for t, l in rows], "text string, lang string, a int, key string, n int")  # noqa: E741
    got = collocations.phrases(df.repartition(3), least=6, ranked=ranked, crowded=crowded, held=held)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 6)


def test_only_the_first_of_each_language(spark):
    rows = corpus(9)
    got = collocations.phrases(spark.createDataFrame(rows, "text string, lang string"), least=3, top=5)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 5)


def test_tiles_and_coordinates_add_up():
    rng = np.random.default_rng(1)
    tiles, sums = collocations.Tiles(4, 200), collections.Counter()
    held, seen = collocations.Coordinates(100), collections.Counter()
    for _ in range(20):
        a, b = (rng.zipf(1.3, 3000) % 1024 for _ in range(2))
        left = tiles.add(a, b)
        sums.update(zip(a[~left].tolist(), b[~left].tolist()))
        held.add(a[left].astype(tk.U64), b[left].astype(tk.U64))
        seen.update(zip(a[left].tolist(), b[left].tolist()))
        for _, n, x, y in held.emitted(False):
            seen.subtract(dict(zip(zip(x.tolist(), y.tolist()), n.tolist())))
    for _, n, x, y in held.emitted(True):
        seen.subtract(dict(zip(zip(x.tolist(), y.tolist()), n.tolist())))
    assert tiles.dense and not any(seen.values())
    assert {(x, y): n for i, j, c in tiles.emitted() for x, y, n in zip(i.tolist(), j.tolist(), c.tolist())} == dict(sums)


def test_ids_of_keys():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
        keys = rng.permutation(np.append(keys, [np.uint64(2**64 - 1), np.uint64(0)]))
        ids = collocations.Ids(keys)
        assert ids.of(keys).tolist() == list(range(len(keys)))
        other = np.setdiff1d(np.concatenate([keys + np.uint64(1), rng.integers(0, 2**64, 500, np.uint64)]), keys)
        assert (ids.of(other) == -1).all()


def test_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = registry.op11_collocations(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(collocations.PHRASES_SQL).fetchall())


def test_empty(spark):
    assert collocations.phrases(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.phrases(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []
