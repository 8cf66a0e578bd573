"""Runs against a word-by-word scan of every period, with blocks and zones, and the awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import periodic_runs, registry
from tidemark.llm import tokens as tk

SF = "/root/testdata/sf0.001"


def plain(x):
    """(start, period, length) of every run, ascending."""
    found = {}
    x = np.unique(x, return_inverse=True)[1] if len(x) else np.zeros(0, int)
    for q in range(1, len(x) // 4 + 1):
        same = np.concatenate([[0], x[q:] == x[:-q], [0]]).astype(int)
        for start, end in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            if end + q - start >= max(6, 4 * q):
                found[start, end + q - start] = min(q, found.get((start, end + q - start), q))
    return sorted((s, q, m) for (s, m), q in found.items())


def row(doc_id, text, planted=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain(w)
    drop = {i for s, q, m in runs for i in range(s + q, s + m)}
    s, q, m = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=(None, None, None))
    text = " ".join(x for i, x in enumerate(w) if i not in drop)
    lines = "".join(f"{a},{c},{b}\n" for a, b, c in runs)
    return (doc_id, len(runs), s, m, q, 1000 * m // q if q else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def looping(rng, size, blocks):
    x, a = [], rng.choice([1, 2, 3, 5, 40, 400])
    while len(x) < size:
        x += [rng.randrange(a) for _ in range(rng.choice(blocks))] * rng.choice([1, 1, 3, 4, 5, 9])
        x = x[: len(x) - rng.randint(0, 3)] + [rng.randrange(a) for _ in range(rng.randint(0, 6))]
    return x


def got(texts, block=periodic_runs.BLOCK):
    w = tk.words(pa.array([" ".join(map(str, x)) for x in texts]))
    return [[(s, p, m) for s, m, p in f.tolist()] for f in periodic_runs.text_runs(w, block)]


def test_runs_of_many_short_texts():
    rng = random.Random(2)
    texts = [looping(rng, rng.randint(0, 150), [1, 2, 3, 7, 8, 9, 10, 25]) for _ in range(1500)] + [[], [1], [1] * 5, [1] * 6]
    assert got(texts) == [plain(x) for x in texts]


@pytest.mark.parametrize("block", [2048, 1 << 16])
def test_runs_longer_than_a_block(block):
    rng = random.Random(block)
    texts = [looping(rng, 7000, [1, 3, 20, 250, 300, 400, 700]) for _ in range(6)] + [[7] * 9000, [1, 2, 1, 3, 1] * 2500]
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 900:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    noise = [rng.randrange(10**6) for _ in range(900)]
    texts += [([7] * 900 + [8]) * 5, ([7] * 450 + [1, 2] * 300 + noise[:9]) * 5, [9] * 50 + (fibonacci[1][:900] + [5]) * 5 + [1, 2],
              (noise + [3] * 800) * 4 + noise[:50], [1, 2] * 5000 + noise * 5, fibonacci[1] * 6]
    assert got(texts, block) == [plain(x) for x in texts]


def test_a_single_word_a_million_times():
    assert got([[4] * 1_000_000 + [5]]) == [[(0, 1, 1_000_000)]]


def test_link_cut_access_finds_every_last_occurrence():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        found = periodic_runs.repeats(x, 2, 2)
        want = set()
        for i in range(len(x)):
            for p in range(1, i + 1):
                m = next((k for k in range(i - p + 1) if x[i - k] != x[i - p - k]), i - p + 1)
                if m >= p and (i + 1 == len(x) or x[i + 1] != x[i + 1 - p]):
                    whole = x[i - m - p + 1 : i + 1]
                    if not any(whole[d:] == whole[:-d] for d in range(1, p)):
                        want.add((i, p))
        assert set(found) == want and len(found) == len(want)


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, registry.op12_periodic_runs(spark, SF).collect())) == sorted(row(*d) for d in docs)


AWKWARD = [(1, None), (2, ""), (None, "a " * 40), (None, None), (3, " \t\n"), (4, "x y z " * 9), (4, "x y z " * 9),
           (5, "\x1c \x1d " * 8), (6, "long" * 50_000), (7, "one two " * 60_000), *[(i, "k l m n o p q " * (i % 30)) for i in range(100, 190)]]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in AWKWARD], "doc_id long, text string, start int, mark string")
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    want = [row(i, t) for i, t in AWKWARD if t is None or len(t) < 50_000]
    rows = periodic_runs.digests(docs).collect()
    assert sorted(map(tuple, (r for r in rows if r.doc_id not in (6, 7))), key=key) == sorted(want, key=key)
    long_ = {r.doc_id: r for r in rows if r.doc_id in (6, 7)}
    assert long_[6].n_runs == 0 and (long_[7].start, long_[7].length, long_[7].period) == (0, 120_000, 2)
    kept = periodic_runs.collapsed(docs)
    assert kept.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert {(1, None), (2, ""), (None, "a"), (4, "x y z"), (7, "one two")} <= texts
    listed = {tuple(r) for r in periodic_runs.listed(docs).where("doc_id = 7 or doc_id = 4").collect()}
    assert listed == {(7, 0, 120_000, 2), (4, 0, 9, 1)}


def test_a_rewritten_tail_is_one_run():
    rng = np.random.default_rng(0)
    words = " ".join(f"w{x}" for x in rng.permutation(500))
    for mark in range(0, 400, 10):
        (found,) = periodic_runs.text_runs(periodic_runs.looped(tk.words(pa.array([words])), [mark]))
        g = mark // 10
        p = 1 + (500 - g) // (3 + g % 8)
        assert found.tolist() == ([[g, 500 - g, p]] if 500 - g >= 4 * p else [])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.digests(none).collect() == periodic_runs.listed(none).collect() == []
