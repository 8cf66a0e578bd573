import random

import numpy as np
import pytest
from plain import first_copies_removed

from tidemark.llm import fm_index, substring_dedup

ROWS = "doc_id long, text string, marks string, n_chars int, doc string, at int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "m", len(t or ""), "d", 3) for i, t in rows], ROWS)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["é", "ñandú,"]
    passages = [rng.choices(words, k=rng.randint(15, 70)) for _ in range(6)]
    rows = []
    for i in range(docs):
        body = rng.choices(words, k=rng.randint(0, 150))
        for p in rng.sample(passages, rng.randint(0, 3)):
            cut = rng.randint(0, 8)
            at = rng.randint(0, len(body))
            body[at:at] = p[cut : len(p) - rng.randint(0, 8)]
        if i % 11 == 0:
            body += ["x", "y"] * rng.randint(5, 60)
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(body)))
    rows += [(300 + i, " ".join(x for w in rng.sample(words, 9) for x in [w] * rng.randint(1, 40))) for i in range(8)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, None), (201, ""), (202, "z " * 300), (203, "z " * 25), (204, "q" * 50_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,crowded", [(1, 20_000), (2, 20_000), (3, 0), (4, 3)])
def test_first_copies_stay(spark, monkeypatch, seed, crowded):
    monkeypatch.setattr(substring_dedup, "SHARD_CLASSES", 40)
    monkeypatch.setattr(substring_dedup.repeats, "__defaults__", (crowded,))
    rows = corpus(seed)
    got = substring_dedup.report(frame(spark, rows).repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == first_copies_removed(rows)


def test_ids_null_or_repeated(spark):
    rows = corpus(5, 20)
    twice, nameless = rows[:3], [(None, rows[0][1]), (None, rows[1][1])]
    got = substring_dedup.report(frame(spark, rows + twice + nameless)).collect()
    plain = first_copies_removed(rows)
    told = {r[0]: r for r in plain}
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(plain + [told[i] for i, _ in twice])
    assert [r.n_removed for r in got if r.doc_id is None] == [0, 0]


def test_clean_keeps_columns_and_untouched_texts(spark):
    rows = corpus(6, 20)
    docs = frame(spark, rows)
    out = substring_dedup.clean(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    lost = {i: n for i, _, n, _ in first_copies_removed(rows)}
    for r in out.collect():
        assert r.n_chars == len(r.text or "")
        assert lost[r.doc_id] or r.text == dict(rows)[r.doc_id]


def test_nothing(spark):
    assert substring_dedup.report(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_fm_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    segs = [rng.integers(0, 3, rng.integers(4, 30)).astype(np.uint64) for _ in range(rng.integers(1, 20))]
    major, minor = rng.integers(0, 5, len(segs)), rng.integers(0, 9, len(segs))
    got = fm_index.earlier_copies(segs, major, minor, 4)
    best = {}
    for s, a, b in zip(segs, major, minor):
        for i in range(len(s) - 3):
            k = tuple(s[i : i + 4])
            best[k] = min(best.get(k, (9, 99)), (a, b + i))
    for s, a, b, m in zip(segs, major, minor, got):
        assert [best[tuple(s[i : i + 4])] < (a, b + i) for i in range(len(s) - 3)] == m.tolist()
