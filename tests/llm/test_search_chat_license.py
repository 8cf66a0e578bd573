import random

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import functions as F

from tidemark.llm import chat_format, license_scan, mtree

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, k=5, every=50):
    ints = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ints), default=0)
    ints = [(i, np.pad(v, (0, width - len(v)))) for i, v in ints]
    asks = {}
    for i, v in ints:
        if i % every == 0:
            asks[i] = min(asks.get(i, v), v, key=tuple) if i in asks else v
    out = []
    for q, v in asks.items():
        best = sorted((-int(v @ x), i) for i, x in ints if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_of_given_vectors(spark):
    t = ds.dataset(f"{SF}/embeddings.parquet").to_table().to_pydict()
    got = mtree.top_k(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(list(zip(t["vec_id"], t["embedding"])))


def test_top_k_awkward(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 300)
    monkeypatch.setattr(mtree, "BLOCK_QUERIES", 7)
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(900)]
    rows += [(1000 + i, [1.0] * 8) for i in range(200)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8),
             (2150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2200, []), (2250, [3.0]), (50, [0.5] * 8), (50, [0.5] * 8), (7, [9.0] * 8), (-50, [0.0] * 8)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    docs = spark.createDataFrame([(i, v, 1, "") for i, v in rows], VECTORS)
    assert sorted(tuple(r) for r in mtree.top_k(docs, F.col("vec_id") % 50 == 0).collect()) == brute(rows)
    few = spark.createDataFrame([(i, v, 1, "") for i, v in rows[:3]], VECTORS)
    assert sorted(tuple(r) for r in mtree.top_k(few, F.col("vec_id") % 50 == 0).collect()) == brute(rows[:3])
    assert mtree.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).collect() == []


def test_stored_bounds_spare_computations(monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 32)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (40, 16))
    vectors = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 5, (4000, 16))).astype(np.int64)
    tree = mtree.MTree(np.arange(4000), vectors)
    seen = []

    real = tree._scores
    tree._scores = lambda members, *more: seen.append(len(members)) or real(members, *more)
    tree.search(vectors[0], 0, 5)
    assert 5 <= sum(seen) < 1500


TURNS = "conv_id long, turn long, role string, text string, name string, perspective int"


def test_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo é"), (1, 2, "bob", "yo é"), (1, 3, None, "who"),
             (1, 4, "", None), (2, 0, "system", "alone"), (None, 0, "cy", "x"), (None, None, "ann", "y")]
    frame = spark.createDataFrame([(*t, "n", 1) for t in turns], TURNS)
    got = sorted((tuple(r) for r in chat_format.rotated(frame).collect()), key=str)
    want = []
    for conv in {t[0] for t in turns}:
        mine = [t for t in turns if t[0] == conv]
        for who in {t[2] for t in mine} - {"system", None, ""}:
            for _, n, role, text in mine:
                kind = "assistant" if role == who else "system" if role == "system" else "user"
                name = role if kind == "user" and role else None
                head = f"<|im_start|>{kind}" + (f" name={name}" if name else "") + "\n"
                whole = head + (text or "") + "<|im_end|>\n"
                span = (len(head), len(whole) - 1) if role == who else (0, 0)
                want.append((conv, who, n, kind, name, whole, *span, role == who))
    assert got == sorted(want, key=str)
    whole = {(r.conv_id, r.perspective): r for r in chat_format.dialogues(frame).collect()}
    r = whole[1, "ann"]
    assert [r.text[a:b] for a, b in r.masks] == ["hi<|im_end|>"] and r.text.startswith("<|im_start|>system\nbe kind")
    r = whole[1, "bob"]
    assert [r.text[a:b] for a, b in r.masks] == ["yo é<|im_end|>"] * 2
    assert chat_format.rotated(spark.createDataFrame([], TURNS)).collect() == []


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_sound_and_whole_on_edited_copies():
    rng = random.Random(4)
    for _ in range(200):
        template = rng.sample(range(100), rng.randint(1, 30))
        text = [w for w in template if rng.random() > 0.1]
        for _ in range(rng.randint(0, 5)):
            text.insert(rng.randint(0, len(text)), 1000 + rng.randint(0, 3))
        pairs = license_scan.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert len(pairs) == longest_common(text, template)


def test_notices(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    edited = mit.replace("free of charge", "at no charge").replace("merge, ", "")
    texts = {1: f"é intro\n{mit}\nend", 2: edited, 3: "Released under the MIT License. x Released under the MIT licence! Released under the MIT License.",
             4: "license the under public general", 5: None, 6: "", 7: "word " * 50_000 + "This work is licensed under the GNU General Public License, version 3.",
             8: " ".join(mit.split()[::-1])}
    schema = "doc_id long, text string, license int, start string"
    frame = spark.createDataFrame([(i, t, 1, "") for i, t in texts.items()] + [(None, texts[1], 1, "")], schema)
    got = license_scan.notices(frame).collect()
    told = sorted((r.doc_id or 0, r.license, r.variant) for r in got)
    assert told == [(0, "MIT", 1), (1, "MIT", 1), (2, "MIT", 1), (3, "MIT", 0), (3, "MIT", 0), (7, "GPL-3.0", 0)]
    for r in got:
        span = texts[r.doc_id or 1].encode()[r.start : r.end].decode()
        assert span.split()[0] in ("Permission", "Released", "This") and (r.coverage == 1 or r.doc_id == 2)
    assert license_scan.notices(spark.createDataFrame([], schema)).collect() == []
