import zlib

import numpy as np
import pytest

from tidemark.llm import language_id

ROWS = "doc_id long, text string, lang string, score string"
SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    got = language_id.report(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    test = [r for r in got if r.held_out]
    right = np.array([r.lang_pred == truth[r.doc_id] for r in test])
    score = np.array([r.score for r in test])
    assert right.mean() > 0.97
    assert ((0 <= score) & (score <= 1)).all()
    assert abs(right.mean() - score.mean()) < 0.05


def test_awkward_rows(spark):
    word = lambda i: "abcdefghij"[i % 10] + "klmnopq"[i % 7]
    rows = [(i, f"the and of with {word(i)}", "en", "x") for i in range(60)] + [(100 + i, f"der die das ü und ein {word(i)}", "de", "x") for i in range(60)]
    odd = [(500, None, "en", ""), (501, "", "en", ""), (502, "123 !!", "en", ""), (503, "und ein das", None, ""), (None, "the and with", "en", ""),
           (504, "the and " * 100_000, None, ""), (504, "the and", None, "")]
    got = language_id.report(spark.createDataFrame(rows + odd, ROWS)).collect()
    told = {}
    for r in got:
        told.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.held_out))
    assert all(told[i] == [("und", 0.0, zlib.crc32(str(i).encode()) % 3 == 1)] for i in (500, 501, 502))
    assert told[503][0][0] == "de" and told[None][0][0] == "en" and not told[None][0][2]
    assert [x[0] for x in told[504]] == ["en", "en"]
    assert language_id.accepted(spark.createDataFrame(rows + odd, ROWS)).columns == ["doc_id", "text", "lang", "score"]


@pytest.mark.parametrize("rows", [[], [(1, "some text", None, "")], [(2, None, "en", "")]])
def test_nothing_to_learn(spark, rows):
    got = language_id.report(spark.createDataFrame(rows, ROWS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(rows)


def test_l1_makes_weights_sparse():
    rng = np.random.default_rng(0)
    rows = [(["a", "b"][i % 2], np.sort(rng.choice(500, 20, replace=False)) + 500 * (i % 2), np.ones(20, int)) for i in range(200)]
    model = language_id.fit_sample(rows, np.ones(2048, np.float32))
    assert (model.weights[1000:] == 0).all()
    assert (np.abs(model.weights[:500]).sum(1) == 0).mean() > 0.02
    assert language_id.temperature(np.array([[4.0, 0.0]] * 100), np.array([0] * 70 + [1] * 30)) > 2
