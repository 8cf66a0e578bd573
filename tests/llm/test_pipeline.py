import zlib

import corpus_pipeline
import pyarrow.dataset as ds
import pytest
from plain import contaminated, first_copies_removed, jaccard_components

from tidemark.llm import registry, store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage gave, each from its predecessor's table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = store.written(stage(spark, docs, SF), name)
    return [*out, docs]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert set(after.items()) <= set(before.items()) and len(after) > 0.95 * len(before)


def test_near_duplicates(stages):
    before = texts(stages[1])
    want = {c for _, _, c in jaccard_components(list(before.items()), 5, 80)}
    assert texts(stages[2]) == {i: t for i, t in before.items() if i in want}


def test_repeated_passages(stages):
    before, after = texts(stages[2]), texts(stages[3])
    plain = {i: (lost, digest) for i, _, lost, digest in first_copies_removed(list(before.items()))}
    assert after.keys() == before.keys()
    for i, t in after.items():
        import hashlib

        assert t == before[i] if not plain[i][0] else hashlib.sha256(t.encode()).hexdigest() == plain[i][1]


def test_benchmark_passages(stages):
    before = texts(stages[3])
    bench = ds.dataset(f"{SF}/benchmark.parquet").to_table().to_pydict()
    hit = {r[0] for r in contaminated(list(before.items()), list(zip(bench["item_id"], bench["text"]))) if r[5]}
    assert texts(stages[4]) == {i: t for i, t in before.items() if i not in hit}


def test_packed(stages):
    from tokenizers import Tokenizer

    tokenizer, before = Tokenizer.from_file(registry.byte_tokenizer()), texts(stages[4])
    pieces = {}
    for r in stages[5].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == before.keys()
    for i, t in before.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for r in pieces[i]:
            part = b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])
            assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids)
        assert sum(r.length for r in pieces[i]) == len(ids)


def test_run_equals_its_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start)
    a = sorted(corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect(), key=key)
    assert a == sorted(stages[5].select("doc_id", "start", "length", "ids_crc32").collect(), key=key)
