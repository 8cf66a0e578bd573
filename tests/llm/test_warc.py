import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import store, warc

PAGES = "page_id long, url string, html string, payload string, digest int"


def sample():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        html = f"<p>shared é {i % 4}</p>" if i % 3 == 0 else "<p>" + "x€" * rng.randint(0, 4000) + f"{i}</p>"
        rows.append((i, f"http://a/{i}?q=%20ü", html))
    rows += [(200, "u", ""), (201, None, None), (202, "a\r\nb  ", "tiny"), (203, "", "tiny"), (None, "n", "tiny"), (204, "x ", "\r\n\r\n")]
    return rows + [rows[3], (5, "other", "again")]


def report(rows, least=0):
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            best[p] = max(i, best.get(p, i))
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        w = best.get(p)
        again = i is not None and w is not None and len(p) >= least and i < w
        out.append((i, u, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", w if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    path = store.shared_folder(spark)
    warc.archive(spark, frame(spark, sample()), path, least)
    assert sorted((tuple(r) for r in warc.page_report(spark, path).collect()), key=str) == report(sample(), least)
    back = spark.read.format("warc").load(path).where("record_type = 'response'").select("record_id", "payload").collect()
    want = sorted((f"urn:page:{i}" if i is not None else "None", (h or "").encode()) for (i, _, h), r in
                  zip(sorted(sample(), key=str), sorted(sample(), key=str)))
    assert {(str(r.record_id), bytes(r.payload)) for r in back} <= set(want)


def test_pushed_predicates_leave_payloads_packed(spark):
    path = store.shared_folder(spark)
    warc.archive(spark, frame(spark, sample()), path)
    rows = spark.read.format("warc").load(path)
    assert rows.where("record_type = 'revisit'").count() == sum(r[4] == "revisit" for r in report(sample()))
    assert rows.where("record_id = 'urn:page:7'").count() == 1
    assert rows.where(F.col("record_id").isin("urn:page:7", "urn:page:8", "no")).count() == 2
    assert rows.where("refers_to IS NOT NULL AND payload_bytes > 3").count() > 0
    reader = warc.Reader(path, "full", 1 << 20)
    reader.wanted = [("record_id", frozenset(["urn:page:8"]))]
    seen = []
    real = warc.Member.payload
    warc.Member.payload = lambda self: seen.append(1) or real(self)
    try:
        got = [b for p in reader.partitions() for b in reader.read(p)]
    finally:
        warc.Member.payload = real
    assert sum(b.num_rows for b in got) == 1 and len(seen) == 1


def test_archives_are_plain_gzip(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.archive(spark, frame(spark, [(1, "u", "<p>hällo</p>")]), path)
    (name,) = (tmp_path / "w").glob("*.warc.gz")
    text = gzip.decompress(name.read_bytes()).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Record-ID: urn:page:1\r\n") and text.endswith("<p>hällo</p>\r\n\r\n")


def test_nothing(spark):
    path = store.shared_folder(spark)
    warc.archive(spark, frame(spark, []), path)
    assert warc.page_report(spark, path).collect() == []


def test_damaged_archive_is_refused(spark):
    row = {"record_id": "a", "record_type": "response", "uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": 3, "payload": b"abc"}
    import io

    blob = warc.record(row)
    member = warc.Member(io.BytesIO(blob[32:]), blob[:32])
    assert member.payload() == b"abc"
    with pytest.raises(EOFError):
        warc.Member(io.BytesIO(blob[32:40]), blob[:32])


def foreign(fields, block):
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": len(block)}.items())
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def others():
    """Records as other tools write them, and the rows that they are."""
    page = "<p>gé</p>" * 2000
    http = f"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n{page}".encode()
    digest = base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
    made = [
        ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:0>", "Content-Type": "application/warc-fields"}, b"software: any\r\n\r\n", b"software: any\r\n\r\n"),
        ({"warc-type": "request", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/ b", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b""),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:2>", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}, http, page.encode()),
        ({"WARC-Type": "metadata", "WARC-Record-ID": "<urn:uuid:3>"}, b"", b""),
        ({"WARC-Type": "resource", "WARC-Record-ID": "<urn:uuid:4>", "WARC-Payload-Digest": "md5:00", "Content-Type": "text/dns", "X-Long": "one\r\n  more"}, b"WARC/1.0\r\n\r\n" * 9, b"WARC/1.0\r\n\r\n" * 9),
        ({"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:5>", "Content-Type": "application/http"}, b"HTTP/1.1 204 No Content", b""),
        ({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:uuid:6>", "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\ncontent-length: 77\r\n\r\n", None),
    ]
    return [foreign(f, b) for f, b, _ in made], {f"<urn:uuid:{i}>": p for i, (_, _, p) in enumerate(made)}


@pytest.mark.parametrize("kind", ["plain", "members", "one", "mixed"])
def test_archives_of_others(spark, tmp_path, kind):
    made, want = others()
    own = warc.record({"record_id": "mine", "record_type": "response", "uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": 3, "payload": b"abc"})
    if kind == "plain":
        blob = b"".join(made)
    elif kind == "one":
        blob = gzip.compress(b"".join(made))
    else:
        blob = (own if kind == "mixed" else b"") + b"".join(map(gzip.compress, made))
    name = f"a.warc{'' if kind == 'plain' else '.gz'}"
    (tmp_path / name).write_bytes(blob)
    (tmp_path / "notes.txt").write_text("no archive")
    want = want | ({"mine": b"abc"} if kind == "mixed" else {})
    warc.register(spark)
    for path in (tmp_path, tmp_path / name):
        rows = spark.read.format("warc").option("partition_bytes", "300").load(str(path)).collect()
        assert {r.record_id: None if r.payload is None else bytes(r.payload) for r in rows} == want and len(rows) == len(want)
    by = {r.record_id: r for r in rows}
    assert by["<urn:uuid:6>"].payload_bytes == 77 and by["<urn:uuid:1>"].uri == "http://a/ b" and by["<urn:uuid:4>"].payload_digest == "md5:00"
    checked = spark.read.format("warc").option("payload", "verify").load(str(tmp_path)).where("record_type = 'response'")
    assert checked.count() == (3 if kind == "mixed" else 2)


def test_an_archive_is_read_in_ranges(spark, tmp_path):
    rows = [{"record_id": str(i), "record_type": "response", "uri": "u", "refers_to": None, "payload_digest": None, "payload_bytes": 0,
             "payload": random.Random(i).randbytes(i * 37 % 900) + warc.FIXED * (i % 3)} for i in range(300)]
    (tmp_path / "big.warc.gz").write_bytes(b"".join(map(warc.record, rows)))
    warc.register(spark)
    for size in (50, 1000, 40_000, 1 << 30):
        reader = warc.Reader(str(tmp_path), "full", size)
        parts = reader.partitions()
        got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted((int(r["record_id"]), r["payload"]) for r in got) == [(i, r["payload"]) for i, r in enumerate(rows)]
        assert len(parts) > 3 or size == 1 << 30
    back = spark.read.format("warc").option("partition_bytes", "9000").load(str(tmp_path))
    assert back.count() == 300 and back.rdd.getNumPartitions() > 3


def test_a_very_long_payload(spark):
    path = store.shared_folder(spark)
    rows = [(1, "u", "é" * 6_000_000), (2, "u", "short")]
    warc.archive(spark, frame(spark, rows), path)
    assert sorted(tuple(r) for r in warc.page_report(spark, path).collect()) == report(rows)


@pytest.mark.parametrize("blob", [b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort", b"hello\n", gzip.compress(b"<html>")])
def test_what_is_no_record_is_named(tmp_path, blob):
    (tmp_path / "x.warc").write_bytes(blob)
    reader = warc.Reader(str(tmp_path), "full", 1 << 20)
    with pytest.raises(ValueError, match="x.warc"):
        [b for p in reader.partitions() for b in reader.read(p)]
