"""Documents sorted into shards of near equal bytes by histogram sort, in DataFrame functions only.

1. *Keys.*  A row's place in the order is (h, d, r): 60 bits of the MD5 of its
   text, 60 bits of the MD5 of its doc_id, and its position in the scan, which only
   orders rows that are alike in both.  Equal texts follow each other, all else is
   shuffled.  These keys and the sizes are written once as a narrow table.
2. *Histogram.*  Every splitter has a target, a number of bytes below it.  A round
   lays evenly spaced probes over the key interval that still holds each target and
   counts the exact bytes between probes, one aggregation over the narrow table.
   The next interval is the occupied part of the bucket around the target, so an
   interval shrinks by the number of probes a round.  Where it has shrunk to one
   text the splitter goes to the nearer end of that text's rows if this is within
   `tolerance` of a shard, else on into the text's rows by d, then by r: a text
   that fills a third of the table is cut, a small group of copies is kept whole.
3. *One exchange.*  Shards are cut into pieces of about `piece_bytes` by further,
   looser splitters.  Every row goes straight to the task of its piece, is sorted
   there and written; a row's slot is its place in the piece plus the rows of the
   pieces before.

The driver holds splitters and probe counts only: at most `most_pieces` splitters,
a fixed number of probes each.  No shard or group of copies is ever one task.

Edge cases: a null text has no bytes and size 1, and nulls are equal texts; null
and repeated ids are rows like others; an empty table gives an empty result;
with fewer rows than shards some shards stay empty; a text larger than a shard
leaves its neighbours short.  Columns of the documents named shard or slot give way
to the new ones, others stay.  The documents are read twice and must be the same
rows in the same order both times, as files are; anything else is to be written first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store

PROBES = 64
LEVELS = ("h", "d", "r")
LEAST, MOST = -(1 << 62), 1 << 62
KEY = "struct<h:bigint,d:bigint,r:bigint>"


def digest(c: Column) -> Column:
    """60 bits of the MD5 of a string, -1 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long"), F.lit(-1))


def keys() -> Column:
    return F.struct(
        digest(F.col("text")).alias("h"), digest(F.col("doc_id").cast("string")).alias("d"),
        F.monotonically_increasing_id().alias("r"),
    )


def size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def filled(key: tuple, fill: int) -> dict:
    """A key of one to three parts with the missing ones set to `fill`."""
    return dict(zip(LEVELS, [*key, *[fill] * (3 - len(key))]))


def place(key: Column, table: Column, n: int) -> Column:
    """How many of the n ascending `low` keys of `table` are not above `key`, by halving."""
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    if not steps:
        return F.lit(0)
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda at, s: F.when(F.get(table, at + s - 1)["low"] <= key, at + s).otherwise(at),
    )


def literal(rows: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def counted(measured: DataFrame, open_: list) -> dict[int, list]:
    """Bytes between the probes of every open interval: {interval: [bucket rows in key order]}."""
    table = literal(
        [{"low": filled((*p, lo), LEAST), "high": filled((*p, hi), MOST), "level": len(p), "lo": lo, "width": w}
         for p, lo, hi, _, w, _ in open_],
        f"struct<low:{KEY},high:{KEY},level:int,lo:bigint,width:bigint>",
    )
    at = measured.withColumn("i", place(F.col("key"), table, len(open_)) - 1).where("i >= 0")
    at = at.withColumn("e", F.get(table, F.col("i"))).where("key <= e.high")
    this = F.when(F.col("e.level") == 0, F.col("key.h")).when(F.col("e.level") == 1, F.col("key.d")).otherwise(F.col("key.r"))
    inner = F.when(F.col("e.level") == 0, F.col("key.d")).otherwise(F.col("key.r"))
    at = at.withColumns({"this": this, "inner": inner})
    at = at.withColumn("bucket", F.floor((F.col("this") - F.col("e.lo")) / F.col("e.width")))
    rows = at.groupBy("i", "bucket").agg(
        F.sum("size").alias("bytes"), F.min("this").alias("lo"), F.max("this").alias("hi"),
        F.min("inner").alias("inner_lo"), F.max("inner").alias("inner_hi"),
    )
    out: dict[int, list] = {}
    for r in rows.collect():
        out.setdefault(r.i, []).append(r)
    return {i: sorted(found, key=lambda r: r.lo) for i, found in out.items()}


def splitters(measured: DataFrame, shards: int, tolerance: float, piece_bytes: int, most_pieces: int):
    """(keys at which pieces begin, ascending; pieces a shard); the first piece begins below all rows.

    Every `pieces`-th splitter begins a shard and is refined to the row; those
    between settle for a probe within a quarter of a piece.
    """
    ends = measured.agg(F.sum("size").alias("bytes"), F.min("key.h").alias("lo"), F.max("key.h").alias("hi")).first()
    if not ends.bytes:
        return [], 1
    total = int(ends.bytes)
    pieces = max(1, min(-(-total // (shards * piece_bytes)), most_pieces // shards))
    count = shards * pieces
    # positions are kept times `count`, so that targets are whole numbers
    todo = {((), ends.lo, ends.hi, 0): [(total * j, j % pieces == 0) for j in range(1, count)]}
    found = []
    while todo and count > 1:
        open_ = sorted(
            ((p, lo, hi, below, -(-(hi - lo + 1) // max(PROBES, 4 * len(wanted))), wanted)
             for (p, lo, hi, below), wanted in todo.items()),
            key=lambda x: list(filled((*x[0], x[1]), LEAST).values()),
        )
        todo = {}
        buckets = counted(measured, open_)
        for i, (prefix, _, _, below, _, wanted) in enumerate(open_):
            wanted = sorted(wanted)
            for row in buckets[i]:
                above = below + int(row.bytes)
                while wanted and wanted[0][0] < above * count:
                    target, exact = wanted.pop(0)
                    left, right = target - below * count, above * count - target
                    near = (*prefix, row.lo) if left <= right else (*prefix, row.hi + 1)
                    off = min(left, right)
                    one, last = row.lo == row.hi, len(prefix) == 2
                    if not exact:
                        done = 4 * off <= total
                    else:
                        done = one and off <= tolerance * total * pieces
                    if done or one and last:
                        found.append(near)
                    elif one:
                        todo.setdefault(((*prefix, row.lo), row.inner_lo, row.inner_hi, below), []).append((target, exact))
                    else:
                        todo.setdefault((prefix, row.lo, row.hi, below), []).append((target, exact))
                below = above
    return sorted(found, key=lambda k: list(filled(k, LEAST).values())), pieces


def shard_sorted(
    docs: DataFrame, shards: int = 16, tolerance: float = 0.001, piece_bytes: int = 32 << 20, most_pieces: int = 1 << 15
) -> DataFrame:
    """The rows of `docs` (doc_id, text and any others) with shard and slot, as a written table.

    Bytes below the first row of shard s are as near to s/shards of all bytes as a
    boundary between rows allows; within `tolerance` of a shard's bytes, a boundary
    between different texts is taken instead.
    """
    kept = [F.col(c) for c in docs.columns if c not in ("shard", "slot")]
    measured = store.written(docs.select(keys().alias("key"), size().alias("size")), "keys")
    begins, pieces = splitters(measured, shards, tolerance, piece_bytes, most_pieces)
    table = literal([{"low": filled(k, LEAST)} for k in begins], f"struct<low:{KEY}>")
    keyed = docs.select(F.struct(*kept).alias("doc"), keys().alias("key"))
    sent = keyed.withColumn("piece", place(F.col("key"), table, len(begins))).repartitionById(len(begins) + 1, F.col("piece"))
    ordered = sent.sortWithinPartitions("key").select(
        "doc", "piece", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")
    )
    sorted_rows = store.written(ordered, "shards")
    # at most `most_pieces` rows, one a piece
    counts = {int(r.piece): int(r.n) for r in sorted_rows.groupBy("piece").agg(F.count("*").alias("n")).collect()}
    before, rows = [], 0
    for p in range(len(begins) + 1):
        rows = 0 if p % pieces == 0 else rows
        before.append(rows)
        rows += counts.get(p, 0)
    offset = F.get(literal(before, "bigint"), F.col("piece"))
    return sorted_rows.select(
        "doc.*", F.floor(F.col("piece") / pieces).cast("int").alias("shard"), (F.col("at") + offset).alias("slot")
    )


def digests(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = shard_sorted(docs.select("doc_id", "text"), shards)
    return rows.select(
        "doc_id", size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


# The splitter next to each target by a running sum over the sorted rows; CRC-32 by its table over the bytes.
DIGESTS_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
keyed AS (
  SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size,
         coalesce(('0x' || md5(text)[:15])::BIGINT, -1) AS h,
         coalesce(('0x' || md5(doc_id::VARCHAR)[:15])::BIGINT, -1) AS d FROM documents),
summed AS (
  SELECT *, row_number() OVER o AS nr, sum(size) OVER o AS upto, sum(size) OVER () AS total FROM keyed
  WINDOW o AS (ORDER BY h, d ROWS UNBOUNDED PRECEDING)),
grouped AS (
  SELECT *, min(upto - size) OVER (PARTITION BY h) AS lo, max(upto) OVER (PARTITION BY h) AS hi,
         min(nr) OVER (PARTITION BY h) AS first_nr, max(nr) OVER (PARTITION BY h) AS last_nr FROM summed),
cuts AS (
  SELECT i, CASE WHEN 1000 * least(total * i - 16 * lo, 16 * hi - total * i) <= total
                 THEN CASE WHEN total * i - 16 * lo <= 16 * hi - total * i THEN first_nr ELSE last_nr + 1 END
                 WHEN total * i - 16 * (upto - size) <= 16 * upto - total * i THEN nr ELSE nr + 1 END AS begins
  FROM range(1, 16) s(i) JOIN grouped ON 16 * (upto - size) <= total * i AND total * i < 16 * upto),
placed AS (
  SELECT g.*, (SELECT count(*) FROM cuts WHERE begins <= g.nr) AS shard FROM grouped g)
SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
           lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)::BIGINT AS text_crc32,
       'bytes' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY nr) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed, crc
"""
