"""Passages of benchmark items in documents, found by winnowed fingerprints.

Words are runs of ASCII letters and digits and of any non-ASCII characters,
lower-cased over A-Z.  A window is `span` consecutive item words; an item of
fewer words is one window.

1. *Winnowing.*  Every k-word gram is hashed and of every w consecutive hashes
   the least is kept; with w + k - 1 equal to `span` any shared window leaves a
   shared fingerprint, so nothing is missed.  An item of fewer words is its own
   fingerprint, sought among the grams of just its length; it thickens nobody else's.
2. *Screen.*  The benchmark's fingerprints set bits in a filter of fixed size.  A
   document none of whose fingerprints has its bit set is clean on the spot and
   never moves.  The others are written with the fingerprints that passed.
3. *Join.*  Those fingerprints meet the benchmark's.  The benchmark side is a
   written table of known size, so Spark broadcasts it below its own threshold and
   joins by shuffle beyond.
4. *Extension.*  Documents meet the items that share a fingerprint, and all
   windows of those items are laid on the whole document: every covered word is
   a hit.

Edge cases: null and empty texts have no words; items without words or id are
no items; repeated rows of either table count once each (items once per id and
text); rows are matched by a hash of id and text, so null and repeated ids are
safe; extra columns are ignored; an empty table on either side gives no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import store
from tidemark.llm import tokens as tk

U64 = tk.U64
FILTER_BITS = 1 << 24


def row_hash() -> Column:
    """What joins a document to its hits: equal for equal rows, safe for null and repeated ids."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def fingerprints(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the kept k-grams: the least (rightmost of equals) of every w consecutive ones of a text."""
    g = tk.grams(hashes, k)
    least = tk.sliding_min(g, w)
    span = w + k - 1
    counts = np.maximum(np.diff(first) - span + 1, 0)
    value = least[tk.ranges(first[:-1], counts)]
    owner = np.repeat(np.arange(len(counts)), counts)
    fresh = np.ones(len(value), bool)  # the same minimum is kept once while it stays the minimum
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], value[fresh].view(np.int64)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words): word hashes of every item that has words."""

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                w = tk.words(rows.column("text"), tk.NOT_ALNUM, fold=True)
                values = pa.LargeListArray.from_arrays(pa.array(w.first), pa.array(w.hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("item_id"), values.cast(pa.list_(pa.int64()))], names=["item_id", "words"]
                )

    kept = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return kept.distinct().mapInArrow(run, "item_id long, words array<long>").where("size(words) > 0")


def whole_grams(hashes: np.ndarray, first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every m-word gram, told apart from those of other lengths."""
    counts = np.maximum(np.diff(first) - m + 1, 0)
    value = tk.grams(hashes, m)[tk.ranges(first[:-1], counts)]
    return np.repeat(np.arange(len(counts)), counts), tk.mix(value + U64(m)).view(np.int64)


def item_fingerprints(items: DataFrame, span: int, k: int) -> DataFrame:
    """(print, item): every distinct fingerprint of every item's windows."""

    def run(batches):
        for batch in batches:
            first = np.concatenate([[0], np.cumsum(np.diff(batch.column("words").offsets.to_numpy()))])
            hashes = batch.column("words").flatten().to_numpy(zero_copy_only=False).view(tk.U64)
            found = [fingerprints(hashes, first, k, span - k + 1)]
            size = np.diff(first)
            for m in np.unique(size[size < span]).tolist():
                owner, value = whole_grams(hashes, first, m)
                own = size[owner] == m
                found.append((owner[own], value[own]))
            owner, value = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(value), batch.column("item").take(pa.array(owner))], names=["print", "item"])

    return items.mapInArrow(run, "print long, item long").distinct()


def filter_bits(prints: DataFrame) -> np.ndarray:
    """A filter of `FILTER_BITS` bits in which every fingerprint's low bits are set."""
    rows = prints.groupBy(F.shiftright(F.col("print").bitwiseAND(FILTER_BITS - 1), 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(print & 63 as int))")).alias("bits")
    ).toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()
    return bits.view(U64)


def passing(found: tk.Words, span: int, k: int, lengths: list[int], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of the documents' fingerprints whose bit is set."""
    every = [fingerprints(found.hashes, found.first, k, span - k + 1), *[whole_grams(found.hashes, found.first, m) for m in lengths]]
    out = []
    for owner, value in every:
        low = value.view(U64) & U64(FILTER_BITS - 1)
        there = (bits[low >> U64(6)] >> (low & U64(63))) & U64(1) == 1
        out.append((owner[there], value[there]))
    return tuple(np.concatenate(x) for x in zip(*out))


def lay_on(doc: np.ndarray, items: list[np.ndarray], span: int) -> tuple[np.ndarray, list[int]]:
    """(hit words of the document, positions of the items that have an occurring window)."""
    hit = np.zeros(len(doc) + 1, np.int64)
    seen: list[int] = []
    by_size: dict[int, np.ndarray] = {}
    for at, words in enumerate(items):
        m = min(span, len(words))
        if m > len(doc):
            continue
        if m not in by_size:
            by_size[m] = tk.grams(doc, m)
        where = np.flatnonzero(np.isin(by_size[m], tk.grams(words, m)))
        if len(where):
            seen.append(at)
            np.add.at(hit, where, 1)
            np.add.at(hit, where + m, -1)
    return np.cumsum(hit[:-1]) > 0, seen


def marked(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 4) -> DataFrame:
    """The columns of `docs` with `__hits`: struct(n_words, n_hit, items, spans).

    `spans` lists the byte ranges [from, to) of the hit words' runs in the UTF-8 text.
    """
    known = store.written(
        item_words(items).withColumn("item", F.xxhash64("item_id", "words")), "items")
    k = min(k, span)
    prints = store.written(item_fingerprints(known, span, k), "prints")
    lengths = sorted(r.m for r in known.select(F.size("words").alias("m")).where(F.col("m") < span).distinct().collect())  # under `span`
    bits = filter_bits(prints)
    names = docs.columns
    told = T.StructType.fromDDL("__hits struct<n_words: bigint, n_hit: bigint, items: array<bigint>, spans: array<array<bigint>>>")

    def suspects(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                found = tk.words(rows.column("text"), tk.NOT_ALNUM, fold=True)
                owner, value = passing(found, span, k, lengths, bits)
                order = np.argsort(owner, kind="stable")
                at, begin = np.unique(owner[order], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(owner)).astype(np.int32)), pa.array(value[order]))
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(at)).columns, lists], names=[*names, "__row", "__prints"])

    def others(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                found = tk.words(rows.column("text"), tk.NOT_ALNUM, fold=True)
                clean = np.ones(len(found), bool)
                clean[passing(found, span, k, lengths, bits)[0]] = False
                at = pa.array(np.flatnonzero(clean))
                n = pa.array(found.counts[clean])
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1, np.int32)), pa.array([], pa.int64()))
                nowhere = pa.ListArray.from_arrays(pa.array(np.zeros(len(at) + 1, np.int32)), pa.array([], pa.list_(pa.int64())))
                zero = pa.array(np.zeros(len(at), np.int64))
                hits = pa.StructArray.from_arrays([n, zero, none, nowhere], fields=list(HITS))
                yield pa.RecordBatch.from_arrays([*rows.take(at).columns, hits], names=[*names, "__hits"])

    fields = [*docs.schema.fields, T.StructField("__row", T.LongType()), T.StructField("__prints", T.ArrayType(T.LongType()))]
    suspected = store.written(docs.withColumn("__row", row_hash()).mapInArrow(suspects, T.StructType(fields)), "suspects")
    near = suspected.select(F.col("__row").alias("row"), F.explode("__prints").alias("print")).distinct().join(prints, "print")
    near = near.select("row", "item").distinct().join(known.select("item", "item_id", "words"), "item").groupBy("row").agg(
        F.collect_list(F.struct("item_id", "words")).alias("__near"))
    # hits grow with the corpus, so they are never sent whole to every task
    near = store.written(near, "near").withColumnRenamed("row", "__row").hint("merge")
    asked = suspected.join(near, "__row", "left")

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                found = tk.words(rows.column("text"), tk.NOT_ALNUM, fold=True)
                _, base = tk.raw(rows.column("text"))
                out = []
                near = rows.column("__near")
                for d in range(len(found)):
                    a, b = int(found.first[d]), int(found.first[d + 1])
                    if not near[d].is_valid:
                        out.append({"n_words": b - a, "n_hit": 0, "items": [], "spans": []})
                        continue
                    candidates = near[d].as_py()
                    hit, seen = lay_on(
                        found.hashes[a:b], [np.array(c["words"], np.int64).view(tk.U64) for c in candidates], span
                    )
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    spans = [
                        [int(found.starts[a + x] - base[d]), int(found.ends[a + y - 1] - base[d])]
                        for x, y in zip(edges[::2], edges[1::2])
                    ]
                    ids = sorted({candidates[i]["item_id"] for i in seen}, key=str)
                    out.append({"n_words": b - a, "n_hit": int(hit.sum()), "items": ids, "spans": spans})
                hits = pa.array(out, HITS)
                kept = [rows.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, hits], names=[*names, "__hits"])

    shown = T.StructType(docs.schema.fields + told.fields)
    laid = asked.select(*[F.col(f"`{c}`") for c in names], "__near").mapInArrow(run, shown)
    return docs.mapInArrow(others, shown).unionAll(laid)


HITS = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.list_(pa.int64())))]
)


def report(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """One row per document: words, hit words, and a digest of the items that occur in it."""
    found = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, span)
    listed = F.array_join(F.transform("__hits.items", lambda i: i.cast("string")), ",")
    return found.select(
        "doc_id", F.col("__hits.n_words").alias("n_words"), F.col("__hits.n_hit").alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        (F.col("__hits.n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """The documents without any hit, in their own columns."""
    return marked(docs, items, span).where("__hits.n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
