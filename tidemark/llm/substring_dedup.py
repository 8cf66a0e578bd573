"""Repeated word windows across all documents, found by FM-index shards that only meet what can match.

A word goes if a window of `size` words that covers it, as a sequence, also
starts earlier: in a smaller doc_id, or earlier in the same document.

1. *Segments.*  Every window has a minimizer, the least hash of its `GRAM`-word
   grams (the first of equal ones).  Consecutive windows whose minimizer is the same
   place form a segment.  Equal windows have equal minimizers in the same relative
   place, so a minimizer with one segment in the corpus has nothing to compare; only
   segments of repeated ones stay.
2. *Classes.*  Segments with equal words collapse to one class with its earliest
   occurrence, so a passage that a third of all documents share is one row.
3. *FM-index per shard.*  Classes are dealt to shards by minimizer, and shards
   hold a bounded number of them.  Each builds a suffix order, a BWT in a wavelet
   matrix, and streams its windows through backward search; intervals with two
   rows or more are repeats, and the least place in an interval is the one that
   stays.
4. *Crowded minimizers.*  One minimizer may stand in very many different
   contexts (the edge of a common passage).  Past `crowded` classes its windows
   are compared by aggregating on their own hash instead, spread by that hash.
5. *Removal.*  Marked windows meet their documents again by id; each segment is
   verified against the words it was taken from.

Edge cases: null and empty texts have no words; shorter documents have no
windows; rows without id have no place in the order, so they keep their words
and count as nobody's earlier copy; rows that repeat an id are one document,
places in them compare by start; extra columns are ignored or, in `clean`, kept;
an empty table gives an empty result.  Words are compared by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import store
from tidemark.llm import tokens as tk
from tidemark.llm.fm_index import earlier_copies

U64 = tk.U64
GRAM = 5
LONGEST = 48  # windows in a segment; marks of a segment are the bits of one long
PLACES = 1 << 28  # words that one slice may have
SHARD_CLASSES = 30_000


def segments(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in the slice, windows, minimizer) of the segments of every text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    starts = tk.ranges(first[:-1], counts)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none
    g = tk.grams(hashes, GRAM)
    placed = (g & ~U64(PLACES - 1)) | np.arange(len(g), dtype=U64)  # of equal values the first is least
    least = tk.sliding_min(placed, size - GRAM + 1)[starts] & U64(PLACES - 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(least)))
    pieces = -(-length // LONGEST)
    at = np.repeat(begin, pieces) + tk.ranges(np.zeros(len(begin), np.int64), pieces) * LONGEST
    n = np.diff(np.append(at, len(least)))
    return owner[at], starts[at], n, g[least[at].astype(np.int64)].view(np.int64)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of hashes[start:end] for many runs."""
    powers, inverses = tk._powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(tk.mix(hashes) * powers[: len(hashes)], out=sums[1:])
    return tk.mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(U64)).view(np.int64)


def all_segments(docs: DataFrame, size: int) -> DataFrame:
    """(mini, cls, doc, at): `at` is the start in the document times 64 plus the number of windows."""

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                w = tk.words(rows.column("text"))
                owner, start, n, mini = segments(w.hashes, w.first, size)
                cls = run_hashes(w.hashes, start, start + n + size - 1)
                at = (start - w.first[owner]) * 64 + n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini), pa.array(cls), rows.column("doc").take(pa.array(owner)), pa.array(at)],
                    names=["mini", "cls", "doc", "at"],
                )

    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return named.mapInArrow(run, "mini long, cls long, doc long, at long")


def class_rows(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Words of the wanted (doc, mini, cls, at, crowded) segments, or their windows where crowded.

    Rows: (mini, cls, doc, at, words, windows): one of `words` (word hashes, eight
    bytes each) and `windows` (a hash per window) is null.
    """
    listed = wanted.groupBy("doc").agg(F.collect_list(F.struct("at", "mini", "cls", "crowded")).alias("wanted"))
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                w = tk.words(rows.column("text"))
                owner, asked = unlisted(rows.column("wanted"))
                start, n, good = located(w, owner, asked, size)
                asked, owner, start, n = asked.filter(pa.array(good)), owner[good], start[good], n[good]
                crowded = asked.field("crowded").to_numpy(zero_copy_only=False).astype(bool)
                blob, by_window = [], []
                window = run_hashes(w.hashes, np.arange(max(0, len(w.hashes) - size + 1)), np.arange(size, len(w.hashes) + 1)) \
                    if crowded.any() else None
                for s, k, c in zip(start.tolist(), n.tolist(), crowded.tolist()):
                    blob.append(None if c else w.hashes[s : s + k + size - 1].tobytes())
                    by_window.append(window[s : s + k] if c else None)
                yield pa.RecordBatch.from_arrays(
                    [asked.field("mini"), asked.field("cls"), rows.column("doc").take(pa.array(owner)), asked.field("at"),
                     pa.array(blob, pa.binary()), pa.array(by_window, pa.list_(pa.int64()))],
                    names=["mini", "cls", "doc", "at", "words", "windows"],
                )

    return named.join(listed, "doc").mapInArrow(
        run, "mini long, cls long, doc long, at long, words binary, windows array<long>"
    )


def unlisted(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each element, elements) of a list column; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def located(w: tk.Words, owner: np.ndarray, asked: pa.StructArray, size: int):
    """(start in the slice, windows, is it really there) of segments named by their place in a document."""
    at = asked.field("at").to_numpy(zero_copy_only=False)
    start, n = w.first[owner] + (at >> 6), at & 63
    end = start + n + size - 1
    good = end <= w.first[owner + 1]
    where = np.flatnonzero(good)
    same = run_hashes(w.hashes, start[where], end[where]) == asked.field("cls").to_numpy(zero_copy_only=False)[where]
    good[where[~same]] = False
    return start, n, good


def indexed(rows: DataFrame, size: int) -> DataFrame:
    """(mini, cls, bits): windows of each class that have an earlier equal window, by shard."""

    def run(_, table):
        mini, cls = table.column("mini").to_numpy(), table.column("cls").to_numpy()
        one = np.unique(np.stack([mini, cls], 1), axis=0, return_index=True)[1]  # rows that repeat a document
        doc, at = table.column("doc").to_numpy()[one], table.column("at").to_numpy()[one]
        words = table.column("words").combine_chunks()
        marks = earlier_copies([np.frombuffer(words[i].as_buffer(), U64) for i in one.tolist()], doc, at >> 6, size)
        lengths = np.array([len(m) for m in marks])
        offset = tk.ranges(np.zeros(len(lengths), np.int64), lengths)
        flat = np.concatenate(marks).astype(np.int64) << offset
        bits = np.bitwise_or.reduceat(flat, np.cumsum(lengths) - lengths)
        keep = bits != 0
        return pa.table({"mini": mini[one][keep], "cls": cls[one][keep], "bits": bits[keep]})

    return rows.groupBy("shard").applyInArrow(run, "mini long, cls long, bits long")


def repeats(docs: DataFrame, size: int, crowded: int = 20_000) -> DataFrame:
    """(doc, marks): list of struct(at, cls, bits) of segments with windows that start earlier elsewhere."""
    every = all_segments(docs, size)
    # written, so that both sides of the join are plain exchanges, whose hot keys Spark can split
    twice = store.written(every.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1").select("mini"), "twice")
    found = store.written(every.join(twice, "mini"), "segments")
    classes = found.groupBy("mini", "cls").agg(F.min(F.struct("doc", "at")).alias("low"), F.count("*").alias("n"))
    contexts = classes.groupBy("mini").agg(F.count("*").alias("contexts")).where(F.col("contexts") > crowded)
    classes = store.written(
        classes.join(contexts, "mini", "left")
        .select("mini", "cls", "n", "low.doc", "low.at", F.col("contexts").isNotNull().alias("crowded")), "classes")
    shards = max(1, -(-classes.count() // SHARD_CLASSES))
    rows = class_rows(docs, classes.select("doc", "mini", "cls", "at", "crowded"), size)
    rows = store.written(rows.withColumn("shard", F.pmod("mini", F.lit(shards))), "words")
    bits = indexed(rows.where("words IS NOT NULL").select("shard", "mini", "cls", "doc", "at", "words"), size)

    windows = rows.where("windows IS NOT NULL").select(
        "mini", "cls", "doc", (F.shiftright("at", 6)).alias("start"), F.posexplode("windows").alias("offset", "window")
    ).withColumn("place", F.struct("doc", F.col("start") + F.col("offset")))
    least = windows.groupBy("window").agg(F.min("place").alias("least"))
    spread = windows.join(least, "window").where("place != least").groupBy("mini", "cls").agg(
        F.expr("bit_or(shiftleft(1L, offset))").alias("bits"))
    bits = bits.union(spread)

    told = classes.select("mini", "cls", "n", F.struct("doc", "at").alias("low")).join(bits, ["mini", "cls"], "left")
    told = store.written(told.where("n > 1 OR bits IS NOT NULL").drop("n"), "told")
    everything = F.expr("shiftleft(1L, cast(at & 63 AS int)) - 1")
    marks = found.join(told, ["mini", "cls"]).select(
        "doc", "at", "cls", F.when(F.struct("doc", "at") == F.col("low"), F.coalesce("bits", F.lit(0).cast("long"))).otherwise(everything).alias("bits")
    )
    marks = marks.where("bits != 0").groupBy("doc").agg(F.collect_list(F.struct("at", "cls", "bits")).alias("marks"))
    return store.written(marks, "marks")


def removed(docs: DataFrame, size: int = 20) -> DataFrame:
    """The columns of `docs` with __n_words, __n_removed and __kept (kept words joined by one space)."""
    found = repeats(docs, size).select(F.col("doc").alias("__doc"), F.col("marks").alias("__marks"))
    named = docs.join(found, F.col("doc_id").cast("long") == F.col("__doc"), "left").select(
        *[docs[f"`{c}`"] for c in docs.columns], "__marks"
    )
    names = docs.columns

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                w = tk.words(rows.column("text"))
                gone = covered(w, rows.column("__marks"), size)
                counts = w.counts
                kept = ~gone
                lost = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) * (counts > 0) if len(counts) else counts
                text = tk.strings(w.data, w.starts[kept], w.ends[kept], b" ")
                # each kept word is followed by a space; a text ends before its last one
                size_of = np.where(kept, w.ends - w.starts + 1, 0)
                edge = np.concatenate([[0], np.cumsum(size_of)])[w.first]
                texts = pa.array([text[a : max(a, b - 1)].decode() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in names], pa.array(counts), pa.array(lost), texts],
                    names=[*names, "__n_words", "__n_removed", "__kept"],
                )

    told = T.StructType.fromDDL("__n_words long, __n_removed long, __kept string")
    return named.mapInArrow(run, T.StructType(docs.schema.fields + told.fields))


def covered(w: tk.Words, marks: pa.Array, size: int) -> np.ndarray:
    """Which words lie in a marked window."""
    owner, asked = unlisted(marks)
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    if len(owner):
        start, n, good = located(w, owner, asked, size)
        bits = asked.field("bits").to_numpy(zero_copy_only=False)
        start, n, bits = start[good], n[good], bits[good]
        which = np.repeat(np.arange(len(start)), n)
        offset = tk.ranges(np.zeros(len(start), np.int64), n)
        hit = (bits[which] >> offset) & 1 == 1
        begin = (start[which] + offset)[hit]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + size, -1)
    return np.cumsum(edge[:-1]) > 0


def report(docs: DataFrame, size: int = 20) -> DataFrame:
    """One row per document: words, removed words, and a digest of what is kept."""
    out = removed(docs.select("doc_id", "text"), size)
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__n_words").alias("n_words"),
        F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"),
    )


def clean(docs: DataFrame, size: int = 20) -> DataFrame:
    """The documents with repeated windows cut out; untouched texts stay as they are, n_chars follows the text."""
    out = removed(docs, size)
    cut = {"text": F.col("__kept"), "n_chars": F.char_length("__kept")}
    return out.select(*[
        F.when(F.col("__n_removed") > 0, cut[c].cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in cut else F.col(f"`{c}`") for c in docs.columns
    ])
