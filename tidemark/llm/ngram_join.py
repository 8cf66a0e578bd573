"""Exact Jaccard self-join of documents on word n-gram sets by T-occurrence search.

A document's set is its distinct word n-grams.  Two documents link when
``100 * |x & y| >= percent * |x | y|``.

1. *Classes.*  Documents with equal sets collapse to one class (any number of
   copies is one aggregated row), so copies never multiply work.
2. *Candidate blocks.*  Sets that link differ in few elements.  Each set is cut
   by hash into more parts than that difference allows, so linked sets agree
   on at least one whole part (pigeonhole).  A part without elements says nothing
   and is no key: a set with more parts in use than a link may differ in agrees
   with every partner on a part in use.  Sets with fewer are cut again by other
   hashes, and only those short in every cut key their empty parts, so no link is
   lost.  A slice of documents sends each of its distinct classes once per part,
   packed with others of the bucket, sixteen bytes each; copies never travel twice.
   Sets that share a part are then held apart by an exact bound: a parity sketch
   changes at most one bit per differing element, so more differing bits than the
   threshold allows elements rule a pair out.  What is left forms candidate
   blocks, connected components; a group of classes hands on a spanning forest
   of its pairs, never the pairs.  A group beyond `UNSKETCHED` classes takes the
   same test in pieces: first inside random pieces of it, then, where that and the
   other groups leave several components, between every two pieces.
3. *T-occurrence.*  Inside a block each set queries the inverted lists of the
   smaller ones: the rarest lists are heap-merged, the T-1 longest (DivideSkip)
   are only probed by binary search for the candidates that the merge found, and
   candidates reaching the overlap are links.
4. *Blocks of any size.*  A block is cut into size bands (only sets of sizes
   within the threshold can link): a band is the index, it and the next band
   query.  Bands beyond `block_rows` sets are dealt into several index shards,
   and every query of the band visits each of them.  Queries are dealt into blocks
   as well, so no task holds more than about `block_rows` indexed and as many
   asking sets, and no pair is lost.

Edge cases: null, empty and wordless texts have size 0 and link with nothing;
fewer than n words make one n-gram of the whole sequence; repeated rows are copies,
and rows that share an id but no set are documents of their own; a null id takes no part in the links and is its own component
(null); extra columns are ignored; an empty table gives an empty result.
Very long texts are hashed in numpy, whole.  N-grams are compared by 64-bit
hash, sets of one class by two sums of independently mixed hashes.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import store
from tidemark.llm import tokens as tk

U64 = tk.U64
LARGEST_SKETCH = 4096
UNSKETCHED = 2048
CUTS = 8


def step(percent: int) -> float:
    """Ratio of the size bands that share a number of parts; a linking partner is at most one band away."""
    return max(1.35, 100 / percent)


def document_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and the offsets of each text in them."""
    w = tk.words(column, tk.SPACE, fold=True)
    counts = w.counts
    full = np.maximum(counts - n + 1, 0)
    whole = tk.grams(w.hashes, n)[tk.ranges(w.first[:-1], full)]
    owner = np.repeat(np.arange(len(w)), full)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        one = np.zeros(len(short), U64)
        for j, d in enumerate(short):
            seq = w.hashes[w.first[d] : w.first[d + 1]]
            one[j] = tk.mix(tk.grams(seq, len(seq)) + U64(len(seq)))[0]
        whole, owner = np.concatenate([whole, one]), np.concatenate([owner, short])
    order = np.lexsort((whole, owner))
    whole, owner = whole[order], owner[order]
    fresh = np.ones(len(whole), bool)
    fresh[1:] = (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1])
    whole, owner = whole[fresh], owner[fresh]
    return whole, np.searchsorted(owner, np.arange(len(w) + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Wrapping sum of each run of values."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def set_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = _sums(tk.mix(values ^ U64(0xA0761D6478BD642F)), offsets)
    b = _sums(tk.mix(values ^ U64(0xE7037ED1A0B428DB)), offsets)
    return a.view(np.int64), b.view(np.int64)


def bands(size: np.ndarray, percent: int) -> np.ndarray:
    """(own, also): bands of size; `also` is the band below where a smaller partner may lie, else own."""
    own = np.floor(np.log(np.maximum(size, 1)) / math.log(step(percent)) + 1e-9).astype(np.int64)
    least = np.maximum(-(-percent * size // 100), 1)
    also = np.floor(np.log(least) / math.log(step(percent)) + 1e-9).astype(np.int64)
    return own, also


def parts_of_band(band: np.ndarray, percent: int) -> np.ndarray:
    """Parts that guarantee agreement: one more than the largest difference of a linking pair whose
    smaller set lies in the band, and a sixteenth more to make up for empty ones."""
    least = allowed(top_of_band(band, percent), top_of_band(band, percent) * 100 // percent, percent) + 1
    return least + np.where(least > 1, -(-least // 16), 0)


def top_of_band(band: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(step(percent) ** (band + 1) * (1 + 1e-9)).astype(np.int64) + 1


def allowed(size: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Most elements in which linking sets of these sizes differ."""
    return (size + other) * (100 - percent) // (100 + percent)


def part_keys(values: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document position, key) for the parts in use of every non-empty set, under each band it may meet in.

    A set that uses no more parts than it may differ in from a partner takes the
    next cut too; in the last one it keys its empty parts as well.
    """
    size = np.diff(offsets)
    own, also = bands(size, percent)
    docs, keys = [], []
    for band, largest, chosen in (
        (own, size * 100 // percent, size > 0), (also, top_of_band(also, percent), (size > 0) & (also != own))
    ):
        pick = np.flatnonzero(chosen)
        for cut in range(CUTS):
            if not len(pick):
                break
            k = parts_of_band(band[pick], percent)
            at = np.concatenate([[0], np.cumsum(k)])
            taken = tk.ranges(offsets[pick], size[pick])
            v = values[taken]
            of = np.repeat(np.arange(len(pick)), size[pick])
            slot = at[of] + (tk.mix(v ^ tk.mix(np.array([cut], U64))) % k[of].astype(U64)).astype(np.int64)
            sums = np.zeros(at[-1], U64)
            np.add.at(sums, slot, tk.mix(v ^ U64(0x8EBC6AF09C88C6E3)))
            used = np.bincount(slot, minlength=at[-1]) > 0
            short = np.add.reduceat(used, at[:-1], dtype=np.int64) <= allowed(size[pick], largest[pick], percent)
            doc = np.repeat(pick, k)
            part = tk.ranges(np.zeros(len(pick), np.int64), k)
            tag = tk.mix((band[doc].astype(U64) * U64(CUTS) + U64(cut)) * U64(1 << 40) + part.astype(U64))
            if cut == CUTS - 1:
                used |= np.repeat(short, k)
            docs.append(doc[used])
            keys.append(tk.mix(sums ^ tag)[used])
            pick = pick[short]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(keys).view(np.int64)


def sketch(values: np.ndarray, size: int) -> bytes:
    """Parity of the number of elements in each of a power-of-two number of bins; folding halves gives the smaller sketch."""
    bins = min(LARGEST_SKETCH, max(64, 1 << (size + size // 2).bit_length()))
    odd = np.bincount((values & U64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sketch) of every row."""

    def run(batches):
        for batch in batches:
            for piece in tk.slices(batch):
                values, offsets = document_sets(piece.column("text"), n)
                a, b = set_keys(values, offsets)
                mixed = tk.mix(values)
                parity = [sketch(mixed[i:j], j - i) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(a), pa.array(b), pa.array(parity, pa.binary())],
                    names=["doc_id", "n_shingles", "s1", "s2", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, s1 long, s2 long, sketch binary"
    )


PAIR = np.dtype([("key", "<i8"), ("cls", "<i8")])


def grouped(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, cls) pairs in order, and where each key begins."""
    pairs = pairs[np.lexsort((pairs["cls"], pairs["key"]))]
    new_key = np.ones(len(pairs), bool)
    new_key[1:] = pairs["key"][1:] != pairs["key"][:-1]
    fresh = new_key.copy()
    fresh[1:] |= pairs["cls"][1:] != pairs["cls"][:-1]
    return pairs[fresh], np.flatnonzero(new_key[fresh])


def parts(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, pairs, tied): per slice and bucket the packed (key, first class) pairs, and the pairs of further classes."""

    def run(batches):
        for batch in batches:
            for piece in tk.slices(batch):
                values, offsets = document_sets(piece.column("text"), n)
                cls, _ = set_keys(values, offsets)
                doc, key = part_keys(values, offsets, percent)
                pairs = np.empty(len(key), PAIR)
                pairs["key"], pairs["cls"] = key, cls[doc]
                pairs, begin = grouped(pairs)
                first = np.zeros(len(pairs), bool)
                first[begin] = True
                more = pairs[~first]
                pairs = pairs[first]
                bucket = (pairs["key"].view(U64) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                pairs, bucket = pairs[order], bucket[order]
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                extra = (more["key"].view(U64) % U64(buckets)).astype(np.int64)
                order = np.argsort(extra, kind="stable")
                more = more[order]
                extra_edge = np.searchsorted(extra[order], np.arange(buckets + 1))
                held = np.flatnonzero((np.diff(edge) > 0) | (np.diff(extra_edge) > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held), pa.array([pairs[edge[i] : edge[i + 1]].tobytes() for i in held], pa.binary()),
                     pa.array([more[extra_edge[i] : extra_edge[i + 1]].tobytes() for i in held], pa.binary())],
                    names=["bucket", "pairs", "tied"],
                )

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "bucket long, pairs binary, tied binary")


def shared_parts(packed: DataFrame) -> DataFrame:
    """(key, cls, classes) of every part that more than one class has, and how many have it."""

    def run(_, table):
        pairs, begin = grouped(np.frombuffer(b"".join(table.column("pairs").to_pylist() + table.column("tied").to_pylist()), PAIR))
        size = np.diff(np.append(begin, len(pairs)))
        size = np.repeat(size, size)
        kept = pairs[size > 1]
        return pa.table({"key": kept["key"].copy(), "cls": kept["cls"].copy(), "classes": size[size > 1]})

    return packed.groupBy("bucket").applyInArrow(run, "key long, cls long, classes long")


def fold(parity: bytes, words: int) -> np.ndarray:
    bits = np.frombuffer(parity, U64)
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def near_in_group(size: np.ndarray, parity: list[bytes], known: np.ndarray, percent: int) -> np.ndarray:
    """For each member the first member of its group that a chain of not-excluded pairs leads to; members
    of one known component are joined already."""
    words = min(map(len, parity)) // 8
    bits = np.stack([fold(p, words) for p in parity])
    _, first, root = np.unique(known, return_index=True, return_inverse=True)
    root = first[root]
    for i in range(len(size) - 1):
        rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        both = size[i] + size[rest]
        apart = np.bitwise_count(bits[i] ^ bits[rest]).sum(1, dtype=np.int64)
        fits = apart * (100 + percent) <= both * (100 - percent)
        if fits.any():
            joined = np.append(root[rest][fits], root[i])
            least = joined.min()
            root[np.isin(root, joined)] = least
        if not root.any():
            break
    return root


def candidate_edges(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest over each group of (key, cls, known, n_shingles, sketch) rows, of pairs the sketches do not exclude."""

    def run(_, table):
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        cls, size, known = (table.column(c).to_numpy() for c in ("cls", "n_shingles", "known"))
        parity = table.column("sketch").to_pylist()
        a, b = [], []
        for i, j in zip(begin.tolist(), np.append(begin[1:], len(key)).tolist()):
            who = order[i:j]
            root = near_in_group(size[who], [parity[w] for w in who], known[who], percent)
            tied = np.flatnonzero(root != np.arange(j - i))
            a.append(cls[who[tied]])
            b.append(cls[who[root[tied]]])
        edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def candidate_blocks(shared: DataFrame, classes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(node, root): components of the classes over the pairs of a common part that their sketches do not exclude."""
    bucket = F.pmod("key", F.lit(buckets))
    sketches = classes.select(F.col("s1").alias("cls"), "n_shingles", "sketch")
    # a group of any size is cut into pieces; pieces differ from part to part, so families of copies grow together
    large = F.col("classes") > UNSKETCHED
    cut = F.ceil(F.col("classes") * 2 / UNSKETCHED).cast("long")
    mine = F.pmod(F.xxhash64("key", "cls"), cut)
    pieces = shared.withColumn("key", F.when(large, F.xxhash64("key", mine)).otherwise(F.col("key")))
    groups = pieces.join(sketches, "cls").withColumns({"known": F.col("cls"), "bucket": bucket})
    edges = store.written(candidate_edges(groups, percent), "near")
    blocks = store.components(edges)
    if shared.where(large).isEmpty():
        return blocks
    rows = shared.where(large).join(blocks, F.col("cls") == F.col("node"), "left").select(
        "key", "cls", cut.alias("cut"), mine.alias("mine"), F.coalesce("root", "cls").alias("known"))
    apart = rows.groupBy("key").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("key")
    pairs = rows.join(apart, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1))).where("other != mine")
    pairs = pairs.withColumn("key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    across = pairs.select("key", "cls", "known").join(sketches, "cls").withColumn("bucket", F.col("key"))
    return store.components(edges.union(store.written(candidate_edges(across, percent), "across")))


def class_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cls, block, shard, part, query, grams) of the wanted (doc_id, cls, block, shard, part, query) rows."""

    def run(batches):
        for batch in batches:
            for piece in tk.slices(batch, limit=tk.SLICE_BYTES // 4):
                values, offsets = document_sets(piece.column("text"), n)
                sets = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
                rows = pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in ("cls", "block", "shard", "part", "query")] + [sets.cast(pa.list_(pa.int64()))],
                    names=["cls", "block", "shard", "part", "query", "grams"],
                )
                # an id may have other texts
                yield rows.filter(pa.array(set_keys(values, offsets)[0] == piece.column("cls").to_numpy()))

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (
        rows.join(wanted, "doc_id")
        .select("cls", "block", "shard", "part", "query", "text")
        .mapInArrow(run, "cls long, block long, shard long, part long, query boolean, grams array<long>")
    )


def t_occurrence(ids: np.ndarray, sets: list[np.ndarray], query: np.ndarray, percent: int, own: bool = True) -> list[tuple[int, int]]:
    """Links of one shard that join what is not yet joined; sets marked `query` ask, all others are indexed, and ask if `own`.

    Lists are visited rarest first.  A query with overlap bound T merges all but
    its T-1 longest lists with a heap and probes those for what the merge found.
    """
    size = np.array([len(s) for s in sets])
    order = np.lexsort((query, size))
    sets, size, query, ids = [sets[i] for i in order], size[order], query[order], ids[order]
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, term = np.unique(every, return_inverse=True)
    indexed = ~query[owner]
    postings = np.sort(term[indexed].astype(np.int64) * len(sets) + owner[indexed])
    length = np.bincount(term[indexed], minlength=int(term.max()) + 1)
    begin = np.concatenate([[0], np.cumsum(length)])
    at = np.concatenate([[0], np.cumsum(size)])
    parent = np.arange(len(sets))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for q in range(len(sets)) if own else np.flatnonzero(query).tolist():
        mine = term[at[q] : at[q + 1]]
        mine = mine[np.argsort(length[mine], kind="stable")]
        need = -(-percent * size[q] // 100)
        short, long = mine[: size[q] - need + 1], mine[size[q] - need + 1 :]
        lists = [postings[begin[t] : begin[t + 1]] - t * len(sets) for t in short]
        # sizes ascend, so a list's own order is by size: only smaller or equal sets of linkable size stay
        least = np.searchsorted(size, need)
        lists = [x[np.searchsorted(x, least) :] for x in lists]
        # a pure query follows indexed sets of its own size, an indexed one meets only those before it
        lists = [x[: np.searchsorted(x, q)].tolist() for x in lists]
        found: dict[int, int] = {}
        for r in heapq.merge(*[x for x in lists if x]):
            found[r] = found.get(r, 0) + 1
        mine_root = root(q)
        for r, count in found.items():
            other = root(r)
            if other == mine_root:
                continue
            bound = -(-percent * (size[q] + size[r]) // (100 + percent))
            if count + len(long) < bound:
                continue
            probe = long * len(sets) + r
            hit = np.searchsorted(postings, probe)
            count += int(np.count_nonzero(postings[np.minimum(hit, len(postings) - 1)] == probe))
            if 100 * count >= percent * (size[q] + size[r] - count):
                links.append((int(ids[q]), int(ids[r])))
                parent[other] = mine_root
    return links


def shard_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links found in each (block, shard, part); a shard without part is asked by its own sets."""

    def run(_, table):
        ids = table.column("cls").to_numpy()
        values = [np.asarray(x.values) for x in table.column("grams").combine_chunks()]
        query = table.column("query").to_numpy().astype(bool)
        links = t_occurrence(ids, values, query, percent, own=table.column("part").null_count > 0)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return sets.groupBy("block", "shard", "part").applyInArrow(run, "a long, b long")


def similar_components(
    docs: DataFrame, n: int = 3, percent: int = 90, block_rows: int = 4000
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text)."""
    return labelled(*linked(docs, n, percent, block_rows))


def linked(docs: DataFrame, n: int, percent: int, block_rows: int = 4000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, their classes, and links (a, b) that join each component of classes."""
    signed = store.written(signatures(docs, n), "signatures")
    classes = store.written(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")), "classes")
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = store.written(shared_parts(parts(docs, n, percent, buckets)), "shared")
    blocks = candidate_blocks(shared, classes, percent, buckets)
    members = blocks.join(classes, F.col("node") == F.col("s1")).select(
        F.col("least").alias("doc_id"), F.col("s1").alias("cls"), F.col("root").alias("block"), "n_shingles"
    )
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(step(percent)) + 1e-9)
    lower = F.floor(F.log(F.ceil(F.col("n_shingles") * percent / 100)) / math.log(step(percent)) + 1e-9)
    heavy = members.groupBy("block").agg(F.count("*").alias("rows"))
    members = members.join(heavy, "block").withColumns({"band": band, "lower": lower})
    # a small block is one shard; a large one is cut by band, and its bands into shards of about block_rows,
    # each of which meets its own sets, then every other shard of its band and of the next one as a part that asks
    own = {"part": F.lit(None).cast("long"), "query": F.lit(False)}
    small = members.where(F.col("rows") <= block_rows).withColumns({"shard": F.lit(0).cast("long")} | own)
    big = members.where(F.col("rows") > block_rows)
    wide = big.groupBy("block", "band").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("cut"))
    into = big.join(wide, ["block", "band"]).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("cut")))
    stays = into.withColumns({"shard": F.xxhash64("band", "mine")} | own)
    spread = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)))
    met = spread(into.where("cut > 1")).where("other != mine")
    asked = met.withColumns({"shard": F.xxhash64("band", "mine"), "part": F.xxhash64("band", "other"), "query": F.lit(False)})
    asks = met.withColumns({"shard": F.xxhash64("band", "other"), "part": F.xxhash64("band", "mine"), "query": F.lit(True)})
    home = F.xxhash64("band", "mine")
    under = into.where("lower < band").withColumn("part", home).drop("band", "cut").withColumnRenamed("lower", "band").join(wide, ["block", "band"])
    below = spread(under).withColumns({"shard": F.xxhash64("band", "other"), "query": F.lit(True)})
    upper = into.where("lower < band").select("block", F.col("lower").alias("band"), home.alias("part")).distinct()
    above = into.withColumn("shard", home).join(upper, ["block", "band"]).withColumn("query", F.lit(False))
    names = ["doc_id", "cls", "block", "shard", "part", "query"]
    wanted = small.select(*names)
    for rows in (stays, asked, asks, below, above):
        wanted = wanted.union(rows.select(*names))

    return signed, classes, store.written(shard_links(class_sets(docs, wanted, n), percent), "links")


def rooted_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with the root of their component."""
    groups = store.components(links)
    return classes.join(groups, F.col("s1") == F.col("node"), "left").withColumn("root", F.coalesce("root", "s1"))


def labelled(signed: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Each signed row with the smallest doc_id its class reaches over the links."""
    rooted = rooted_classes(classes, links)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("s1", "s2", "n_shingles", "component_id")
    lone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    return full.join(named, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", "component_id").union(lone)


def signed_rows(docs: DataFrame, n: int) -> DataFrame:
    """The rows with their size and set sums as __n, __s1 and __s2."""

    def run(batches):
        for batch in batches:
            for piece in tk.slices(batch):
                values, offsets = document_sets(piece.column("text"), n)
                sums = [np.diff(offsets), *set_keys(values, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *[pa.array(x) for x in sums]], names=[*piece.schema.names, "__n", "__s1", "__s2"]
                )

    longs = [T.StructField(c, T.LongType()) for c in ("__n", "__s1", "__s2")]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *longs]))


def one_of_each(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The rows of `docs` that stay when of each component only its smallest document does.

    Rows without words or id stay.  A document is an id with a set: of rows that share
    an id, those of different components each stay, of equal sets the first by text does.
    """
    signed, classes, links = linked(docs, n, percent)
    first = F.struct(F.col("least").alias("doc_id"), "s1", "s2")
    stay = store.written(rooted_classes(classes, links).groupBy("root").agg(F.min(first).alias("d")).select("d.*"), "stay")
    shared = store.written(signed.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared_ids")
    # an id that only one row has needs no second look at its text
    lone = docs.join(shared, "doc_id", "left_anti").where("doc_id IS NOT NULL")
    wordless = signed.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id")
    kept = lone.join(stay.select("doc_id").union(wordless), "doc_id", "left_semi")
    again = signed_rows(docs.join(shared, "doc_id", "left_semi").select(*docs.columns), n)
    named = stay.select(F.col("doc_id").alias("__id"), F.col("s1").alias("__a"), F.col("s2").alias("__b"))
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__s1") == F.col("__a")) & (F.col("__s2") == F.col("__b"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "__s1", "__s2").orderBy("text"))
    several = again.where("__n > 0").join(named, same, "left_semi").withColumn("__turn", turn).where("__turn = 1")
    blank = again.where("__n = 0")
    out = kept.select(*docs.columns)
    for rows in (several, blank, docs.where("doc_id IS NULL")):
        out = out.unionAll(rows.select(*docs.columns))
    return out
