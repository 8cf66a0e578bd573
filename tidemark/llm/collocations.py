"""Phrases whose words keep company, mined per language by tiled counting of adjacent pairs.

Texts are cut into pieces at punctuation and line ends and pieces into words.  A
phrase of m + 1 words is a pair of overlapping phrases of m words, so one counting
pass a length, over pairs of what the pass before found frequent, yields all counts:

1. *Words.*  Occurrences per language, one aggregation; frequent ones go on.
2. *Ranks.*  The `RANKED` most frequent phrases of the last length get ids by falling
   frequency, the first `TILED` of them side by side per language.  All frequent
   phrases set a bit in a filter of fixed size.  Both are bounded and go to every task.
3. *Tiles.*  A pair of low ids lies in a tile of 256 x 256 cells.  A task adds crowded
   tiles up in dense arrays by bincount; all other pairs of ids are coordinates, one
   number each, that are sorted and counted, and so are pairs with a phrase that has no
   id, by its key.  Pairs with a phrase whose bit is not set cannot be frequent and are
   left out.  Tasks emit sums, not occurrences.
4. *Recursion.*  Sums meet by pair; pairs that are frequent are the phrases of the
   next length, are ranked again, and so on up to `longest` words.

Counts of every phrase's beginnings and ends travel with it, so scores need no
further join.  A phrase inside a longer frequent one that explains `share` percent of
it is dropped; of the longer ones only those of one word more need a look, since
they are at least as frequent as what contains them.

Edge cases: null and empty texts have no words and add nothing to n; a null
language is `und`; repeated rows count again; extra columns are ignored; an empty
table gives an empty result.  Words and phrases are counted by 64-bit hashes
of language and word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import store
from tidemark.llm import tokens as tk

U64 = tk.U64
RANKED = 1 << 20
TILED = 1 << 15  # ids, the most frequent ones, that lie in tiles
SIDE = 8  # bits of an id inside a tile
CELLS = 1 << 2 * SIDE
CROWDED = 2048  # pairs of a slice that open a dense tile
DENSE = 64  # dense tiles of a task
FILTER_BITS = 1 << 26
HELD = 1 << 19  # coordinates a task holds before it emits them

_BYTES = np.arange(256)
ENDS_PIECE = np.isin(_BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
DELIMITER = ENDS_PIECE | (_BYTES == 0x20) | (_BYTES == 0x09)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of the phrase whose first and last words but one are the phrases a and b."""
    return tk.mix(a * U64(0x9E3779B97F4A7C15) + tk.mix(b + U64(0x632BE59BD9B4E019)))


def read_words(rows: pa.RecordBatch) -> tuple[tk.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, text of each, key of each, whether the next word follows in the same piece)."""
    w = tk.words(rows.column("text"), DELIMITER, fold=True)
    owner = w.owner()
    lang = rows.column("lang_key").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    key = tk.mix(w.hashes + tk.mix(lang)[owner]) if len(owner) else w.hashes
    follows = np.zeros(len(owner), bool)
    if len(owner) > 1:
        marks = np.zeros(len(w.data) + 1, np.int32)
        np.cumsum(ENDS_PIECE[w.data], out=marks[1:])
        follows[:-1] = (marks[w.starts[1:]] == marks[w.ends[:-1]]) & (owner[1:] == owner[:-1])
    return w, owner, key, follows


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, lang, phrase, a): how often each word occurs in each language."""

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                w, owner, key, _ = read_words(rows)
                _, at, n = np.unique(key, return_index=True, return_counts=True)
                sizes = np.concatenate([[0], np.cumsum(w.ends[at] - w.starts[at])]).astype(np.int64)
                text = tk.strings(w.data, w.starts[at], w.ends[at])
                word = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(sizes), pa.py_buffer(text)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at].view(np.int64)), rows.column("lang").take(pa.array(owner[at])), word, pa.array(n)],
                    names=["key", "lang", "phrase", "a"],
                )

    counted = docs.mapInArrow(run, "key long, lang string, phrase string, a long")
    return counted.groupBy("key", "lang", "phrase").agg(F.sum("a").alias("a"))


class Coordinates:
    """Counts of pairs, kept sorted; at most `held` of them and a slice's."""

    def __init__(self, held: int):
        self.parts, self.rows, self.held = [], 0, held

    def add(self, a: np.ndarray, b: np.ndarray | None):
        """Pairs of keys, or numbers that stand for pairs where b is None."""
        if b is None:
            self.parts.append(np.unique(a, return_counts=True))
        else:
            key, at, n = np.unique(paired(a, b), return_index=True, return_counts=True)
            self.parts.append((key, n, a[at], b[at]))
        self.rows += len(self.parts[-1][0])

    def merged(self):
        key, n, *ends = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.parts = [(key[first], np.add.reduceat(n[order], first), *[e[order[first]] for e in ends])]
        self.rows = len(first)

    def emitted(self, all_: bool):
        if self.rows > self.held or all_ and self.rows:
            self.merged()
            if self.rows > self.held // 2 or all_:
                (part,), self.parts, self.rows = self.parts, [], 0
                yield part


class Ids:
    """Ids of keys through an index on their leading bits."""

    def __init__(self, ids: np.ndarray):
        self.order = np.argsort(ids)
        self.known = np.append(ids[self.order], U64(0))  # one past the last is never asked for
        self.shift = U64(64 - max(1, len(ids).bit_length()))
        self.first = np.searchsorted(ids[self.order], np.arange(1 << (64 - int(self.shift))).astype(U64) << self.shift)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The id of each key, -1 for none."""
        out = np.full(len(keys), -1, np.int64)
        rest, at, last = np.arange(len(keys)), self.first[(keys >> self.shift).astype(np.int64)], len(self.order)
        while len(rest):
            there = self.known[at]
            hit = (there == keys[rest]) & (at < last)
            out[rest[hit]] = self.order[at[hit]]
            on = np.flatnonzero((there < keys[rest]) & (at < last))
            rest, at = rest[on], at[on] + 1
        return out


class Tiles:
    """Counts of pairs of ids: crowded tiles are dense arrays, the rest stays with the caller."""

    def __init__(self, side: int, crowded: int):
        self.side, self.crowded, self.dense = side, crowded, {}

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Adds what falls into dense tiles and tells which pairs did not."""
        tile = (a >> SIDE) * self.side + (b >> SIDE)
        sizes = np.bincount(tile, minlength=self.side * self.side)
        for t in np.argsort(-sizes, kind="stable")[: DENSE].tolist():
            if sizes[t] >= self.crowded and t not in self.dense and len(self.dense) < DENSE:
                self.dense[t] = np.zeros(CELLS, np.int64)
        left = np.ones(len(a), bool)
        if not self.dense:
            return left
        slot = np.full(self.side * self.side, -1, np.int16)
        names = list(self.dense)
        slot[names] = np.arange(len(names))
        mine = slot[tile]
        order = np.argsort(mine, kind="stable")
        begin = np.searchsorted(mine[order], np.arange(len(names) + 1))
        cell = ((a & 255) << SIDE) | (b & 255)
        for i, t in enumerate(names):
            at = order[begin[i] : begin[i + 1]]
            if len(at):
                self.dense[t] += np.bincount(cell[at], minlength=CELLS)
        return mine < 0

    def emitted(self):
        for t, counts in self.dense.items():
            cell = np.flatnonzero(counts)
            yield (t // self.side << SIDE) + (cell >> SIDE), (t % self.side << SIDE) + (cell & 255), counts[cell]


def ranks(level: DataFrame, ranked: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order of id, filter bits of all keys): the most frequent phrases first."""
    top = level.select("key", F.xxhash64("lang").alias("lang"), "a").orderBy(F.desc("a"), "key").limit(ranked).toArrow()
    keys, lang, a = (top.column(c).to_numpy() for c in ("key", "lang", "a"))
    order = np.lexsort((keys, -a))
    low = order[:TILED]
    order[:TILED] = low[np.lexsort((np.arange(len(low)), lang[low]))]
    bit = F.col("key").bitwiseAND(FILTER_BITS - 1)
    words = level.groupBy(F.shiftright(bit, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(key & {FILTER_BITS - 1} & 63 as int))")).alias("bits")
    ).toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return keys[order].view(U64), bits.view(U64)


def pair_counts(
    docs: DataFrame, length: int, ids: np.ndarray, bits: np.ndarray, crowded: int = CROWDED, held: int = HELD
) -> DataFrame:
    """(left, right, a) of pairs of phrases of `length` words that start one word apart in a piece.

    Where both have ids, left is the pair as one number, i * len(ids) + j, and right is null.
    """
    side = max(1, -(-min(len(ids), TILED) >> SIDE))

    def run(batches):
        tiles, numbers, keyed, known = Tiles(side, crowded), Coordinates(held), Coordinates(held), Ids(ids)

        def out(a, b, n):
            right = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), right, pa.array(n)], names=["left", "right", "a"])

        for batch in batches:
            for rows in tk.slices(batch):
                _, _, key, follows = read_words(rows)
                whole = np.ones(len(key), bool)
                for _ in range(length - 1):
                    whole = whole[:-1] & follows[: len(whole) - 1] & whole[1:] if len(whole) > 1 else whole[:0]
                    key = paired(key[:-1], key[1:]) if len(key) > 1 else key[:0]
                if len(key) < 2:
                    continue
                low = key & U64(FILTER_BITS - 1)
                whole &= (bits[low >> U64(6)] >> (low & U64(63))) & U64(1) == 1
                at = np.flatnonzero(whole[:-1] & whole[1:] & follows[: len(whole) - 1])
                if not len(at):
                    continue
                used = np.zeros(len(key), bool)
                used[at] = used[at + 1] = True
                id_ = np.full(len(key), -1, np.int64)
                id_[used] = known.of(key[used])
                i, j = id_[at], id_[at + 1]
                both = (i >= 0) & (j >= 0)
                tiled = np.flatnonzero(both & (i < TILED) & (j < TILED))
                if len(tiled):
                    both[tiled] = tiles.add(i[tiled], j[tiled])
                    i[tiled[~both[tiled]]] = -2  # done
                if both.any():
                    numbers.add(i[both] * len(ids) + j[both], None)
                    for pair, n in numbers.emitted(False):
                        yield out(pair, None, n)
                bare = np.flatnonzero(((i == -1) | (j < 0)) & (i != -2))
                if len(bare):
                    keyed.add(key[at[bare]], key[at[bare] + 1])
                    for _, n, a, b in keyed.emitted(False):
                        yield out(a, b, n)
        for pair, n in numbers.emitted(True):
            yield out(pair, None, n)
        for _, n, a, b in keyed.emitted(True):
            yield out(a, b, n)
        for i, j, n in tiles.emitted():
            yield out(i * len(ids) + j, None, n)

    counted = docs.mapInArrow(run, "left long, right long, a long")
    return counted.groupBy("left", "right").agg(F.sum("a").alias("a"))


def named(counted: DataFrame, ids: np.ndarray) -> DataFrame:
    """(key, left, right, a): pairs of `pair_counts` by their keys."""

    def run(batches):
        for batch in batches:
            left = batch.column("left").to_numpy(zero_copy_only=False)
            bare = batch.column("right").is_valid().to_numpy(zero_copy_only=False)
            i = np.where(bare, 0, left)
            a = np.where(bare, left.view(U64), ids[i // len(ids)])
            b = np.where(bare, batch.column("right").fill_null(0).to_numpy(zero_copy_only=False).view(U64), ids[i % len(ids)])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x.view(np.int64)) for x in (paired(a, b), a, b)], batch.column("a")], names=["key", "left", "right", "a"]
            )

    return counted.mapInArrow(run, "key long, left long, right long, a long")


def phrases(
    docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000, scale: int = 2_000_000,
    ranked: int = RANKED, crowded: int = CROWDED, held: int = HELD,
) -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    `ranked`, `crowded` and `held` bound a task's memory; they never change the result.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    texts = texts.withColumn("lang_key", F.xxhash64("lang"))
    words = store.written(word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    none = F.lit(None).cast("long")
    level = words.where(F.col("a") >= least).select(
        "key", "lang", "phrase", "a", F.array("a").alias("pre"), F.array("a").alias("suf"), none.alias("left"), none.alias("right")
    )
    levels = [level]
    for length in range(1, longest):
        ids, bits = ranks(level, ranked)
        if not len(ids):
            break
        side = level.select("key", "lang", "phrase", "pre", "suf")
        counted = named(pair_counts(texts, length, ids, bits, crowded, held).where(F.col("a") >= least), ids)
        met = counted.join(side.select(F.col("key").alias("left"), "lang", F.col("phrase").alias("begins"), "pre"), "left")
        met = met.join(side.select(F.col("key").alias("right"), F.col("phrase").alias("ends"), "suf"), "right")
        last = F.substring_index("ends", " ", -1)
        level = store.written(
            met.select(
                "key", "lang", F.concat_ws(" ", "begins", last).alias("phrase"), "a",
                F.concat("pre", F.array("a")).alias("pre"), F.concat("suf", F.array("a")).alias("suf"), "left", "right",
            ),
            f"phrases{length + 1}",
        )
        levels.append(level)
    kept = [
        not_explained(level, levels[i + 2] if i + 2 < len(levels) else None, share) for i, level in enumerate(levels[1:])
    ]
    if not kept:
        kept = [level.limit(0)]
    every = kept[0]
    for more in kept[1:]:
        every = every.union(more)
    cuts = F.expr(
        f"""array_min(transform(sequence(1, size(pre) - 1), k -> named_struct(
              'score', (cast(a as decimal(20,0)) * cast({scale} as decimal(10,0)))
                       div cast(pre[k - 1] + suf[size(pre) - k - 1] as decimal(20,0)),
              'k', k, 'l', pre[k - 1], 'r', suf[size(pre) - k - 1])))"""
    )
    scored = every.select("lang", "phrase", "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def not_explained(level: DataFrame, longer: DataFrame | None, share: int) -> DataFrame:
    """Phrases without a phrase of one word more around them that has `share` percent of their count."""
    rows = level.select("key", "lang", "phrase", "a", "pre", "suf")
    if longer is None:
        return rows
    around = longer.select(F.explode(F.array("left", "right")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("most"))
    met = rows.join(around, "key", "left")
    exact = "decimal(24,0)"
    explained = F.col("most").cast(exact) * 100 >= F.col("a").cast(exact) * share
    return met.where(F.col("most").isNull() | ~explained).drop("most")


# Every phrase of one to four words listed and counted.
PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?\x0A-\x0D]') AS parts FROM documents),
listed AS (
  SELECT lang, doc, i, regexp_extract_all(parts[i], '[^ \t]+') AS w
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM pieces)),
runs AS (
  SELECT lang, m, array_to_string(w[j : j + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS j FROM listed), range(1, 5) s(m) WHERE j + m - 1 <= len(w)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30 OR m = 1),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, k, a.f AS l, b.f AS r,
         (2000000 * c.f::HUGEINT) // (a.f + b.f)::HUGEINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN counts a ON a.lang = c.lang AND a.phrase = array_to_string(c.w[1 : k], ' ') AND a.m = k
  JOIN counts b ON b.lang = c.lang AND b.phrase = array_to_string(c.w[k + 1 :], ' ') AND b.m = c.m - k),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(w[j : j + s - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT *, unnest(range(1, m + 1)) AS j FROM candidates), range(2, 4) t(s)
  WHERE s < m AND j + s - 1 <= m GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN inner_phrases i USING (lang, phrase)
  WHERE i.most IS NULL OR 100 * i.most < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
