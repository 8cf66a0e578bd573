"""Stretches of a text that repeat a block of words at least four times over, found and collapsed.

A run is a stretch of words with smallest period q and length of `LEAST` words and
`TIMES` periods or more that neither neighbour extends keeping period q.

1. *Zones.*  Where a run has period q, each word recurs q words later, and so does each
   `GRAM`-word gram.  A stretch that is long enough for its distances to earlier equal
   words (short periods) or grams (all others) is a zone; the rest holds no run.
2. *Suffix automaton.*  A zone's words build one.  In the tree of its suffix links the
   deepest node above two prefixes has their longest common ending's length.
3. *Link-cut access.*  Every prefix in turn accesses its path to the root; the path is
   then coloured with its end.  Where the path crosses a segment coloured by an
   earlier end j, the joining node's length L is what ends i and j have in common, and
   j is the last place where that occurs.  i - j <= L is a square; L of three times i - j
   and a next word that breaks the period are a run's end, whose start is j - L + 1.
4. *Extension.*  Runs are extended in the whole text, as a zone may cut one, and listed once.

A zone of more than `BLOCK` words is read in overlapping blocks, which hold every run of
a period up to an eighth of a block.  Longer periods are sought in the zone's content-cut
chunks, a shorter word sequence that repeats where the words do, by the same search,
and verified in the words.  Chunks begin at the least of the grams that are new within
`CHUNK` words, and at the edges of long runs of short periods, which have no new
grams.  So memory follows a block or a text.  Only a zone with long stretches that have
no new gram and yet no period goes through one automaton whole.

Edge cases: null and empty texts have no words and no runs; repeated ids and rows are
rows like others; with a null id nothing is rewritten in `digests`; extra columns are
ignored, or kept by `collapsed`; an empty table gives an empty result.  Words are
compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens as tk

U64 = tk.U64
LEAST, TIMES = 6, 4
SHORT = 8  # periods up to here are seen word by word
GRAM = 8
BLOCK = 1 << 16
CHUNK = 32  # grams among which the least one begins a chunk
PLACES = 1 << 28


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, state of each prefix) of the suffix automaton."""
    step, link, length, ends, last = [{}], [-1], [0], [], 0
    for c in symbols:
        now = len(length)
        length.append(length[last] + 1)
        step.append({})
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                step.append(step[q].copy())
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
        ends.append(now)
    return link, length, ends


def repeats(symbols: list[int], times: int, least: int) -> list[tuple[int, int]]:
    """(end, period) of every run of `times` periods and `least` symbols, the end being its last symbol."""
    link, length, ends = automaton(symbols)
    size, n = len(length), len(symbols)
    up, low, high = link[:], [-1] * size, [-1] * size  # splay trees by depth; a root's `up` leads to the path above
    colour = [-1] * size  # of a path, at its splay root
    out = []

    def rotate(x, p):
        g = up[p]
        if low[p] == x:
            low[p] = b = high[x]
            high[x] = p
        else:
            high[p] = b = low[x]
            low[x] = p
        if b != -1:
            up[b] = p
        up[p], up[x] = x, g
        if g != -1:
            if low[g] == p:
                low[g] = x
            elif high[g] == p:
                high[g] = x

    def splay(x):
        p = up[x]
        while p != -1 and (low[p] == x or high[p] == x):
            g = up[p]
            if g != -1 and (low[g] == p or high[g] == p):
                colour[x] = colour[g]
                if (low[g] == p) == (low[p] == x):
                    rotate(p, g)
                else:
                    rotate(x, p)
            else:
                colour[x] = colour[p]
            rotate(x, up[x])
            p = up[x]

    for i, x in enumerate(ends):
        below, v = x, up[x]
        while v != -1:
            if up[v] != -1:
                splay(v)
            j, common = colour[v], length[v]
            period = i - j
            if j >= 0 and common >= (times - 1) * period and common + period >= least:
                if i + 1 == n or symbols[i + 1] != symbols[i + 1 - period]:
                    out.append((i, period))
            rest = high[v]
            if rest != -1:
                colour[rest] = j
            high[v] = below
            below, v = v, up[v]
        if below != x:
            splay(x)
        colour[x] = i
    return out


def numbered(hashes: np.ndarray) -> list[int]:
    return np.unique(hashes, return_inverse=True)[1].tolist()


def chunks(hashes: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts of content-cut chunks, hash of each but the last): the least new gram of `CHUNK` on either side, and `edges`."""
    g = tk.grams(hashes, GRAM)
    order = np.argsort(g, kind="stable")
    fresh = np.ones(len(g), bool)
    near = (g[order[1:]] == g[order[:-1]]) & (order[1:] - order[:-1] <= CHUNK)
    fresh[order[1:][near]] = False
    most = U64(0xFFFFFFFFFFFFFFFF)
    value = np.where(fresh, g, most)
    least = tk.sliding_min(np.concatenate([np.full(CHUNK, most), value, np.full(CHUNK, most)]), CHUNK)
    first = fresh & (value < least[: len(g)]) & (value <= least[CHUNK + 1 : CHUNK + 1 + len(g)])
    at = np.unique(np.concatenate([np.flatnonzero(first), np.array(edges, np.int64)]))
    powers, inverses = tk._powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(tk.mix(hashes) * powers[: len(hashes)], out=sums[1:])
    return at, tk.mix((sums[at[1:]] - sums[at[:-1]]) * inverses[at[:-1]] + np.diff(at).astype(U64))


def sought(hashes: np.ndarray, block: int, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """(a place inside, period) of all runs; some may be listed more than once, some too short."""
    n = len(hashes)
    if n <= block:
        return repeats(numbered(hashes), times, least)
    out, long_ = [], {}
    for begin in range(0, n - block // 2, block // 2):
        for i, p in repeats(numbered(hashes[begin : begin + block]), times, least):
            place = begin + i
            out.append((place, p))
            if not any(s + p <= place < e for s, e in long_.get(p, ())):
                s, e = extended(hashes, place, p)
                if e - s >= block // 8:
                    long_.setdefault(p, []).append((s, e))
    covered = sorted(span for spans in long_.values() for span in spans)
    at, symbols = chunks(hashes, [min(x, n) for span in covered for x in span])
    ends = np.concatenate([[0], at, [n]])
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a > block // 4 and not any(s <= a and b <= e for s, e in covered):
            return out + repeats(numbered(hashes), times, least)
    for i, p in sought(symbols, block, 3, 3):  # chunks at a run's edges may differ, so a run has almost its periods
        out.append((int(at[i]), int(at[i + 1] - at[i + 1 - p])))
    return out


def matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values agree."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        stop = min(at + step, n)
        differ = np.flatnonzero(a[at:stop] != b[at:stop])
        if len(differ):
            return at + int(differ[0])
        at, step = stop, step * 4
    return n


def extended(hashes: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """[start, end) of the longest stretch with the period whose second word of a pair may be `place`."""
    end = place + matching(hashes[place:], hashes[place - period :])
    back = matching(hashes[:place][::-1], hashes[: place - period][::-1])
    return place - period - back, end


def runs(hashes: np.ndarray, zones: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """(start, length, period) rows by start, then period, of one text's runs, all of which lie in its zones."""
    found: dict[tuple[int, int], int] = {}
    for begin, end in zones.tolist():
        for place, period in sought(hashes[begin:end], block):
            s, e = extended(hashes, begin + place, period)
            if e - s >= max(LEAST, TIMES * period):
                found[s, e] = min(period, found.get((s, e), period))
    rows = sorted((s, p, e - s) for (s, e), p in found.items())
    return np.array([(s, m, p) for s, p, m in rows], np.int64).reshape(-1, 3)


def stretches(at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the stretches of `least` or more consecutive numbers in ascending `at`."""
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
    long_ = last - first + 1 >= least
    return at[first[long_]], at[last[long_]]


def all_zones(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) in the slice's words: disjoint, ascending, each inside one text; every run lies in one."""
    h, n = w.hashes, len(w.hashes)
    begins, ends = [], []
    text_end = np.repeat(w.first[1:], w.counts)
    text_begin = np.repeat(w.first[:-1], w.counts)
    for q in range(1, min(SHORT, n - 1) + 1):
        same = np.flatnonzero((h[q:] == h[:-q]) & (text_end[:-q] == text_end[q:]))
        first, last = stretches(same, max((TIMES - 1) * q, LEAST - q))
        begins.append(first)
        ends.append(last + q + 1)
    if n >= GRAM:
        g = tk.grams(h, GRAM)
        g[text_end[: len(g)] < np.arange(len(g)) + GRAM] = 0  # crossing texts
        order = np.argsort(g, kind="stable")
        near = np.flatnonzero((g[order[1:]] == g[order[:-1]]) & (text_end[order[1:]] == text_end[order[:-1]]) & (g[order[1:]] != 0))
        at, before = order[near + 1], order[near]
        by = np.argsort(at)
        at, far = at[by], (at - before)[by]
        low, longest = SHORT, int(w.counts.max(initial=0)) // TIMES
        while low < longest and len(at):
            high = low + max(1, low // 4)  # periods over low and up to high
            first, last = stretches(at[far <= high], (TIMES - 1) * (low + 1) - GRAM + 1)
            begins.append(np.maximum(first - high, text_begin[first]))
            ends.append(last + GRAM)
            low = high
    if not begins or not sum(map(len, begins)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] >= reach[:-1]) | (text_end[begin[1:]] != text_end[begin[:-1]])
    at = np.flatnonzero(fresh)
    return begin[at], reach[np.append(at[1:] - 1, len(reach) - 1)]


def text_runs(w: tk.Words, block: int = BLOCK) -> list[np.ndarray]:
    """The runs of every text of a slice, word numbers counting from the text's first word."""
    begin, end = all_zones(w)
    by_text = np.searchsorted(begin, w.first)
    none = np.zeros((0, 3), np.int64)
    out = []
    for t in range(len(w)):
        a, b = by_text[t], by_text[t + 1]
        if a == b:
            out.append(none)
            continue
        base = w.first[t]
        zones = np.stack([begin[a:b], end[a:b]], axis=1) - base
        out.append(runs(w.hashes[base : w.first[t + 1]], zones, block))
    return out


def kept_words(w: tk.Words, found: list[np.ndarray]) -> np.ndarray:
    """False for words that a run contains after its first period."""
    change = np.zeros(len(w.hashes) + 1, np.int64)
    for t, rows in enumerate(found):
        if len(rows):
            np.add.at(change, w.first[t] + rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, w.first[t] + rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(change)[:-1] == 0


def joined(w: tk.Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of all texts, each followed by a space, and where each text's begin."""
    at = np.flatnonzero(keep)
    sizes = np.concatenate([[0], np.cumsum(w.ends[at] - w.starts[at] + 1)])
    return tk.strings(w.data, w.starts[at], w.ends[at], b" "), sizes[np.searchsorted(at, w.first)]


def looped(w: tk.Words, marks: list[int | None]) -> tk.Words:
    """The words of texts whose mark ends in 0 with their tail replaced by repetitions of its first words."""
    source = np.arange(len(w.hashes))
    for t, h in enumerate(marks):
        n = int(w.counts[t])
        if h is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[w.first[t] + a : w.first[t + 1]] = w.first[t] + a + np.arange(n - a) % p
    return tk.Words(w.data, w.starts[source], w.ends[source], w.hashes[source], w.first)


def listed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text."""

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                found = text_runs(tk.words(rows.column("text")), block)
                of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                table = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(of), *[pa.array(np.ascontiguousarray(table[:, i])) for i in range(3)]],
                    names=["doc_id", "start", "length", "period"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, period long")


def collapsed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows with runs reduced to their first period; texts without a run stay as they are."""

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                w = tk.words(rows.column("text"))
                found = text_runs(w, block)
                text, begin = joined(w, kept_words(w, found))
                cut = [text[begin[t] : begin[t + 1] - 1].decode() if len(f) else None for t, f in enumerate(found)]
                whole = rows.column("text").to_pylist()
                new = pa.array([c if c is not None else t for c, t in zip(cut, whole)], rows.column("text").type)
                yield rows.set_column(rows.schema.get_field_index("text"), rows.schema.field("text"), new)

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Longest run and digests of the runs and of the collapsed words of every text, tails looped as the contract says."""
    marked = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("mark"))

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch):
                w = looped(tk.words(rows.column("text")), rows.column("mark").to_pylist())
                found = text_runs(w, block)
                text, begin = joined(w, kept_words(w, found))
                view = memoryview(text)
                best, lists, kept = [], [], []
                for t, f in enumerate(found):
                    longest = min(f.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
                    best.append(longest or [None] * 3)
                    lists.append(hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in f.tolist()).encode()).hexdigest())
                    kept.append(hashlib.sha256(view[begin[t] : max(begin[t], begin[t + 1] - 1)]).hexdigest())
                start, length, period = (pa.array([b[i] for b in best], pa.int64()) for i in range(3))
                milli = pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), start, length, period, milli,
                     pa.array(lists, pa.string()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(
        run,
        f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string",
    )
