"""A random forest on counted cells.

Numbers come in at most 32 bins, so rows differ in few ways: rows of equal bins and
label are counted once, each tree draws how often it holds them (a sum of Poisson
draws is one Poisson draw of their number), and trees grow on (bins, weight, label
sum).  A tree's work follows the distinct cells, not the rows.

Nodes of more than `large` cells are split level by level by aggregations over all
trees; a smaller node is one group, in which the rest of its tree grows.  Both
follow one rule, so `large` does not change the result, and draws depend on bins,
label and seed only, so neither does the layout of the rows.

Labels are 0 and 1 or numbers.  Of 0 and 1 the variance is half the Gini impurity:
the same cuts win, and a leaf's mean is the share of the positive class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import landed

# Cells a task holds before it passes their sums on, cells that leave it at once, rows walked at once,
# parts that the rows of one cell are dealt to, and the least gain against the node's own sum that is not a rounding.
HELD_CELLS, SENT_CELLS, WALKED, PARTS, ROUNDING = 4_096, 256, 1_024, 8, 1e-12
SUMS = "tree int, bins array<tinyint>, w long, s double"
NODES = "tree int, node long, feature int, cut int, gain double, value double"


def bins(features: str = "features") -> Column:
    """The assembled bin codes as small whole numbers, which rows can be grouped by."""
    return vector_to_array(features).cast("array<tinyint>")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def drawn(batches: Iterator[pa.RecordBatch], trees: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Weight and label sum that each tree draws of each cell, as far as one task saw it."""
    held: dict[bytes, list[np.ndarray]] = {}

    def sent():
        keys = list(held)
        for i in range(0, len(keys), SENT_CELLS):
            some = keys[i : i + SENT_CELLS]
            w, s = (np.stack([held[k][j] for k in some]) for j in (0, 1))
            cell, tree = np.nonzero(w)
            codes = np.frombuffer(b"".join(some), np.int8).reshape(len(some), -1)[cell]
            lists = pa.ListArray.from_arrays(np.arange(len(cell) + 1, dtype=np.int32) * codes.shape[1], codes.ravel())
            columns = [pa.array(tree, pa.int32()), lists, pa.array(w[cell, tree]), pa.array(s[cell, tree])]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "bins", "w", "s"])
        held.clear()

    for batch in batches:
        codes = _matrix(batch.column("bins"))
        labels, rows, keys = (batch.column(c).to_pylist() for c in ("label", "n", "h"))
        for code, y, n, h in zip(codes, labels, rows, keys):
            count = np.random.Generator(np.random.Philox(key=(h % (1 << 64)) << 64 | seed)).poisson(n, trees)
            cell = held.setdefault(code.tobytes(), [np.zeros(trees, np.int64), np.zeros(trees)])
            cell[0] += count
            cell[1] += count * y
        if len(held) >= HELD_CELLS:
            yield from sent()
    yield from sent()


def picked(tree: int, node: int, features: int, tried: int) -> list[int]:
    """The features that a node tries: those of the least digests."""
    return sorted(sorted(range(features), key=lambda f: hashlib.md5(f"{tree},{node},{f}".encode()).hexdigest())[:tried])


def picked_column(features: int, tried: int) -> Column:
    digests = [F.struct(F.md5(F.concat_ws(",", "tree", "node", F.lit(str(f)))).alias("d"), F.lit(f).alias("f")) for f in range(features)]
    return F.slice(F.array_sort(F.array(*digests)), 1, tried)["f"]


def grown(tree: int, node: int, codes: np.ndarray, w: np.ndarray, s: np.ndarray, tried: int, least: int, depth: int) -> list[tuple]:
    """All nodes under one, as rows of NODES."""
    out, open_nodes, most = [], [(node, np.arange(len(w)))], int(codes.max()) + 1
    while open_nodes:
        node, at = open_nodes.pop()
        ws, ss = w[at], s[at]
        weight, total = ws.sum(), ss.sum()
        best = (0.0, None, None)
        if node.bit_length() <= depth and weight >= 2 * least:
            floor = ROUNDING * total * total / weight
            for f in picked(tree, node, codes.shape[1], tried):
                code = codes[at, f]
                wl, sl = np.bincount(code, ws, most).cumsum(), np.bincount(code, ss, most).cumsum()
                cuts = np.flatnonzero((wl >= least) & (weight - wl >= least))
                if len(cuts):
                    wl, sl = wl[cuts], sl[cuts]
                    gain = sl * sl / wl + (total - sl) ** 2 / (weight - wl) - total * total / weight
                    i = int(gain.argmax())
                    if gain[i] > max(best[0], floor):
                        best = (float(gain[i]), f, int(cuts[i]))
        gain, f, cut = best
        out.append((tree, node, f, cut, gain, float(total / weight)))
        if f is not None:
            right = codes[at, f] > cut
            open_nodes += [(2 * node, at[~right]), (2 * node + 1, at[right])]
    return out


def level(rows: DataFrame, features: int, tried: int, least: int, depth: int) -> DataFrame:
    """The best cut of every node of `rows` (tree, node, bins, w, s), as rows of NODES: `grown` for one level of any size."""
    sums = rows.select("tree", "node", "bins", "w", "s", F.explode(picked_column(features, tried)).alias("f"))
    sums = sums.groupBy("tree", "node", "f", F.get("bins", F.col("f")).cast("int").alias("bin")).agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    span = Window.partitionBy("tree", "node", "f")
    upto = span.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cuts = sums.select(
        "tree", "node", "f", "bin", F.sum("w").over(upto).alias("wl"), F.sum("s").over(upto).alias("sl"),
        F.sum("w").over(span).alias("wt"), F.sum("s").over(span).alias("st"),
    )
    wl, sl, wt, st = (F.col(c) for c in ("wl", "sl", "wt", "st"))
    gain = F.when(
        (F.length(F.bin("node")) <= depth) & (wl >= least) & (wt - wl >= least),
        sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) - st * st / wt,
    )
    best = cuts.withColumn("gain", gain).groupBy("tree", "node").agg(
        F.min(F.when(F.col("gain") > F.lit(ROUNDING) * st * st / wt, F.struct((-F.col("gain")).alias("loss"), "f", "bin"))).alias("b"),
        F.max(st / wt).alias("value"),
    )
    return best.select(
        "tree", "node", F.col("b.f").alias("feature"), F.col("b.bin").alias("cut"), F.coalesce(-F.col("b.loss"), F.lit(0.0)).alias("gain"), "value"
    )


class Forest(Estimator):
    """Fits on `features` (bin codes from 0 on) and `label`; `share` maps the number of features to the number a node tries."""

    def __init__(self, trees: int, least: int, depth: int, share, seed: int, large: int = 50_000):
        super().__init__()
        self.trees, self.least, self.depth, self.share, self.seed, self.large = trees, least, depth, share, seed, large

    def _fit(self, df: DataFrame) -> ForestModel:
        trees, least, depth, seed = self.trees, self.least, self.depth, self.seed
        counted = df.select(bins().alias("bins"), F.col("label").cast("double").alias("label")).groupBy("bins", "label").agg(F.count(F.lit(1)).alias("n"))
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as small rows are much work
        keyed = counted.withColumn("h", F.xxhash64("bins", "label"))
        parts = keyed.repartition(tasks, "bins", F.pmod("h", F.lit(PARTS))).mapInArrow(lambda batches: drawn(batches, trees, seed), SUMS)
        rows = landed(parts.groupBy("tree", "bins").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).withColumn("node", F.lit(1).cast("long")))
        first = rows.select(F.size("bins").alias("k")).first()
        if first is None:
            raise ValueError("no rows to grow a forest on")
        features, tried = first.k, self.share(first.k)
        done = []
        while True:
            large = rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") > self.large).select("tree", "node")
            if large.isEmpty():
                break
            split = landed(level(rows.join(large, ["tree", "node"], "left_semi"), features, tried, least, depth))
            done.append(split)
            cut = split.select("tree", "node", "feature", "cut", F.lit(True).alias("seen"))
            right = F.get("bins", F.col("feature")) > F.col("cut")
            moved = F.when(F.col("seen"), 2 * F.col("node") + right.cast("long")).otherwise(F.col("node"))
            met = rows.join(cut, ["tree", "node"], "left").where("seen is null or feature is not null")
            rows = landed(met.select("tree", "bins", "w", "s", moved.alias("node")))

        def rest(key, group):
            codes, w, s = _matrix(group.column("bins")), group.column("w").to_numpy(), group.column("s").to_numpy()
            found = grown(key[0].as_py(), key[1].as_py(), codes, w, s, tried, least, depth)
            names = [c.split()[0] for c in NODES.split(", ")]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

        nodes = rows.repartition(max(tasks, trees), "tree", "node").groupBy("tree", "node").applyInArrow(rest, NODES)
        for split in done:
            nodes = nodes.unionByName(split)
        return ForestModel(nodes.toArrow(), features)


class ForestModel(Model):
    """Nodes as arrays, in the order of (tree, node); `prediction` is the mean of the trees' leaves."""

    def __init__(self, nodes: pa.Table, features: int):
        super().__init__()
        nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
        tree, node = (nodes.column(c).to_numpy().astype(np.int64) for c in ("tree", "node"))
        place = (tree << 32) | node
        feature = nodes.column("feature").fill_null(-1).to_numpy()
        inner = feature >= 0
        left, right = np.zeros(len(node), np.int32), np.zeros(len(node), np.int32)
        left[inner] = np.searchsorted(place, ((tree << 32) | 2 * node)[inner])
        right[inner] = np.searchsorted(place, ((tree << 32) | 2 * node + 1)[inner])
        self.nodes = len(node)
        self.held = (np.flatnonzero(node == 1), feature, nodes.column("cut").fill_null(0).to_numpy(), left, right, nodes.column("value").to_numpy())
        gains = np.zeros((int(tree.max()) + 1, features))
        np.add.at(gains, (tree[inner], feature[inner]), nodes.column("gain").to_numpy()[inner])
        gains = gains[gains.sum(1) > 0]
        gains = (gains / gains.sum(1, keepdims=True)).sum(0)
        self.featureImportances = DenseVector(gains / max(gains.sum(), 1e-300))

    def _transform(self, df: DataFrame) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self.held)

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                yield pa.array(walked(_matrix(column), *held.value))

        return df.withColumn("prediction", F.arrow_udf(score, "double")(bins()))


def walked(codes: np.ndarray, roots, feature, cut, left, right, value) -> np.ndarray:
    """The mean leaf of each row of codes; rows that agree are walked once."""
    if not len(codes):
        return np.zeros(0)
    codes, back = np.unique(codes, axis=0, return_inverse=True)
    out = np.empty(len(codes))
    for i in range(0, len(codes), WALKED):
        some = codes[i : i + WALKED]
        at = np.repeat(roots[None, :], len(some), 0)
        row = np.arange(len(some))[:, None]
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            at = np.where(inner, np.where(some[row, f] > cut[at], right[at], left[at]), at)
        out[i : i + WALKED] = value[at].mean(1)
    return out[back.ravel()]
