"""Language identification: sparse multinomial logistic regression over TF-IDF character n-grams.

* Features: lower-cased letters, anything else a single space; n-grams of one to
  `LONGEST` characters, hashed into `dimensions` slots; log term frequency times
  inverse document frequency, unit length.
* Document frequencies: counted over all labelled training rows.
* Fit: follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties,
  on a sample of at most `sample_rows` labelled rows, balanced over languages
  (the documented bound; the rest of the labelled rows only count for the
  document frequencies).
* Temperature: one scalar, fitted on a fifth of the sample that the weights do
  not see, makes scores probabilities.
* Prediction: every whole text, in numpy, in the tasks that read it.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is
every text when nothing is labelled.  Null labels are not learned from.  Null
and repeated ids are rows like others; other columns are ignored (`predict`) or
kept (`accepted`); an empty table gives an empty result.  Very long texts are
read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import store
from tidemark.llm import tokens as tk

UNKNOWN = "und"
LONGEST = 4
DIMENSIONS = 1 << 15
SAMPLE_ROWS = 4_000

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> itself for letters, else a space; made once per worker."""
    if not _LETTERS:
        table = np.full(0x110000, 0x20, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = c
        _LETTERS.append(table)
    return _LETTERS[0]


def has_letter(data: bytes) -> bool:
    return any(c.isalpha() for c in data.decode())


def features(data: bytes, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the n-grams of one UTF-8 text."""
    points = np.frombuffer(data.decode().lower().encode("utf-32-le"), np.uint32)
    c = _letters()[points]
    blank = c == 0x20
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    c = np.concatenate([[np.uint32(0x20)], c[keep], [np.uint32(0x20)]]).astype(np.uint32)
    counts = np.zeros(dimensions, np.int64)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, LONGEST + 1):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ c[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        counts += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - int(math.log2(dimensions))), minlength=dimensions)
    slots = np.flatnonzero(counts)
    return slots, counts[slots]


def weighted(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[slots]
    return (x / (np.sqrt(x @ x) or 1.0)).astype(np.float32)


@dataclass
class Model:
    """Languages, inverse document frequencies, weights [dimensions, languages], intercepts, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighted(slots, counts, self.idf) @ self.weights[slots] + self.bias

    def predict(self, data: bytes) -> tuple[str, float]:
        if not self.languages or not has_letter(data):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*features(data, len(self.idf))) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for softmax regression: per-coordinate rates, elastic-net closed-form weights."""

    def __init__(self, dimensions: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((dimensions + 1, classes))  # the last slot is the intercept
        self.n = np.zeros((dimensions + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(slots.astype(np.int64), len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        slope = softmax(x @ w)
        slope[label] -= 1
        g = x[:, None] * slope
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The scale of the logits with the least log loss, by golden section on its logarithm."""

    def loss(t):
        x = logits / math.exp(t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(labels)), labels]).mean())

    a, b, r = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    for _ in range(40):
        if loss(c) < loss(d):
            b, d = d, c
            c = b - r * (b - a)
        else:
            a, c = c, d
            d = a + r * (b - a)
    return math.exp((a + b) / 2)


def fit_sample(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 3) -> Model:
    """The model of a bounded list of (language, slots, counts), in the order given."""
    languages = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    inputs = [(number[lang], slots, weighted(slots, counts, idf)) for lang, slots, counts in rows]
    kept, unseen, seen = [], [], [0] * len(languages)
    for r in inputs:  # every fifth row of a language is for the temperature
        seen[r[0]] += 1
        (unseen if seen[r[0]] % 5 == 0 else kept).append(r)
    learner = Ftrl(len(idf), len(languages), alpha=0.5, beta=1.0, l1=0.05, l2=0.5)
    for _ in range(epochs):
        for label, slots, x in kept:
            learner.learn(slots, x, label)
    w = learner.weights(slice(None))
    model = Model(languages, idf, w[:-1].astype(np.float32), w[-1], 1.0)
    if unseen and len(languages) > 1:
        logits = np.stack([x @ model.weights[slots] + model.bias for _, slots, x in unseen])
        model.temperature = temperature(logits, np.array([r[0] for r in unseen]))
    return model


def document_frequencies(rows: DataFrame, dimensions: int) -> tuple[np.ndarray, int]:
    """How many of the rows' texts hold each slot, and how many rows there are."""

    def run(batches):
        seen, total = np.zeros(dimensions, np.int64), 0
        for batch in batches:
            for part in tk.slices(batch):
                for text in texts(part.column("text")):
                    seen[features(text, dimensions)[0]] += 1
                    total += 1
        at = np.append(np.flatnonzero(seen), dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen, total)[at])], names=["slot", "n"])

    counted = rows.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(dimensions + 1, np.int64)  # bounded by the number of slots
    out[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    return out[:-1], int(out[-1])


def texts(column: pa.Array):
    data, offsets = tk.raw(column)
    blob = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield blob[a:b]


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on (text, lang) rows; `labelled` should hold nothing that is kept for testing."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    seen, total = document_frequencies(rows, dimensions)
    if not total:
        return Model([], np.ones(dimensions), np.zeros((dimensions, 0), np.float32), np.zeros(0), 1.0)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    order = F.xxhash64("text", "lang").alias("order")
    # hashes alone choose the sample, so no text moves: each language keeps about its even share of the
    # bound, and the limit makes the bound hard
    names = rows.select("lang", order).distinct()
    share = names.groupBy("lang").agg(F.count("*").alias("of"))
    languages = F.broadcast(share.agg(F.count("*").alias("kinds")))  # one row
    odds = F.lit(1.25 * sample_rows) / F.col("kinds") / F.col("of")
    chosen = names.join(share, "lang").join(languages, F.lit(True)).where(F.pmod("order", F.lit(1 << 20)) < odds * (1 << 20))
    chosen = store.written(chosen.orderBy("order", "lang").limit(sample_rows).select("lang", "order"), "sample")
    picked = rows.withColumn("order", order).join(F.broadcast(chosen), ["lang", "order"], "left_semi")  # at most sample_rows rows

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch):
                found = [features(t, dimensions) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("order"),
                     pa.array([s.astype("<u4").tobytes() for s, _ in found], pa.binary()),
                     pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())],
                    names=["lang", "order", "slots", "counts"],
                )

    sample = picked.mapInArrow(run, "lang string, order long, slots binary, counts binary").groupBy("lang", "order").agg(
        F.first("slots").alias("slots"), F.first("counts").alias("counts")
    ).orderBy("order", "lang").limit(sample_rows)

    def fit(batches):
        got = [
            (lang, np.frombuffer(s, "<u4"), np.frombuffer(c, "<u4"))
            for b in batches
            for lang, s, c in zip(*(b.column(k).to_pylist() for k in ("lang", "slots", "counts")))
        ]
        if got:
            model = fit_sample(got, idf)
            yield pa.RecordBatch.from_pylist(
                [{"languages": model.languages, "weights": model.weights.tobytes(), "bias": list(model.bias),
                  "temperature": model.temperature}],
                pa.schema([("languages", pa.list_(pa.string())), ("weights", pa.binary()), ("bias", pa.list_(pa.float64())),
                           ("temperature", pa.float64())]),
            )

    row = sample.coalesce(1).mapInArrow(
        fit, "languages array<string>, weights binary, bias array<double>, temperature double"
    ).first()
    weights = np.frombuffer(row.weights, np.float32).reshape(dimensions, len(row.languages))
    return Model(list(row.languages), idf, weights, np.array(row.bias), row.temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` with __lang and __score."""
    # bounded: dimensions times languages
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch):
                told = [shared.value.predict(t) for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array([x for x, _ in told], pa.string()),
                     pa.array([x for _, x in told], pa.float64())],
                    names=[*names, "__lang", "__score"],
                )

    told = T.StructType.fromDDL("__lang string, __score double")
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + told.fields))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for testing: crc32 of the id as text leaves 1 modulo 3; a null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"),
    )


def accepted(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least `least_score`, in their own columns."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = predict(docs, model).where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least_score))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
