"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training runs on a bounded sample of labelled rows (``FitLimits``): per class, the rows with the smallest
hash of their id. The n-grams of their whole texts are counted by class in a fixed number of tasks; the
log-count ratio r of an n-gram is log((p + a) / |p|) - log((q + a) / |q|) for its toxic and clean counts.
The strongest n-grams become features whose value is r where a text holds the n-gram, and a logistic model
with an L2 penalty is fitted on those values. Scoring is one pass over the whole texts without a shuffle; the
model it carries has a fixed size, and a text of any length is worked on piece by piece.

Defined results: a null or empty text gets the score of a text without any feature; labels that are null, or
whose id is null, are left out; a repeated label counts once and, where the labels of an id differ, the id is
toxic; an empty table gives an empty result; with no labelled rows of both classes every score is the share of
toxic labels (0 if there are none). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm import shared

#: Lengths in characters of the n-grams; texts are lower-cased first.
SIZES = (4, 5, 6, 7)
#: n-grams are hashed to this many buckets, a power of two.
BUCKETS = 1 << 20
THRESHOLD = 0.7
_CHUNK = 1 << 13
#: Code points that are worked on at a time.
_PIECE = 1 << 20


@dataclass(frozen=True)
class FitLimits:
    """Bounds of the fit: labelled rows of either class, tasks that count, features kept."""

    toxic_rows: int = 4000
    clean_rows: int = 8000
    tasks: int = 12
    features: int = 2048
    smoothing: float = 1.0
    penalty: float = 1e-3
    steps: int = 300


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1) if isinstance(doc_id, str) else (F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1)


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character."""
    h = np.zeros(len(data) - n + 1, dtype=np.uint32)
    for i in range(n):
        h *= np.uint32(0x01000193)
        h += data[i : len(data) - n + 1 + i]
    h ^= np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


@dataclass
class _Buffer:
    """Code points of pieces of texts, one after the other: where each begins, whose row it is of, and at how many of
    its places an n-gram may begin. A piece that is not its text's last is followed by what its last n-grams reach."""

    data: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    places: np.ndarray

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per n: the bucket of the n-gram at each place, and a mask of the places that have one."""
        for n in SIZES:
            if len(self.data) < n:
                continue
            inside = np.ones(len(self.data) - n + 1, dtype=bool)
            for back in range(1, n):
                ends = self.starts[1:-1] - back
                inside[ends[(ends >= 0) & (ends < len(inside))]] = False
            for i in np.flatnonzero(self.places < np.diff(self.starts)):
                inside[self.starts[i] + self.places[i] : self.starts[i + 1]] = False
            yield _hashes(self.data, n), inside

    def rows_at(self, places: np.ndarray) -> np.ndarray:
        return self.rows[np.searchsorted(self.starts, places, side="right") - 1]


def _buffers(texts: list[str], size: int = _PIECE) -> Iterator[_Buffer]:
    """All texts, lower-cased and with a blank before and after them, in buffers of about ``size`` code points, so that
    a text of any length takes no more memory than that beside itself."""
    pieces, held, reach = [], 0, max(SIZES) - 1

    def buffer() -> _Buffer:
        joined = "".join(piece for _, piece, _ in pieces)
        starts = shared.offsets_of([len(piece) for _, piece, _ in pieces])
        return _Buffer(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), starts, np.array([row for row, _, _ in pieces]), np.array([n for _, _, n in pieces]))

    for row, text in enumerate(texts):
        text = f" {text.lower()} "
        for at in range(0, len(text), size):
            piece = text[at : at + size + reach]
            pieces.append((row, piece, len(piece) if at + size >= len(text) else size))
            held += len(piece)
            if held >= size:
                yield buffer()
                pieces, held = [], 0
    if pieces:
        yield buffer()


@dataclass
class Model:
    """A bounded model: the feature of each bucket (0: none), and the weight of each feature."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def presence(self, texts: list[str]) -> np.ndarray:
        """Which features each text holds; the first column is of no feature."""
        found = np.zeros((len(texts), len(self.weights)), dtype=bool)
        for buffer in _buffers(texts):
            for buckets, inside in buffer.grams():
                slot = self.slots[buckets]
                at = np.flatnonzero((slot > 0) & inside)
                found[buffer.rows_at(at), slot[at]] = True
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if len(self.weights) <= 1:
            return np.full(len(texts), self.bias)
        z = self.bias + self.presence(texts)[:, 1:] @ self.weights[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _sample(labels: DataFrame, limits: FitLimits) -> DataFrame:
    """The labelled rows to learn from: a bounded number of either class, by the hash of their id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    toxic = known.where("toxic = 1").orderBy(*order).limit(limits.toxic_rows)
    return toxic.unionByName(known.where("toxic = 0").orderBy(*order).limit(limits.clean_rows))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in shared.table_of(batches):
        texts, toxic = shared.as_texts(batch.column(0)), batch.column(1).to_pylist()
        for label in (0, 1):
            for buffer in _buffers([t for t, y in zip(texts, toxic, strict=True) if y == label]):
                for buckets, inside in buffer.grams():
                    counts[label] += np.bincount(buckets[inside], minlength=BUCKETS)
    for chunk in range(BUCKETS // _CHUNK):
        part = counts[:, chunk * _CHUNK : (chunk + 1) * _CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in table.column("counts").to_pylist())
    at = np.flatnonzero(total.sum(axis=0))
    first = table.column("chunk")[0].as_py() * _CHUNK
    return pa.table({"bucket": pa.array(at + first, pa.int64()), "clean": pa.array(total[0][at], pa.int64()), "toxic": pa.array(total[1][at], pa.int64())})


def _logistic(x: np.ndarray, y: np.ndarray, limits: FitLimits) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the mean log loss with an L2 penalty; classes weigh the same."""
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    step = 1.0 / (0.25 * float((weight * (x * x).sum(axis=1)).sum()) + limits.penalty + 0.25)
    w, b, weight, y = np.zeros(x.shape[1], np.float32), 0.0, weight.astype(np.float32), y.astype(np.float32)
    w0, b0 = w, b
    for k in range(limits.steps):
        m = k / (k + 3)
        v, c = w + np.float32(m) * (w - w0), b + m * (b - b0)
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ v + np.float32(c), -40, 40)))
        g = weight * (p - y)
        w0, b0 = w, b
        w, b = v - np.float32(step) * (g @ x + np.float32(limits.penalty) * v), c - step * float(g.sum())
    return w.astype(np.float64), float(b)


def fit(documents: DataFrame, labels: DataFrame, limits: FitLimits = FitLimits()) -> Model:
    """Learn from labelled rows that are not held out; only their text and label are read."""
    shared.small_batches(documents.sparkSession)
    rows = F.broadcast(_sample(labels, limits))  # at most toxic_rows + clean_rows ids
    texts = documents.select("doc_id", "text").join(rows, "doc_id").select("text", "toxic").repartition(limits.tasks)
    texts = shared.written(texts, "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    empty = Model(np.zeros(1, np.int32), np.zeros(1), sizes.get(1, 0) / total if total else 0.0)
    if len(sizes) < 2:
        return empty
    counts = texts.mapInArrow(_count, "chunk int, counts binary").groupBy("chunk").applyInArrow(_add, "bucket long, clean long, toxic long")
    counts = shared.written(counts, "toxicity-counts")
    sums = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    if not sums["n"]:
        return empty
    a = limits.smoothing
    ratio = F.log((F.col("toxic") + a) / (sums["toxic"] + a * sums["n"])) - F.log((F.col("clean") + a) / (sums["clean"] + a * sums["n"]))
    # the contribution of an n-gram to the divergence of the two classes' distributions
    gain = F.abs(ratio * ((F.col("toxic") + a) / (sums["toxic"] + a * sums["n"]) - (F.col("clean") + a) / (sums["clean"] + a * sums["n"])))
    best = counts.select("bucket", ratio.alias("r"), gain.alias("gain")).orderBy(F.desc("gain"), "bucket").limit(limits.features).collect()
    slots = np.zeros(BUCKETS, dtype=np.int32)
    slots[[b["bucket"] for b in best]] = np.arange(1, len(best) + 1)
    ratios = np.asarray([b["r"] for b in best], dtype=np.float32)
    features = Model(slots, np.zeros(len(best) + 1), 0.0)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.table_of(batches):
            bits = features.presence(shared.as_texts(batch.column(0)))
            packed = np.packbits(bits[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([p.tobytes() for p in packed], pa.binary())], ["toxic", "bits"])

    found = texts.mapInArrow(presence, "toxic int, bits binary").toArrow()  # features / 8 bytes for each sampled row
    rows = sorted(zip(found.column("toxic").to_pylist(), found.column("bits").to_pylist(), strict=True))  # so that sums do not hang on the order of tasks
    y = np.asarray([label for label, _ in rows], dtype=np.float64)
    bits = np.unpackbits(np.frombuffer(b"".join([b for _, b in rows]), dtype=np.uint8).reshape(len(y), -1), axis=1)[:, : len(best)]
    w, b = _logistic(bits.astype(np.float32) * ratios, y, limits)
    return Model(slots, np.concatenate(([0.0], w * ratios)), b)


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every column of ``documents`` and, at the end, ``loreweave_toxicity`` and ``loreweave_toxic``; texts are read whole."""
    shared.small_batches(documents.sparkSession)
    carried = documents.sparkSession.sparkContext.broadcast(model)  # one bucket table and one weight table of fixed size

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        return pa.array(carried.value.scores(shared.as_texts(text)), pa.float64())

    scored = documents.withColumn("loreweave_toxicity", toxicity(F.col("text")))
    return scored.withColumn("loreweave_toxic", (F.col("loreweave_toxicity") >= threshold).cast("int"))
