"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.batches import pieces, strings
from tablelens.llm.sampling import held_out, sample_per_class
from tablelens.llm.shared import written

#: Word vectors (words share one by hash), their length, entries of an index vector that aren't zero, neighbours each side.
WORDS, DIMENSIONS, NONZERO, REACH = 4096, 32, 4, 2
#: Labelled rows per class that the network is fitted on, at most 1.5 times this; a quarter of them sets the temperature.
ROWS_PER_CLASS = 3000
HIDDEN, ROUNDS, REMEMBERED = 32, 400, 300_000
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class Tokens:
    """Numbers of word vectors; a token equal to the one before it counts as the repetition sign."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.repeated = zlib.crc32(b"repeated token") % WORDS

    def __call__(self, text: str) -> np.ndarray:
        found, seen = _TOKEN.findall(text), self.seen
        new = [w for w in set(found) if w not in seen]
        if len(seen) + len(new) > REMEMBERED:
            seen.clear()
            new = set(found)
        for w in new:
            seen[w] = zlib.crc32(w.encode()) % WORDS
        ids = np.fromiter((seen[w] for w in found), np.int32, len(found))
        if len(ids) > 1:
            again = np.flatnonzero(ids[1:] == ids[:-1]) + 1
            ids[[i for i in again.tolist() if found[i] == found[i - 1]]] = self.repeated
        return ids


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors, for neighbours to the right and to the left."""
    draw = np.random.default_rng(7)
    out = np.zeros((2, WORDS, DIMENSIONS))
    for side in out:
        for row in side:
            row[draw.choice(DIMENSIONS, NONZERO, replace=False)] = draw.choice((-1.0, 1.0), NONZERO)
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WORDS * DIMENSIONS, np.int64)
    for b in batches:
        for v in b.column(0).to_pylist():
            total += np.frombuffer(v, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["vectors"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Sums of the index vectors of all neighbours of each word, over every whole text of the corpus.

    A task counts pairs of neighbours and multiplies once by the index vectors; the sums (a fixed 1 MB per task,
    whole numbers, so their order does not matter) are added up in two levels.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pairs = Tokens(), np.zeros(WORDS * WORDS, np.int32)
        some = False
        for b in pieces(batches):
            for text in strings(b):
                ids = tokens(text)
                some |= len(ids) > 1
                for d in range(1, REACH + 1):
                    np.add.at(pairs, ids[:-d] * WORDS + ids[d:], 1)
        if some:
            right, left = index_vectors()
            table = pairs.reshape(WORDS, WORDS)
            total = np.zeros((WORDS, DIMENSIONS))
            for at in range(0, WORDS, 512):
                rows = table[at:at + 512].astype(float)
                total[at:at + 512] += rows @ right
                total += rows.T @ left[at:at + 512]
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64).tobytes()], pa.binary())], ["vectors"])

    parts = docs.select("text").where(F.length("text") > 0).mapInArrow(count, "vectors binary")
    groups = max(1, int(docs.sparkSession.sparkContext.defaultParallelism))
    level = parts.repartition(groups).mapInArrow(_added, "vectors binary").repartition(1).mapInArrow(_added, "vectors binary")
    sums = np.frombuffer(level.first()[0], np.int64).reshape(WORDS, DIMENSIONS).astype(float)
    sums -= sums.sum(0) / max(1.0, np.abs(sums).sum()) * np.abs(sums).sum(1, keepdims=True)  # what all words have in common
    return (sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))).astype(np.float32)


def pooled(vectors: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """Mean and spread of the word vectors of each document, and the logarithm of its length."""
    out = np.zeros((len(ids), 2 * DIMENSIONS + 1))
    for i, x in enumerate(ids):
        if len(x):
            share = np.bincount(x, minlength=WORDS) if len(x) > 4 * WORDS else None
            v, w = (vectors, share / len(x)) if share is not None else (vectors[x], None)
            mean = w @ v if w is not None else v.mean(0)
            square = w @ (v * v) if w is not None else (v * v).mean(0)
            out[i] = np.r_[mean, np.sqrt(np.maximum(0, square - mean * mean)), np.log1p(len(x))]
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        z = self.logit(pooled(self.vectors, ids)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()


@lru_cache(maxsize=1)
def _model(data: bytes) -> QualityModel:
    return QualityModel(**dict(np.load(io.BytesIO(data))))


def _train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> QualityModel:
    """Adam on three quarters of the rows; the temperature that fits the other quarter best, from a fixed grid."""
    draw = np.random.default_rng(11)
    check = np.arange(len(y)) % 4 == 3
    check &= len(y) >= 16
    centre, scale = x[~check].mean(0), x[~check].std(0) + 1e-3
    parts = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    rate = np.average(y, weights=weight)
    parts[3][0] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
    a, t, w = ((x - centre) / scale)[~check], y[~check], weight[~check] / weight[~check].sum()
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, ROUNDS + 1):
        hidden = np.tanh(a @ parts[0] + parts[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ parts[2] + parts[3], -40, 40)))
        e = (p - t) * w
        back = np.outer(e, parts[2]) * (1 - hidden * hidden)
        for i, g in enumerate((a.T @ back + 1e-4 * parts[0], back.sum(0), hidden.T @ e + 1e-4 * parts[2], np.array([e.sum()]))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            parts[i] = parts[i] - 0.01 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    model = QualityModel(vectors, centre, scale, *parts, temperature=np.ones(1))
    if check.any():
        z, t, w = model.logit(x[check]), y[check], weight[check]
        grid = np.geomspace(0.5, 8, 33)
        loss = [float(np.average(np.logaddexp(0, z / k) - t * z / k, weights=w)) for k in grid]
        model.temperature = np.array([grid[int(np.argmin(loss))]])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> QualityModel:
    """Word vectors from all documents, a network from at most 1.5 * ``per_class`` labelled ones of each class.

    Only the label ``quality`` of rows that are not held out is read. Equal texts are one row; of several labels of a
    doc_id or of a text the most frequent is taken, in a tie 0. Sampled rows weigh as much as their class holds
    texts, so scores are probabilities at the corpus's rate. Without labelled rows every score is one half.
    """
    vectors = word_vectors(docs) if not docs.where(F.length("text") > 0).isEmpty() else np.zeros((WORDS, DIMENSIONS), np.float32)
    rows = labels.select("doc_id", "quality").where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    most = (2 * F.sum("quality") > F.count("*")).cast("int").alias("quality")
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    texts = written(
        docs.select("doc_id", text_hash).join(rows.groupBy("doc_id").agg(most), "doc_id")
        .groupBy("text_hash").agg(most, F.min("doc_id").alias("doc_id")),
        "quality-texts",
    )
    sizes = {r["quality"]: r["count"] for r in texts.groupBy("quality").count().collect()}
    chosen = written(
        sample_per_class(texts, "quality", F.col("text_hash"), per_class).select("doc_id", "text_hash", "quality"), "quality-rows"
    )
    sample = docs.select("doc_id", "text", text_hash).join(
        F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["text_hash"])  # bounded sample
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in pieces(batches):
            x = pooled(shared.value, [tokens(t) for t in strings(b)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["key", "quality", "x"])

    found = sorted(
        sample.select(F.col("text_hash").alias("key"), "quality", "text").mapInArrow(features, "key bigint, quality int, x array<double>").collect()
    )
    if not found:
        none, side = np.zeros(1), 2 * DIMENSIONS + 1
        return QualityModel(vectors, np.zeros(side), np.ones(side), np.zeros((side, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), none, none + 1)
    y = np.array([r["quality"] for r in found], float)
    taken = {c: max(1.0, float((y == c).sum())) for c in (0, 1)}
    weight = np.array([sizes[int(c)] / taken[int(c)] for c in y])
    return _train(vectors, np.array([r["x"] for r in found]), y, weight)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs``, repeated rows too; one scan. Null texts count as empty and get a score."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, net = Tokens(), _model(shared.value)
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score([tokens(t) for t in strings(b)]))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_quality(docs, fit_quality(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
