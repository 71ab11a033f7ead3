"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Every word bucket (a word's hash) has a sparse index vector of a few signs at places drawn from the hash. A bucket's word vector is the sum of the index
vectors of its neighbours within ``WINDOW`` words, over all documents: Spark adds up what the tasks have counted.
A document is the mean and the spread of its words' vectors, their count, and nothing else. The network is trained with numpy
on a sample of labelled documents, bounded by ``max_train``, in the order of a hash; a part of it
that training does not see sets the temperature of the probabilities.

Defined results: a null text is empty; an empty text gets the score the network gives to no words; labels that
are null or repeated for a document are left out or taken once (the lower); without labels of both kinds every score is the share of ones, 0.5 without any;
repeated rows get the same score; an empty table gives no rows. Other columns are ignored, or kept by ``with_score``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.llm.common import ship

BUCKETS, DIMENSION, SIGNS, WINDOW = 1 << 15, 32, 2, 2
FEATURES = 2 * DIMENSION + 2
_KNOWN_WORDS = 100_000
_AT_ONCE = 1 << 17


class _Buckets(dict):
    """Bucket of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = bucket = zlib.crc32(word) & (BUCKETS - 1)
        return bucket


def _ids(known: _Buckets, text: bytes | None) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector; the bucket after the last stands for no word."""
    rng = np.random.default_rng(seed)
    places = rng.integers(0, DIMENSION, size=(BUCKETS + 1, SIGNS))
    signs = rng.integers(0, 2, size=(BUCKETS + 1, SIGNS)).astype(np.float64) * 2 - 1
    signs[BUCKETS] = 0
    return places, signs


def add_contexts(total: np.ndarray, ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to each bucket's row of ``total`` the index vectors of the words around its occurrences."""
    for distance in range(1, WINDOW + 1):
        for target, context in ((ids[:-distance], ids[distance:]), (ids[distance:], ids[:-distance])):
            for s in range(SIGNS):
                flat = target.astype(np.int64) * DIMENSION + places[context, s]
                total += np.bincount(flat, weights=signs[context, s], minlength=total.size)


def word_vectors(docs: DataFrame, text_col: str = "text", seed: int = 11) -> np.ndarray:
    """One row of unit length per bucket, from all documents. BUCKETS rows reach the driver."""
    ship(docs.sparkSession)
    names = [f"c{i}" for i in range(DIMENSION)]

    def run(batches):
        places, signs = index_vectors(seed)
        known, total = _Buckets(), np.zeros((BUCKETS + 1) * DIMENSION)
        gap, held, n = np.full(WINDOW, BUCKETS, dtype=np.int32), [], 0
        for batch in batches:
            for value in batch.column(0):
                held += [_ids(known, value.as_py()), gap]
                n += len(held[-2]) + WINDOW
                if n >= _AT_ONCE:
                    add_contexts(total, np.concatenate(held), places, signs)
                    held, n = [], 0
        if held:
            add_contexts(total, np.concatenate(held), places, signs)
        rows = total.reshape(-1, DIMENSION)[:BUCKETS].astype(np.int64)
        used = np.nonzero(rows.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(np.ascontiguousarray(rows[used, i])) for i in range(DIMENSION))],
                                         names=["bucket", *names])

    counted = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, ", ".join(f"{c} long" for c in ["bucket", *names]))
    summed = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros((BUCKETS + 1, DIMENSION), dtype=np.float32)
    if len(summed):
        values = summed[names].to_numpy(dtype=np.float64)
        out[summed["bucket"].to_numpy()] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-12)
    return out


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the words' vectors, log of the number of words, and whether there are any."""
    out = np.zeros(FEATURES)
    if not len(ids):
        return out
    first, second = np.zeros(DIMENSION), np.zeros(DIMENSION)
    for at in range(0, len(ids), _AT_ONCE):
        part = vectors[ids[at:at + _AT_ONCE]]
        first += part.sum(axis=0, dtype=np.float64)
        second += np.einsum("ij,ij->j", part, part)
    mean = first / len(ids)
    out[:DIMENSION] = mean
    out[DIMENSION:2 * DIMENSION] = np.sqrt(np.maximum(second / len(ids) - mean * mean, 0))
    out[-2:] = np.log1p(len(ids)), 1.0
    return out


@dataclass
class Network:
    """Standardised features, one hidden layer, one output; ``temperature`` divides the output before the sigmoid."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.center) / self.scale, -8, 8) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 16, rounds: int = 300, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> Network:
    """Full-batch Adam on the logistic loss; every fifth row is kept for the temperature."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    tx, ty = x[~held], y[~held].astype(float)
    center, scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
    z = np.clip((tx - center) / scale, -8, 8)
    p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, rounds + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - ty) / len(ty)
        back = np.outer(error, p[2]) * (1 - h * h)
        grads = [z.T @ back + decay * p[0] / len(ty) ** 0.5, back.sum(axis=0), h.T @ error + decay * p[2] / len(ty) ** 0.5, np.array([error.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(center, scale, p[0], p[1], p[2], float(p[3][0]))
    if held.any():
        logits, truth = net.logit(x[held]), y[held].astype(float)
        losses = {t: float(np.mean(np.logaddexp(0, logits / t) - truth * logits / t)) for t in np.exp(np.linspace(-1.5, 2.5, 81)).tolist()}
        net.temperature = min(losses, key=losses.get)
    return net


def features(texts: DataFrame, vectors: np.ndarray) -> DataFrame:
    """``texts`` (id, label, text) as (id order kept) label and features, for the training sample."""
    shared = texts.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        known = _Buckets()
        for batch in batches:
            rows = [pooled(_ids(known, t.as_py()), shared.value) for t in batch.column(1)]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, flat)], names=["label", "place", "x"])

    return texts.select("label", F.col("text").cast("binary"), "place").mapInArrow(run, "label int, place long, x array<double>")


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labelled: DataFrame, max_train: int = 12_000, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "quality", seed: int = 11) -> Model:
    """Word vectors from all ``docs``; the network from at most ``max_train`` rows of ``labelled``."""
    vectors = word_vectors(docs, text_col, seed)
    chosen = labelled.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(
        F.min(label_col).cast("int").alias("label")).withColumn("place", F.xxhash64("_id", F.lit(seed)))
    chosen = chosen.orderBy("place", "_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")  # max_train rows at most
    sample = features(texts, vectors).orderBy("place").limit(2 * max_train).toPandas()
    if not len(sample):
        return Model(vectors, constant(0.5))
    return Model(vectors, train(np.stack(sample["x"].to_numpy()), sample["label"].to_numpy()))


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Calibrated probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known, trained = _Buckets(), shared.value
        rows = [pooled(_ids(known, t), trained.vectors) for t in texts]
        return pd.Series(trained.network.probability(np.stack(rows)) if rows else np.zeros(0))

    return score(F.col(text_col).cast("binary"))


def fold(id_col: str = "doc_id") -> Column:
    """Held out: rows no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_outside_fold(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return fit(docs, labels.where(~fold("doc_id")), **options)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    return docs.withColumn(name, score_column(docs, model, text_col))
