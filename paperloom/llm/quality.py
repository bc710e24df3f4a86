"""Quality classifier: supervised subword embeddings.

Words and character n-grams of a text are hashed to buckets; each bucket has a learned vector. A document is the mean
of its features' vectors, a softmax over two outputs gives its score. Vectors and outputs are trained together by numpy
stochastic gradient descent with a falling step, on the driver, on at most ``TRAIN_ROWS`` labelled documents. As the
output is linear in the mean, a trained model scores by one number a bucket, which is what tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features
from . import textbytes as tb

BUCKETS, GRAMS = 1 << 17, (2, 3, 4)
#: The most labelled documents that training sees, whole.
TRAIN_ROWS = 2400
DIM, EPOCHS, STEP = 8, 6, 12.0


class Model(NamedTuple):
    """Per bucket the difference of the two outputs, and that of the constants."""

    table: np.ndarray
    bias: float

    def scores(self, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        mean, _ = features.means(part, at, self.table, GRAMS)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -60, 60)))


def train(buckets: list[np.ndarray], times: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Model:
    """A model from each document's buckets with their counts and its label (0 or 1)."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    if len(y):
        bias[1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    step, steps = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate, step = STEP * (1 - step / steps), step + 1
            if not len(buckets[i]):
                continue
            weight = times[i].astype(np.float32) / times[i].sum()
            hidden = weight @ vectors[buckets[i]]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.01 * rate * p
            vectors[buckets[i]] -= (rate * weight)[:, None] * back
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model for ``labels`` (doc_id, quality) of ``docs`` (doc_id, text); without labelled rows every score is 0.5."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return features.counts(batches, BUCKETS, GRAMS, False)

    rows = features.labelled(docs, labels, "quality", most).mapInArrow(count, "doc_id long, y int, bucket array<int>, times array<int>")
    got = rows.toArrow().sort_by("doc_id").combine_chunks()
    lists = [[x.values.to_numpy() for x in got.column(c)] if len(got) else [] for c in ("bucket", "times")]
    return train(*lists, np.asarray(got.column("y").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs`` (doc_id, text).

    Null and empty texts have no features and get the score of the constants. Texts are scored whole, however long.
    Repeated rows get equal scores. Other columns are not used. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part, at in tb.runs(*tb.strings(batch.column(1))):
                s = held.value.scores(part, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(s)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    """Documents that training never sees: those whose id's CRC-32 leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
