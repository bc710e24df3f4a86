"""Toxicity: a classifier chain.

Categories are predicted in a fixed order by linear (logistic) models. Each model sees a text's features and the
probabilities of all earlier categories. In training these probabilities are out of fold: a document's come from models
that did not see it, so that later models learn how far earlier ones can be trusted. Labels say only whether a text is
toxic; the finer categories are learned from the training rows (``kinds``): the features that tell most about the label
are clustered by the toxic texts that they share, and a toxic text is of each kind that it has a feature of. The last
category is the label itself, and its probability decides.

Features are the presence of hashed lower-cased words and of their first four and five characters, of the whole text.
Every model keeps the ``KEEP`` buckets whose presence tells most about its category (chi-square), so length does not
add noise. Training is on the driver on at most ``TRAIN_ROWS`` labelled documents; models are small tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from . import textbytes as tb

BUCKETS, PREFIXES = 1 << 18, (4, 5)
#: The most labelled documents that training sees, whole.
TRAIN_ROWS = 5000
KEEP, LEAST_DOCS = 2048, 3
FOLDS, EPOCHS, STEP, DECAY = 5, 12, 0.3, 1e-4
#: Finer categories, and the features that they are made of.
KINDS, TELLING = 3, 60
CATEGORIES = (*(f"kind_{i + 1}" for i in range(KINDS)), "toxic")


def telling(bucket: np.ndarray, row: np.ndarray, n: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket how much its presence tells about ``y`` (chi-square; 0 for rare ones), and whether it speaks for it."""
    df = np.bincount(bucket, minlength=BUCKETS)
    hits = np.bincount(bucket, weights=y[row], minlength=BUCKETS)
    base = y.mean() if n else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (hits - df * base) ** 2 / (df * base * (1 - base) * (1 - df / max(n, 1) + 1e-9))
    return np.where(df >= LEAST_DOCS, np.nan_to_num(chi), 0), hits > df * base


def kinds(bucket: np.ndarray, row: np.ndarray, n: int, y: np.ndarray) -> np.ndarray:
    """0 or 1 for each document and kind, then the label (n x ``KINDS`` + 1).

    Spherical k-means over features as sets of toxic texts: the first centre is the most frequent feature, each next one
    the least like those before it. Kinds without features hold nothing.
    """
    chi, speaks = telling(bucket, row, n, y)
    chosen = np.argsort(-np.where(speaks, chi, 0), kind="stable")[:TELLING]
    # far less telling ones are there by chance
    chosen = np.sort(chosen[chi[chosen] > max(4, 0.1 * chi[chosen].max())])
    out = np.zeros((n, KINDS + 1), np.int64)
    out[:, -1] = y
    if not len(chosen):
        return out
    at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
    hit = (chosen[at] == bucket) & (y[row] == 1)
    held = np.zeros((len(chosen), n), np.float32)
    held[at[hit], row[hit]] = 1
    unit = held / np.linalg.norm(held, axis=1, keepdims=True)
    first = [int(np.argmax(held.sum(axis=1)))]
    while len(first) < min(KINDS, len(chosen)):
        first.append(int(np.argmin((unit @ unit[first].T).max(axis=1))))
    centres = unit[first]
    for _ in range(10):
        of = np.argmax(unit @ centres.T, axis=1)
        centres = np.stack([unit[of == k].sum(axis=0) if (of == k).any() else centres[k] for k in range(len(first))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for k in range(len(first)):
        out[:, k] = held[of == k].any(axis=0)
    return out


class Linear(NamedTuple):
    buckets: np.ndarray  # ascending
    weights: np.ndarray
    earlier: np.ndarray  # weights of earlier categories' probabilities
    bias: float

    def probability(self, bucket: np.ndarray, row: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """Per row, from distinct (row, bucket) pairs and earlier probabilities (n x k)."""
        at = np.minimum(np.searchsorted(self.buckets, bucket), max(len(self.buckets) - 1, 0))
        hit = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), bool)
        z = np.bincount(row[hit], weights=self.weights[at[hit]], minlength=n) + earlier @ self.earlier + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_linear(bucket: np.ndarray, row: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray, seed: int = 3) -> Linear:
    """A logistic model by stochastic gradient descent over documents 0..n-1 given as distinct (row, bucket) pairs."""
    chi, _ = telling(bucket, row, n, y)
    kept = np.sort(np.argsort(-chi, kind="stable")[:KEEP])
    kept = kept[chi[kept] > 4]
    at = np.minimum(np.searchsorted(kept, bucket), max(len(kept) - 1, 0))
    hit = kept[at] == bucket if len(kept) else np.zeros(len(bucket), bool)
    order = np.argsort(row[hit], kind="stable")
    cols, ends = at[hit][order], np.searchsorted(row[hit][order], np.arange(n + 1))
    weights, power = np.zeros(len(kept)), np.full(len(kept), 1e-3)
    more, bias = np.zeros(earlier.shape[1]), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = STEP / (1 + 0.2 * epoch)
        for i in rng.permutation(n):
            c = cols[ends[i] : ends[i + 1]]
            z = weights[c].sum() + earlier[i] @ more + bias
            g = 1 / (1 + np.exp(-min(max(z, -60), 60))) - y[i]
            if abs(g) < 0.01:
                continue
            power[c] += g * g
            weights[c] -= rate * (g / np.sqrt(power[c]) + DECAY * weights[c])
            more -= 0.1 * rate * (g * earlier[i] + DECAY * more)
            bias -= 0.1 * rate * g
    return Linear(kept, weights, more, bias)


def fit_chain(bucket: np.ndarray, row: np.ndarray, n: int, ys: np.ndarray) -> list[Linear]:
    """Models for the columns of ``ys``; each sees out-of-fold probabilities of those before it."""
    fold, earlier, models = np.arange(n) % FOLDS, np.zeros((n, 0)), []
    for j in range(ys.shape[1]):
        y, out = ys[:, j].astype(float), np.zeros(n)
        for k in range(FOLDS) if j + 1 < ys.shape[1] else ():
            inside = fold != k
            ids = np.cumsum(inside) - 1
            part = inside[row]
            model = fit_linear(bucket[part], ids[row[part]], int(inside.sum()), earlier[inside], y[inside])
            out[~inside] = model.probability(bucket, row, n, earlier)[~inside]
        models.append(fit_linear(bucket, row, n, earlier, y))
        earlier = np.column_stack([earlier, out])
    return models


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> list[Linear]:
    """A chain for ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text); without labelled rows nothing is toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part, at in tb.runs(*tb.strings(batch.column(batch.num_columns - 1))):
                key = _distinct(part, at)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(key, np.arange(len(at)) * BUCKETS), pa.int32()), pa.array(key % BUCKETS, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(at) - 1) for c in batch.columns[:-1]), lists], [*batch.schema.names[:-1], "bucket"])

    got = features.labelled(docs, labels, "toxic", most).mapInArrow(count, "doc_id long, y int, bucket array<int>").toArrow().sort_by("doc_id").combine_chunks()
    lists, y = [x.values.to_numpy() for x in got.column("bucket")], np.asarray(got.column("y").to_pylist(), np.int64)
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    bucket = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    # words of fewer texts are never chosen, in a part of the texts even less
    often = np.bincount(bucket, minlength=BUCKETS) >= LEAST_DOCS
    del got, lists
    bucket, row = bucket[often[bucket]], row[often[bucket]]
    return fit_chain(bucket, row, len(y), kinds(bucket, row, len(y), y))


def _distinct(part: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct ``row * BUCKETS + bucket`` of a run, of the wanted buckets only if given."""
    bucket, row = features.word_prefixes(part, at, BUCKETS, PREFIXES)
    if wanted is not None:
        keep = wanted[bucket]
        bucket, row = bucket[keep], row[keep]
    return np.unique(row * BUCKETS + bucket)


def _sent(docs: DataFrame, models: list[Linear]):
    wanted = np.zeros(BUCKETS, bool)
    for m in models:
        wanted[m.buckets] = True
    return docs.sparkSession.sparkContext.broadcast((models, wanted))  # KEEP numbers a category


def probabilities(sent: tuple[list[Linear], np.ndarray], part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per row of a run the probabilities of all categories, each model seeing those before it."""
    n, key = len(at) - 1, _distinct(part, at, sent[1])
    p = np.zeros((n, 0))
    for m in sent[0]:
        p = np.column_stack([p, m.probability(key % BUCKETS, key // BUCKETS, n, p)])
    return p


def score(docs: DataFrame, models: list[Linear], threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the probability of each category (``p_...``) and ``toxic`` for each row of ``docs`` (doc_id, text).

    ``toxic`` says that the last category's probability reaches ``threshold``. Null and empty texts have no features
    and are judged by the constants alone. Texts are judged whole, however long. Repeated rows get equal results. Columns
    other than doc_id and text are not used. An empty table gives an empty result.
    """
    held = _sent(docs, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part, at in tb.runs(*tb.strings(batch.column(1))):
                p = probabilities(held.value, part, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(p)), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame, models: list[Linear], threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that ``score`` does not call toxic. Null and empty texts stay; texts are judged whole."""
    held, place = _sent(docs, models), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tb.strings(batch.column(place))
            for first, part, at in tb.runs(buf, offsets):
                keep = (probabilities(held.value, part, at)[:, -1] < threshold) | (np.diff(at) == 0)
                yield batch.slice(first, len(keep)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
