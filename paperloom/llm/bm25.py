"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Test items are the documents of the index, training passages are the queries: windows of ``WINDOW`` words, each starting
``WINDOW / 2`` after the one before, so any test piece (at most half a window) is whole in one. A term's impact on an item
is its BM25 weight as a share of the weight of all the item's terms; a passage's score is the share of the item that it
holds, and all items at ``THRESHOLD`` or above are wanted: the threshold is known from the start.

Items stand in blocks. Terms that are in many items, and together below ``COMMON`` of every item, drive nothing: their
best sum in a block bounds them. The other terms of a batch of passages add up their block maxima; only (passage, block)
pairs whose bound reaches the threshold are searched by WAND, document at a time with pivots. Found items are then
verified: question and answer must both overlap the document, by distinct trigrams.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import written

WINDOW = 128
THRESHOLD, OVERLAP = 0.5, 0.5
K1, B = 1.2, 0.75
BLOCK, COMMON = 4, 0.2
#: Items and terms of one index, about; more are searched index by index, each small enough to be sent to all executors.
#: Weights come from the counts of all items, so how they are dealt changes no score.
SHARD, SHARD_TERMS = 20_000, 1_000_000

_TERM = np.zeros(256, bool)
_TERM[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _TERM[_a:_b] = True


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term: a run of letters, digits and non-ASCII bytes, A-Z lower-cased."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside, edge = _TERM[buf], np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1 : len(buf)]
    last[:-1] &= ~inside[1:] | edge[1 : len(buf)]
    start = np.flatnonzero(first)
    return tb.Slices(buf, lower=True).hashes(start, np.flatnonzero(last) + 1), np.searchsorted(offsets, start, side="right") - 1


def terms_of(text: str | None) -> np.ndarray:
    buf = np.frombuffer((text or "").encode(), np.uint8)
    return terms(buf, np.array([0, len(buf)]))[0]


def question_and_answer(text: str | None) -> tuple[str, str]:
    """An item's answer is its last sentence or line that holds a term, if something comes before it; the rest is its question."""
    text = (text or "").rstrip()
    body = text.rstrip(".?!\n ")
    at = max(body.rfind("\n"), *(body.rfind(x + " ") for x in ".?!"))
    return (text[: at + 1], text[at + 1 :]) if at >= 0 else (text, text)


def trigrams(t: np.ndarray) -> np.ndarray:
    """Distinct hashes of three successive terms; of all terms where there are fewer."""
    if len(t) < 3:
        return np.unique(t)
    return np.unique(tb.mixed(tb.mixed(tb.mixed(t[:-2]) ^ t[1:-1]) + t[2:]))


def _share(wanted: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(wanted, there).mean()) if len(wanted) else 1.0


class Counts(NamedTuple):
    """Pieces and terms of all items, and the pieces that hold a term, for the terms of one index at least."""

    pieces: int
    terms: int
    df: dict[int, int]


class Index:
    """Postings of test pieces with block maxima; ``counts`` where there are more items than these."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW, common: float = COMMON, block: int = BLOCK, counts: Counts | None = None):
        self.window, self.block = window, block
        self.items, self.parts, pieces = [], [], []
        for item_id, text in items:
            t = terms_of(text)
            if not len(t):
                continue
            question, answer = question_and_answer(text)
            self.parts.append((trigrams(terms_of(question)), trigrams(terms_of(answer))))
            for i in range(0, len(t), window // 2):
                pieces.append((len(self.items), Counter(t[i : i + window // 2].tolist())))
            self.items.append(item_id)
        self.owner = [k for k, _ in pieces]
        if counts is None:
            counts = Counts(len(pieces), sum(c.total() for _, c in pieces), Counter(h for _, c in pieces for h in c))
        df, total = counts.df, counts.pieces
        self.vocabulary = np.array(sorted({h for _, c in pieces for h in c}), np.uint64)
        number = {h: i for i, h in enumerate(self.vocabulary.tolist())}
        mean = counts.terms / max(total, 1)
        postings: list[list[tuple[int, float]]] = [[] for _ in number]
        mass = np.zeros(len(pieces))
        for p, (_, c) in enumerate(pieces):
            weight = {h: math.log(1 + (total - df[h] + 0.5) / (df[h] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * c.total() / mean)) for h, n in c.items()}
            whole = sum(weight.values())
            for h in sorted(weight):
                postings[number[h]].append((p, weight[h] / whole))
        self.postings = postings
        # common terms: of most items first, as long as no piece has too much of them
        self.driving = np.ones(len(postings), bool)
        for t in sorted(range(len(postings)), key=lambda t: (-len(postings[t]), t)):
            more = mass.copy()
            for p, w in postings[t]:
                more[p] += w
            if len(postings[t]) < 2 or more.max() > common:
                break
            mass, self.driving[t] = more, False
        blocks = -(-len(pieces) // block)
        self.common_bound = np.zeros(blocks)
        np.maximum.at(self.common_bound, np.arange(len(pieces)) // block, mass)
        maxima = []
        for t in postings:
            best: dict[int, float] = {}
            for p, w in t:
                best[p // block] = max(best.get(p // block, 0.0), w)
            maxima.append(best)
        self.maxima = maxima
        self.starts = np.cumsum([0] + [len(m) if d else 0 for m, d in zip(maxima, self.driving, strict=True)])
        self.block_of = np.array([b for m, d in zip(maxima, self.driving, strict=True) if d for b in m], np.int64)
        self.block_max = np.array([w for m, d in zip(maxima, self.driving, strict=True) if d for w in m.values()])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms that the index has, and their numbers."""
        at = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[t] == hashes[at]
        return at[hit], t[hit]

    def wand(self, present: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Pieces of a block that reach the threshold, with scores: document at a time, pivots by block maxima."""
        end = (block + 1) * self.block
        lists = []
        for t in present:
            bound = self.maxima[t].get(block)
            if bound is not None:
                lists.append([[x for x in self.postings[t] if x[0] // self.block == block], 0, bound])
        found = []
        while True:
            live = sorted((x for x in lists if x[1] < len(x[0])), key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, end
            for x in live:
                bound += x[2]
                if bound >= threshold - 1e-9:
                    pivot = x[0][x[1]][0]
                    break
            if pivot == end:
                return found
            if live[0][0][live[0][1]][0] == pivot:
                score = 0.0
                for x in live:
                    if x[0][x[1]][0] == pivot:
                        score += x[0][x[1]][1]
                        x[1] += 1
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
            else:
                for x in live:
                    while x[1] < len(x[0]) and x[0][x[1]][0] < pivot:
                        x[1] += 1

    def search(self, hashes: np.ndarray, row: np.ndarray, rows: int, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(row, item number, best score) for every row of terms and item that one of its passages reaches."""
        half = self.window // 2
        count = np.bincount(row, minlength=rows)
        base = np.cumsum(count) - count
        windows = np.maximum((count + half - 1) // half - 1, (count > 0).astype(np.int64))  # the last reaches the row's end
        first = np.cumsum(windows) - windows
        at, t = self.numbers(hashes)
        if not len(at):
            return
        r = row[at]
        step = (at - base[r]) // half
        # a term is in the window that starts in its own half and in the one before
        own, before = step < windows[r], step > 0
        window = np.concatenate([(first[r] + step)[own], (first[r] + step - 1)[before]])
        term = np.concatenate([t[own], t[before]])
        key = np.unique(window * len(self.vocabulary) + term)
        window, term = key // len(self.vocabulary), key % len(self.vocabulary)
        drive = self.driving[term]
        w, t = window[drive], term[drive]
        length = self.starts[t + 1] - self.starts[t]
        place = np.repeat(self.starts[t] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        pair, group = np.unique(np.repeat(w, length) * len(self.common_bound) + self.block_of[place], return_inverse=True)
        bound = np.bincount(group, weights=self.block_max[place], minlength=len(pair)) + self.common_bound[pair % len(self.common_bound)]
        best: dict[tuple[int, int], float] = {}
        for p in pair[bound >= threshold - 1e-9].tolist():
            v, block = divmod(p, len(self.common_bound))
            lo, hi = np.searchsorted(window, (v, v + 1))
            owner = int(np.searchsorted(first, v, side="right")) - 1
            while windows[owner] == 0:
                owner -= 1
            for piece, score in self.wand(term[lo:hi].tolist(), block, threshold):
                k = owner, self.owner[piece]
                best[k] = max(best.get(k, 0.0), score)
        for (owner, item), score in sorted(best.items()):
            yield owner, item, score


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def held_items(index: Index, part: np.ndarray, at: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of every verified item of every row of a run."""
    hashes, row = terms(part, at)
    grams: tuple[int, np.ndarray] = (-1, hashes[:0])
    for r, item, score in index.search(hashes, row, len(at) - 1, threshold):
        if grams[0] != r:
            lo, hi = np.searchsorted(row, (r, r + 1))
            grams = r, np.concatenate([trigrams(hashes[lo:hi]), hashes[lo:hi]])  # parts of fewer than three terms match by terms
        question, answer = (_share(x, grams[1]) for x in index.parts[item])
        if question >= overlap and answer >= overlap:
            yield r, index.items[item], score, question, answer


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces and terms of each item (last column)."""
    for batch in batches:
        n = np.array([len(terms_of(x.as_py())) for x in batch.column(batch.num_columns - 1)], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(-(-n // (WINDOW // 2))), pa.array(n)], ["pieces", "terms"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each item (shard, text) and how many of its pieces hold each."""
    for batch in batches:
        for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = terms_of(text)
            pairs = np.unique(np.column_stack([t, (np.arange(len(t)) // (WINDOW // 2)).astype(np.uint64)]), axis=0)
            h, n = np.unique(pairs[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(h), pa.int64()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["shard", "term", "n"])


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes over all items, of about ``SHARD`` and ``SHARD_TERMS`` each; the driver holds one at a time.

    Pieces, terms and the pieces that hold a term are counted over all items in Spark; an index gets those of its terms.
    Common terms are chosen by index: they steer the search only and change no score. An item is never split.
    """
    slim = items.select("item_id", F.col("text").cast("string").alias("text"))
    all_of = slim.mapInArrow(_sizes, "pieces long, terms long").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pieces", "terms"))).first()
    shards = max(-(-all_of["n"] // SHARD), -(-all_of["terms"] // SHARD_TERMS))
    if shards > 1:
        slim = slim.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
        here = slim.select("shard", "text").mapInArrow(_held, "shard long, term long, n long").groupBy("shard", "term").agg(F.sum("n").alias("n"))
        here = written(here, "shard_terms")
        df = written(here.select("shard", "term").join(here.groupBy("term").agg(F.sum("n").alias("df")), "term"), "term_counts")
    for k in range(shards):
        part, counts = slim, None
        if shards > 1:
            part, got = slim.where(F.col("shard") == k), df.where(F.col("shard") == k).select("term", "df").toArrow()
            h = got.column("term").to_numpy().view(np.uint64)
            counts = Counts(all_of["pieces"], all_of["terms"], dict(zip(h.tolist(), got.column("df").to_pylist(), strict=True)))
        index = Index([(r.item_id, r.text) for r in part.orderBy("item_id", "text").toLocalIterator()], counts=counts)
        if index.items:
            yield index


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: one row per document and test item that it holds.

    ``docs`` has doc_id and text, ``items`` item_id and text. Null or empty texts and texts without terms hold and match
    nothing. Rows that repeat a document or an item are judged each. Documents with a null id come with a null id. Texts
    are searched whole, however long: in windows, each of which is scored. Empty tables give an empty result. Other
    columns are not used. Items shorter than three terms match by their terms. Documents are read once for each index.
    """
    spark: SparkSession = docs.sparkSession

    def searched(index: Index) -> DataFrame:
        held = spark.sparkContext.broadcast(index)  # SHARD items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, out = batch.column(0), []
                for first, part, at in tb.runs(*tb.strings(batch.column(1))):
                    out += [(ids[first + r].as_py(), *rest) for r, *rest in held_items(held.value, part, at, threshold, overlap)]
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)

    out = spark.createDataFrame([], SCHEMA)
    for i, index in enumerate(indexes(items)):
        out = out.union(searched(index)) if i else searched(index)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no test item. Null and empty texts stay; texts are searched whole."""
    place = docs.columns.index("text")

    def filtered(rows: DataFrame, index: Index) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast(index)  # SHARD items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, part, at in tb.runs(*tb.strings(batch.column(place))):
                    keep = np.ones(len(at) - 1, bool)
                    for r, *_ in held_items(held.value, part, at, threshold, overlap):
                        keep[r] = False
                    yield batch.slice(first, len(keep)).filter(pa.array(keep))

        return rows.mapInArrow(run, docs.schema)

    for index in indexes(items):
        docs = filtered(docs, index)
    return docs
