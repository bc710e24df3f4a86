"""Language of words and documents: a linear-chain conditional random field.

The words of a text (runs of letters) are a chain whose states are the languages. A word's scores come from its hashed
character n-grams with both edges marked (those at an edge are its affixes), from the whole word, and from a lexicon: how
the documents that hold the word part among the languages. Learned transitions say how languages follow each other. Forward
and backward passes give every word's chances; a document's language has the greatest sum of them.

The lexicon counts words over all training documents, as one aggregation. Weights are trained on the driver on a bounded
sample: fragments of at most ``DOCS_EACH`` documents a language, strung together across languages, so that the chains
switch and the transitions have something to learn from.

A chain is a product of matrices, so tasks cut texts into blocks of words, multiply out all blocks at once, carry one
vector from block to block, and then pass through all blocks at once again. A long text takes a matrix a block, and its
words' chances are made a slab of blocks at a time.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import features
from . import textbytes as tb

#: A word: a letter, then letters and marks. The same in Python and on the JVM.
WORD = r"\p{L}[\p{L}\p{M}]*"
BUCKETS, GRAMS = 1 << 17, (2, 3, 4)
#: Bounds of what is learned from: words of the lexicon, and documents of a language whose fragments train the weights.
LEXICON, LEAST_DOCS, DOCS_EACH = 20_000, 3, 400
#: A word of the lexicon is in one of so many documents at least.
ONE_IN = 20_000
#: Fragments of a sampled document, words of one at most (a third of it on average), and letters of a word that trains.
FRAGMENTS, FRAGMENT_WORDS, WORD_LETTERS = 5, 36, 64
#: Words of a training chain; rounds and step of AdaGrad; weight of squares.
CHAIN, ROUNDS, STEP, DECAY = 96, 30, 0.5, 1e-6
#: Words of a block, and blocks of a slab.
BLOCK, SLAB = 32, 8192
#: Bytes of texts that are labelled together, whose common words get their scores once.
RUN_BYTES = 2 << 20
UNDECIDED = "und"


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # a row of scores for each bucket
    lexicon: dict[str, int]
    shares: np.ndarray  # a row for each word of the lexicon
    trust: np.ndarray  # scores by share
    move: np.ndarray  # scores of a language after another
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Each word's scores, whatever its neighbours."""
        return self.own(*_edged(words)) + self.known(words) @ self.trust

    def own(self, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        return features.means(part, at, self.table, GRAMS)[0]

    def known(self, words: list[str]) -> np.ndarray:
        at = np.fromiter((self.lexicon.get(w.lower(), -1) for w in words), np.int64, len(words))
        return np.where((at >= 0)[:, None], self.shares[at], 0.0) if len(self.shares) else np.zeros((len(words), len(self.langs)))


def _edged(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"\x02{w.lower()}\x03".encode() for w in words]
    at = np.cumsum([0, *map(len, marked)])
    return np.frombuffer(b"".join(marked), np.uint8), at


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


class Chains:
    """Blocks of the words of several documents, for passes over all of them at once.

    ``number`` names each word's row of ``scores``, ``sizes`` each document's words.
    """

    def __init__(self, model: Model, scores: np.ndarray, number: np.ndarray, sizes: np.ndarray):
        self.move, self.start = np.exp(model.move - model.move.max()), np.exp(model.start - model.start.max())
        self.scores, self.number = np.exp(scores - scores.max(axis=1, keepdims=True)), number
        blocks = -(-sizes // BLOCK)
        self.doc = np.repeat(np.arange(len(sizes)), blocks)
        self.turn = np.arange(len(self.doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # the block's number in its document
        begin = np.cumsum(sizes) - sizes
        self.begin = begin[self.doc] + self.turn * BLOCK
        self.words = np.minimum(BLOCK, sizes[self.doc] - self.turn * BLOCK)
        self.last = self.turn == blocks[self.doc] - 1

    def _slabs(self) -> Iterator[slice]:
        for k in range(0, len(self.doc), SLAB):
            yield slice(k, min(k + SLAB, len(self.doc)))

    def _emitted(self, slab: slice) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the slab's words (blocks x words x languages) and which of them exist."""
        at = np.arange(BLOCK)
        there = at < self.words[slab][:, None]
        place = np.where(there, self.begin[slab][:, None] + at, 0)
        return self.scores[self.number[place]], there

    def _steps(self, slab: slice, t: int) -> np.ndarray:
        """The matrices into word ``t`` of each block, before its scores: a document's first word has no word before."""
        n = len(self.start)
        move = np.broadcast_to(self.move, (slab.stop - slab.start, n, n))
        return np.where((self.turn[slab] == 0)[:, None, None], self.start, move) if t == 0 else move

    def chances(self) -> Iterator[np.ndarray]:
        """Every word's chances of each language, in order, a slab of blocks at a time."""
        n, k = len(self.start), len(self.doc)
        product = np.empty((k, n, n))
        for slab in self._slabs():
            emitted, there = self._emitted(slab)
            p = np.broadcast_to(np.eye(n), (slab.stop - slab.start, n, n))
            for t in range(BLOCK):
                p = np.where(there[:, t, None, None], _scaled((p @ self._steps(slab, t)) * emitted[:, t, None, :]), p)
            product[slab] = p
        # one vector from block to block, for all documents that have as many blocks
        into, after = np.full((k, n), 1 / n), np.ones((k, n))
        order = np.argsort(self.turn, kind="stable")
        edge = np.searchsorted(self.turn[order], np.arange(self.turn.max(initial=-1) + 2))
        for r in range(len(edge) - 2):
            here = order[edge[r] : edge[r + 1]]
            here = here[~self.last[here]]
            into[here + 1] = _scaled((into[here, None, :] @ product[here])[:, 0, :])
        for r in range(len(edge) - 3, -1, -1):
            here = order[edge[r] : edge[r + 1]]
            here = here[~self.last[here]]
            after[here] = _scaled((product[here + 1] @ after[here + 1, :, None])[:, :, 0])
        for slab in self._slabs():
            emitted, there = self._emitted(slab)
            ahead, behind = np.empty(emitted.shape), np.empty(emitted.shape)
            v = into[slab]
            for t in range(BLOCK):
                v = np.where(there[:, t, None], _scaled((v[:, None, :] @ self._steps(slab, t))[:, 0, :] * emitted[:, t]), v)
                ahead[:, t] = v
            v = after[slab]
            for t in range(BLOCK - 1, -1, -1):
                behind[:, t] = v
                if t:
                    v = np.where(there[:, t, None], _scaled((v * emitted[:, t]) @ self.move.T), v)
            yield _scaled((ahead * behind)[there])


def train(langs: list[str], lexicon: dict[str, int], shares: np.ndarray, fragments: list[tuple[str, list[str]]], seed: int = 7) -> Model:
    """Weights from fragments (language, words), strung together to chains of several languages."""
    rng, n = random.Random(seed), len(langs)
    zero = np.zeros((n, n))
    model = Model(langs, np.zeros((BUCKETS, n), np.float32), lexicon, shares, zero.copy(), zero.copy(), np.zeros(n))
    if n < 2 or not fragments:
        return model
    order = sorted(fragments)
    rng.shuffle(order)
    codes: dict[str, int] = {}
    flat = [(codes.setdefault(w, len(codes)), langs.index(lang)) for lang, words in order for w in words]
    flat += flat[: -len(flat) % CHAIN]  # the last chain is filled up from the first
    word, gold = (np.array(x).reshape(-1, CHAIN) for x in zip(*flat, strict=True))
    words = list(codes)
    known, (part, at) = model.known(words), _edged(words)
    found = features.hashed(part, at, BUCKETS, GRAMS)
    bucket, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    weight = 1 / np.bincount(owner, minlength=len(words))[owner]
    right, chains = np.eye(n)[gold], len(word)
    pairs = np.bincount((gold[:, :-1] * n + gold[:, 1:]).ravel(), minlength=n * n).reshape(n, n)
    parts = [model.table, model.trust, model.move, model.start]
    squares = [np.full(p.shape, 1e-8, np.float32) for p in parts]
    for _ in range(ROUNDS):
        emitted = (model.own(part, at) + known @ model.trust)[word]
        chance, moved = _expected(emitted, model.move, model.start)
        wrong = (chance - right).reshape(-1, n)
        each = np.stack([np.bincount(word.ravel(), wrong[:, c], len(words)) for c in range(n)], axis=1)
        table = np.stack([np.bincount(bucket, each[owner, c] * weight, BUCKETS) for c in range(n)], axis=1)
        slopes = (table, known.T @ each, moved - pairs, (chance - right)[:, 0].sum(axis=0))
        for p, slope, square in zip(parts, slopes, squares, strict=True):
            slope = slope / (chains * CHAIN) + DECAY * p
            square += slope**2
            p -= STEP * slope / np.sqrt(square)
    return model


def _expected(emitted: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each word of equally long chains, and expected numbers of each transition."""
    e, m = np.exp(emitted - emitted.max(axis=2, keepdims=True)), np.exp(move - move.max())
    ahead, behind = np.empty(e.shape), np.ones(e.shape)
    v = _scaled(np.exp(start - start.max()) * e[:, 0])
    ahead[:, 0] = v
    for t in range(1, e.shape[1]):
        v = _scaled((v @ m) * e[:, t])
        ahead[:, t] = v
    moved = np.zeros(m.shape)
    for t in range(e.shape[1] - 1, 0, -1):
        into = behind[:, t] * e[:, t]
        both = ahead[:, t - 1, :, None] * m * into[:, None, :]
        moved += _scaled(both).sum(axis=0)
        behind[:, t - 1] = _scaled(into @ m.T)
    return _scaled((ahead * behind).reshape(-1, e.shape[2])).reshape(e.shape), moved


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of words from random places of whole texts; the same ones for the same text."""
    pattern = regex.compile(WORD)
    for batch in batches:
        out = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, rng = pattern.findall(text), random.Random(len(text))
            for _ in range(FRAGMENTS if words else 0):
                size = 1 + int((FRAGMENT_WORDS - 1) * rng.random() ** 2)
                first = rng.randrange(max(1, len(words) - size + 1))
                out.append((lang, [w for w in words[first : first + size] if len(w) <= WORD_LETTERS]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))], ["lang", "words"])


def fit(docs: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text, lang), those of a null lang or text left out."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    # one row a word and document, added up before the shuffle
    held = rows.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word"))
    counts = held.where(F.length("word") <= WORD_LETTERS).groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("lang") == x).alias(f"n{i}") for i, x in enumerate(langs)])
    # a share of all documents, so what tasks send for the list doesn't grow with the corpus
    least = max(LEAST_DOCS, sum(sizes.values()) // ONE_IN)
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(LEXICON).collect() if langs else []
    shares = np.array([r[2:] for r in top], float).reshape(len(top), len(langs))
    # texts of the least hashes of each language: first some four times as many as are wanted, told by their hash alone
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 4 * DOCS_EACH / n))]), F.col("lang")) if langs else F.lit(1.0)
    few = hashed.select("lang", "h").where(F.shiftrightunsigned("h", 11) / (1 << 53) <= share).distinct()
    chosen = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= DOCS_EACH).select("lang", "h")
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")  # ``DOCS_EACH`` rows a language
    got = sample.mapInArrow(_fragments, "lang string, words array<string>").collect() if langs else []
    return train(langs, {r.word: i for i, r in enumerate(top)}, shares / shares.sum(axis=1, keepdims=True) if len(top) else shares, [(r.lang, list(r.words)) for r in got])


def tagger(model: Model):
    """Language, score and stretches of one language of Arrow batches (doc_id, text)."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, last, n = regex.compile(WORD), regex.compile(WORD, regex.REVERSE), len(model.langs)
        names = np.array([*model.langs, UNDECIDED], object)
        for batch in batches:
            for first, part, at in tb.runs(*tb.strings(batch.column(1)), RUN_BYTES):
                texts = [part[at[k] : at[k + 1]].tobytes().decode(errors="replace") if n else "" for k in range(len(at) - 1)]
                codes: dict[str, int] = {}
                each = [np.fromiter((codes.setdefault(w, len(codes)) for w in pattern.findall(x)), np.int32) for x in texts]
                sizes = np.array([len(x) for x in each])
                number = np.concatenate([*each, np.zeros(0, np.int32)])
                total, labels, at_word = np.zeros((len(sizes), max(n, 1))), [], 0
                owner = np.repeat(np.arange(len(sizes)), sizes)
                if len(number):
                    for chance in Chains(model, model.scores(list(codes)), number, sizes).chances():
                        labels.append(chance.argmax(axis=1).astype(np.int16))
                        mine = owner[at_word : at_word + len(chance)]
                        docs, where = np.unique(mine, return_index=True)
                        total[docs] += np.add.reduceat(chance, where, axis=0)
                        at_word += len(chance)
                best = np.where(sizes > 0, total.argmax(axis=1), n)
                score = np.where(sizes > 0, total.max(axis=1) / np.maximum(sizes, 1), 0.0)
                label = np.concatenate([*labels, np.zeros(0, np.int16)])
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(label))[: len(head)] - 1
                bounds = np.searchsorted(owner[head], np.arange(len(sizes) + 1))
                begin, end, offset = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), np.cumsum(sizes) - sizes
                for k in np.flatnonzero(np.diff(bounds)):
                    mine = slice(bounds[k], bounds[k + 1])
                    if mine.stop - mine.start == 1:
                        begin[mine], end[mine] = pattern.search(texts[k]).start(), last.search(texts[k]).end()
                    else:
                        place = np.array([m.span() for m in pattern.finditer(texts[k])])
                        begin[mine], end[mine] = place[head[mine] - offset[k], 0], place[tail[mine] - offset[k], 1]
                structs = pa.StructArray.from_arrays([pa.array(begin), pa.array(end), pa.array(names[label[head]], pa.string())], ["start", "end", "lang"])
                spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), spans], ["doc_id", "lang_pred", "score", "spans"])

    return tag


def label(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for each row of ``docs`` (doc_id, text).

    ``score`` is the words' mean chance of ``lang_pred``; of equal languages the first by name is taken. ``spans`` are
    the stretches of words whose own likeliest language is the same (code points, end exclusive). Null texts and texts
    without letters get ``und``, 0 and no spans, as all do where nothing was learned. Texts are worked on whole, however
    long. Repeated rows get equal results. Other columns are not used. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets and lexicon are of fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tagger(held.value)(batches)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def held_out() -> Column:
    """Documents that training never sees: those whose id's CRC-32 is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
