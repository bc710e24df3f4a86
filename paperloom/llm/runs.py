"""Periodic runs of words by the runs theorem.

A run is a stretch with a smallest period q that holds its root more than once and that no neighbour extends. Each run has
a Lyndon root that is the longest Lyndon word at its place under one of two opposite orders of the alphabet, and the
longest Lyndon word at a place ends where the inverse suffix array next falls below the place's own value. So every place
gives two candidate roots; how far a root repeats to the right is the common prefix of two suffixes (the least value of a
stretch of the LCP array, by a sparse table), and to the left the same of the reversed words.

Tasks work on many documents at once: words become numbers, and documents follow each other with alphabets of their own,
each below the one before, so a suffix never agrees past its document's end and the end counts as less than any word.
Everything is kept in arrays of a number a word, some 200 bytes a word at most; the sparse table is built a level at a
time and asked for all ranges of that level, so it is never held whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: Words and repeats of the root that make a stretch worth a row, unless a caller says otherwise.
LEAST_WORDS, LEAST_REPEATS = 24, 3


def _suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by doubling; only suffixes that still tie are sorted again."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    new = np.ones(n, bool)
    new[1:] = s[sa[1:]] != s[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k, tied = 1, _tied(new)
    while len(tied):
        at = sa[tied]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        sa[tied], new[tied] = at, fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied, k = tied[_tied(fresh)], 2 * k
    return sa, rank


def _tied(new: np.ndarray) -> np.ndarray:
    """Places in groups of more than one; ``new`` marks each group's first."""
    return np.flatnonzero(~(new & np.append(new[1:], True)))


def _agree(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common prefixes of suffixes i and j, by comparison: word by word, then what is left in growing blocks."""
    n, out = len(s), np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for step in range(16):
        a, b = i[live] + step, j[live] + step
        inside = np.maximum(a, b) < n
        live = live[inside]
        live = live[s[a[inside]] == s[b[inside]]]
        out[live] += 1
    for x in live:
        a, b, block = i[x] + 16, j[x] + 16, 64
        while (m := min(block, n - max(a, b))) > 0:
            differ = s[a : a + m] != s[b : b + m]
            if differ.any():
                out[x] += int(differ.argmax())
                break
            out[x], a, b, block = out[x] + m, a + m, b + m, 2 * block
    return out


class Suffixes:
    """Suffix array, inverse and LCP array of a sequence of numbers."""

    def __init__(self, s: np.ndarray):
        self.sa, self.rank = _suffix_array(s)
        n = len(s)
        before = np.full(n, -1)  # the suffix that precedes each in the order
        before[self.sa[1:]] = self.sa[:-1]
        # where the words before two neighbours agree too, the prefix is one less than that of the place before;
        # elsewhere it is compared, and those lengths add up to n log n at most
        own = np.ones(n, bool)
        i = np.arange(1, n)
        own[1:] = (before[1:] <= 0) | (s[i - 1] != s[before[1:] - 1])
        length = np.zeros(n, np.int64)
        ask = np.flatnonzero(own & (before >= 0))
        length[ask] = _agree(s, ask, before[ask])
        from_ = np.maximum.accumulate(np.where(own, np.arange(n), 0))
        self.lcp = (length[from_] - (np.arange(n) - from_))[self.sa]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes i and j, which differ: least LCP values of stretches, level by level."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out, table = np.zeros(len(i), np.int64), self.lcp
        by = np.argsort(level, kind="stable")
        edge = np.searchsorted(level[by], np.arange(level.max(initial=-1) + 2))
        for k in range(len(edge) - 1):
            if k:
                half = 1 << (k - 1)
                table = np.minimum(table[:-half], table[half:])
            q = by[edge[k] : edge[k + 1]]
            out[q] = np.minimum(table[low[q]], table[high[q] + 1 - (1 << k)])
        return out

    def next_smaller(self) -> np.ndarray:
        """Where the inverse next falls below each place's value; the end, if it doesn't. Minima of blocks are climbed."""
        a, n = self.rank, len(self.rank)
        levels = [a]
        while len(levels[-1]) > 1:
            last = levels[-1]
            last = np.append(last, n) if len(last) % 2 else last
            levels.append(np.minimum(last[::2], last[1::2]))
        block, height = np.arange(1, n + 1), np.zeros(n, np.int64)  # the block looked at, and its level
        live = np.arange(n)
        for k, mins in enumerate(levels):
            height[live] = k
            b = block[live]
            inside = b < len(mins)
            less = np.zeros(len(live), bool)
            less[inside] = mins[b[inside]] < a[live[inside]]
            # after a left block comes its sibling, which the parent covers; after a right one the next parent
            live, b = live[~less], b[~less]
            block[live] = (b + b % 2) // 2
        block[live] = n
        height[live] = 0
        for k in range(len(levels) - 1, 0, -1):
            down = np.flatnonzero(height == k)
            left = 2 * block[down]
            block[down] = np.where(levels[k - 1][left] < a[down], left, left + 1)
            height[down] = k - 1
        return block


def runs_of(s: np.ndarray, opposite: np.ndarray, doc: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``least`` words and ``repeats`` roots at least, in order.

    ``s`` and ``opposite`` are the words under the two orders, ``doc`` each word's document.
    """
    none = np.zeros((0, 3), np.int64)
    if not len(s):
        return none
    forward = Suffixes(s)
    starts, ends = [], []
    for f in (forward, Suffixes(opposite)):
        end = f.next_smaller()
        i = np.flatnonzero(end < len(s))
        i = i[doc[i] == doc[end[i]]]
        starts.append(i)
        ends.append(end[i])
    i, j = np.concatenate(starts), np.concatenate(ends)
    q = j - i
    right = forward.common(i, j)
    # a run has a root within its first period, to whose left less than a period is missing
    hopeful = (right > (repeats - 2) * q) & (right + 2 * q > least)
    i, j, q, right = i[hopeful], j[hopeful], q[hopeful], right[hopeful]
    if not len(i):
        return none
    # the reversed words of those documents only
    among = np.zeros(int(doc[-1]) + 1, bool)
    among[doc[i]] = True
    inside = among[doc]
    place = np.cumsum(inside) - 1
    m = place[-1] + 1
    back = Suffixes(s[inside][::-1].copy())
    left, x, y = np.zeros(len(i), np.int64), m - place[i], m - place[j]  # from the word before each
    ask = x < m
    left[ask] = back.common(x[ask], y[ask])
    length = left + q + right
    keep = (length >= least) & (length >= repeats * q)
    start, length, q = (i - left)[keep], length[keep], q[keep]
    order = np.lexsort((q, start))
    found = np.stack([start, length, q], axis=1)[order]
    # both orders, and every root of a long run, find it again
    return found[np.append(True, (found[1:] != found[:-1]).any(axis=1))] if len(found) else none


def _numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all documents as numbers under two opposite orders, and the document of each."""
    codes: dict[bytes, int] = {}
    number = [np.fromiter((codes.setdefault(w, len(codes)) for w in x), np.int64, len(x)) for x in words]
    doc = np.repeat(np.arange(len(words)), [len(x) for x in words])
    flat, below = np.concatenate([*number, np.zeros(0, np.int64)]), (len(words) - 1 - doc) * len(codes)
    return below + flat, below + len(codes) - 1 - flat, doc


def finder(least: int, repeats: int, altered: Callable[[int | None, int], np.ndarray | None] | None):
    """Runs and collapsed texts of Arrow batches (doc_id, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part, at in tb.runs(*tb.strings(batch.column(1))):
                ids = batch.column(0).slice(first, len(at) - 1)
                # bytes are split at the same six characters that part words everywhere here
                words = [part[at[k] : at[k + 1]].tobytes().split() for k in range(len(at) - 1)]
                if altered:
                    for k, id_ in enumerate(ids.to_pylist()):
                        if (source := altered(id_, len(words[k]))) is not None:
                            words[k] = [words[k][i] for i in source]
                s, opposite, doc = _numbered(words)
                found = runs_of(s, opposite, doc, least, repeats)
                start, length, q = found.T
                begin = np.searchsorted(doc, np.arange(len(words) + 1))
                # words after a run's first root go
                edge = np.zeros(len(s) + 1, np.int64)
                np.add.at(edge, start + q, 1)
                np.add.at(edge, start + length, -1)
                stays = np.cumsum(edge)[: len(s)] == 0
                texts = [b" ".join(compress(x, stays[begin[k] : begin[k + 1]].tolist())) for k, x in enumerate(words)]
                owner = doc[start]
                columns = [pa.array(x.astype(np.int64)) for x in (start - begin[owner], length, q)]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(words) + 1)), pa.int32()), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(begin), pa.int64()), lists, pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "text"])

    return find


def collapsed(docs: DataFrame, least: int = LEAST_WORDS, repeats: int = LEAST_REPEATS, altered: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, text`` for each row of ``docs`` (doc_id, text).

    ``runs`` has every stretch of words with a smallest period q and at least ``least`` words and ``repeats`` times q
    that no neighbour extends, as structs of start (word number from 0), length and period, in that order; ``text`` the
    words that no run holds after its first root, joined by one blank. Null and empty texts and texts of blanks have no
    words, no runs and an empty text. Repeated rows get equal results; a null doc_id is kept. Texts are worked on whole.
    Other columns are not used. An empty table gives an empty result. ``altered`` may give, for a doc_id and its number
    of words, the word numbers to read instead.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(finder(least, repeats, altered), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text binary")
    return found.withColumn("text", F.col("text").cast("string"))


def tail_of_one_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's altered tenth of documents: from a word on, the words that follow it repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def summary(found: DataFrame) -> DataFrame:
    """Rows of ``collapsed`` as numbers and digests; the run of greatest exponent is told by exact products."""
    better = lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best)
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    best = found.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), better))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
