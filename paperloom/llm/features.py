"""Hashed features of whole texts: words and character n-grams, vectorised over runs of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textbytes as tb


def hashed(part: np.ndarray, at: np.ndarray, buckets: int, grams: tuple[int, ...], lower: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) arrays, rows ascending: of all words, then of the character n-grams of each size in ``grams``.

    N-grams are of code points, blanks included, inside one row. Words and each size have hashes of their own.
    """
    slices = tb.Slices(part, lower=lower)
    start, end, row = tb.words(part, at)
    out = [(slices.hashes(start, end) ^ np.uint64(0x5851F42D4C957F2D), row)]
    first = np.flatnonzero((part & 0xC0) != 0x80)
    bounds = np.append(first, len(part))
    owner = np.searchsorted(at, first, side="right") - 1
    for n in grams:
        if len(first) >= n:
            same = owner[n - 1 :] == owner[: len(first) - n + 1]
            begin = first[: len(first) - n + 1][same]
            out.append((slices.hashes(begin, bounds[n:][same]), owner[: len(first) - n + 1][same]))
    mask = np.uint64(buckets - 1)
    return [((h & mask).astype(np.int64), r) for h, r in out]


def summed(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (one or more columns) by ascending ``row``."""
    at = np.searchsorted(row, np.arange(n + 1))
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def means(part: np.ndarray, at: np.ndarray, table: np.ndarray, grams: tuple[int, ...], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per row the mean of its features' rows of ``table`` and their number; zeros where a row has none."""
    n = len(at) - 1
    total, count = np.zeros((n, *table.shape[1:])), np.zeros(n, np.int64)
    for bucket, row in hashed(part, at, len(table), grams, lower):
        total += summed(table[bucket], row, n)
        count += np.bincount(row, minlength=n)
    return total / np.maximum(count, 1).reshape(-1, *[1] * (table.ndim - 1)), count


def counts(batches: Iterator[pa.RecordBatch], buckets: int, grams: tuple[int, ...], lower: bool) -> Iterator[pa.RecordBatch]:
    """Distinct buckets and their counts of each text (last column), after the other columns."""
    for batch in batches:
        for first, part, at in tb.runs(*tb.strings(batch.column(batch.num_columns - 1))):
            found = hashed(part, at, buckets, grams, lower)
            key = np.concatenate([row * buckets + bucket for bucket, row in found])
            key, times = np.unique(key, return_counts=True)
            ends = np.searchsorted(key, np.arange(len(at)) * buckets).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % buckets, times)]
            yield pa.RecordBatch.from_arrays([*(c.slice(first, len(at) - 1) for c in batch.columns[:-1]), *lists], [*batch.schema.names[:-1], "bucket", "times"])


def word_prefixes(part: np.ndarray, at: np.ndarray, buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all lower-cased words and of their first ``sizes`` characters, where a word has as many."""
    slices = tb.Slices(part, lower=True)
    start, end, row = tb.words(part, at)
    first = np.flatnonzero((part & 0xC0) != 0x80)
    bounds, begin, close = np.append(first, len(part)), np.searchsorted(first, start), np.searchsorted(first, end)
    found, rows = [slices.hashes(start, end)], [row]
    for n in sizes:
        long = close - begin >= n
        found.append(slices.hashes(start[long], bounds[begin[long] + n]) ^ np.uint64(0x5851F42D4C957F2D + n))
        rows.append(row[long])
    return (np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int64), np.concatenate(rows)


def labelled(docs, labels, label: str, most: int):
    """``doc_id``, the label and the text of ``most`` labelled documents at most, those whose ids hash least.

    Of rows that repeat a doc_id, the text that hashes least is taken; of labels that repeat one, the greatest.
    """
    from pyspark.sql import functions as F

    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    # labels without a document don't use up the bound
    ids = ids.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # ``most`` rows: a bound of its own
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return texts.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"), first)
