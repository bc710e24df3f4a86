"""Repeated byte strings: a sparse suffix array over content-chosen anchors, ordered by deep-shallow sorting.

A string of ``LENGTH`` bytes that occurs twice has the same content twice, so anything chosen from its content is the
same at both places. Every start picks an anchor in its string: the first position whose ``GRAM`` bytes hash least.
Runs of starts with one anchor form a segment, about one per 170 bytes. Starts of equal strings have equal anchor
grams and equal distances to them, so only segments of one anchor gram need a comparison:

* equal segments collapse to one row with a count (a whole hot group is a row); all their starts repeat;
* the distinct segments of a gram are sorted twice by deep-shallow sorting, by the bytes after the anchor and by those
  before it, reversed. With both orders and their common prefixes, the starts at distance ``a`` fall into classes that
  agree on ``a`` bytes before and ``LENGTH - a`` bytes after the anchor; a class of two or more repeats;
* grams with more than ``GROUP`` distinct segments are not gathered. Their starts are cut into cells by distance to the
  anchor, and cells into parts. Hashes are counted with partial sums on every task: of the core that a cell's starts
  share, then of a part's core and of the whole part, and of single starts only in parts of which the core repeats and
  the whole does not. So a member of a hot group makes a few rows where its repeated text ends, not one a byte.

Hashes are told apart by 192 bits at least (gram and two of the content, or gram, two of the core and one of the start).
Strings are judged on the input; removal is the union of all repeated strings.

Passages are found the same way in another alphabet: a text becomes its words, each a code of ``CODE`` bytes, and a
string of ``PASSAGE`` words is one of so many codes. They are only counted; what is removed are strings of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import Salted, Scratch
from .suffix_sort import deep_shallow_order

#: Bytes of a repeated string, and of an anchor's gram.
LENGTH, GRAM = 400, 64
#: Distinct segments of one gram that a task sorts; larger groups are counted by hashes instead.
GROUP = 64
#: Words of a repeated passage and of an anchor's gram, and bytes of a word's code.
PASSAGE, PASSAGE_GRAM, CODE = 51, 8, 4
#: Starts in a cell, and in a part of a cell.
CELL, PART = 32, 4
#: Longer texts are worked on in pieces of so many starts.
PIECE = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values, by least values from block edges to the left and right."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def segments(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First start, number of starts, anchor, gram hash and two content hashes of each segment of a run of rows."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    slices = tb.Slices(buf)
    grams = slices.windows(gram)
    key = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(key, length - gram + 1)
    valid = np.zeros(len(buf) + 1, np.int64)
    room = np.maximum(offsets[1:] - offsets[:-1] - length + 1, 0)
    np.add.at(valid, offsets[:-1], (room > 0).astype(np.int64))
    np.add.at(valid, (offsets[:-1] + room), -(room > 0).astype(np.int64))
    starts = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    lo, n = starts[at], np.diff(np.append(at, len(starts)))
    end = lo + n - 1 + length
    return lo, n, anchor[at], grams[anchor[at]], slices.hashes(lo, end), tb.Slices(buf, seed=1).hashes(lo, end)


def _pieces(buf: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of rows as (first row, bytes, offsets, bytes before in the first row); each start of a long row is in one piece."""
    for first, part, at in tb.runs(buf, offsets, PIECE):
        if len(part) <= PIECE:
            yield first, part, at, 0
        else:
            for base in range(0, len(part), PIECE):
                piece = part[base : base + PIECE + length - 1]
                yield first, piece, np.array([0, len(piece)]), base


def _merged(lo: np.ndarray, hi: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successive runs of starts (in order) that touch, as one."""
    new = np.ones(len(lo), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > hi[:-1] + 1)
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1] if len(lo) else hi, row[at]


FOUND = "doc long, tkey long, lo long, n int, a int, gram long, c1 long, c2 long, times long"


def finder(length: int, gram: int):
    """Segments of texts. Those equal within a run of rows leave one row with their count, and merged spans (gram null)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tkey = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, part, at, base in _pieces(*tb.strings(batch.column(2)), length):
                lo, n, anchor, g, c1, c2 = segments(part, at, length, gram)
                if not len(lo):
                    continue
                row = np.searchsorted(at, lo, side="right") - 1
                order = np.lexsort((c2, c1))
                new = np.ones(len(lo), bool)
                new[1:] = (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(lo)))
                one = order[new]  # the first of each content, as the sort is stable
                again = np.zeros(len(lo), bool)
                again[order] = np.repeat(times > 1, times)
                slo, shi, srow = _merged(lo[again], (lo + n - 1)[again], row[again])
                rows = np.concatenate([row[one], srow])
                m, k = len(one), len(slo)
                blank = np.arange(m + k) >= m
                full = lambda x, y: np.concatenate([x, y])
                nulls = np.zeros(k, np.int64)
                start = full(lo[one], slo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[first + rows]), pa.array(tkey[first + rows]), pa.array(start - at[rows] + base), pa.array(full(n[one], shi - slo + 1), pa.int32()), pa.array(full((anchor - lo)[one], nulls), pa.int32()),
                        pa.array(full(g[one].view(np.int64), nulls), mask=blank), pa.array(full(c1[one].view(np.int64), nulls), mask=blank), pa.array(full(c2[one].view(np.int64), nulls), mask=blank), pa.array(full(times, nulls), pa.int64()),
                    ],
                    ["doc", "tkey", "lo", "n", "a", "gram", "c1", "c2", "times"],
                )

    return find


def _ranges(a: int, n: int, size: int) -> list[tuple[int, int, int]]:
    """The distances a - n + 1 .. a to an anchor, by ranges of ``size``: number, greatest, least."""
    return [(c, min(a, c * size + size - 1), max(a - n + 1, c * size)) for c in range((a - n + 1) // size, a // size + 1)]


def _core(a: int, c: int, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (from, to) of a segment with its anchor at ``a`` that all strings of range ``c`` hold."""
    return np.array([a - c * size]), np.array([a - c * size - size + 1 + length])


CUT = "doc long, tkey long, lo long, n int, a int, gram long, times long, content binary, cell int, k1 long, k2 long, parts array<struct<part:int,core:long,at:long,starts:array<long>>>"


def cutter(length: int, gram: int, cell: int, part: int):
    """The bytes of listed segments, or the cells of those in large groups."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k.split()[0]: [] for k in CUT.split(", ")}
            held = 0
            docs, keys, listed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for i in range(len(docs)):
                text = batch.column(2)[i].as_buffer().to_pybytes() if batch.column(2)[i].is_valid else b""
                for s in listed[i].as_py():
                    lo, n, a = s["lo"], s["n"], s["a"]
                    content = text[lo : lo + n - 1 + length]
                    common = {"doc": docs[i], "tkey": keys[i], "gram": s["gram"], "times": s["times"]}
                    if not s["large"]:
                        rows = [common | {"lo": lo, "n": n, "a": a, "content": content, "cell": None, "k1": None, "k2": None, "parts": None}]
                    else:
                        whole = np.frombuffer(content, np.uint8)
                        one, two = tb.Slices(whole), tb.Slices(whole, seed=1)
                        every, rows = one.windows(length).view(np.int64), []
                        for c, far, near in _ranges(a, n, cell):
                            core = _core(a, c, cell, length)
                            parts = [{"part": p, "core": int(one.hashes(*_core(a, p, part, length)).view(np.int64)[0]), "at": lo + a - f, "starts": every[a - f : a - g + 1].tolist()} for p, f, g in _ranges(far, far - near + 1, part)]
                            rows.append(common | {"lo": lo + a - far, "n": far - near + 1, "a": far, "content": None, "cell": c, "k1": int(one.hashes(*core).view(np.int64)[0]), "k2": int(two.hashes(*core).view(np.int64)[0]), "parts": parts})
                    for r in rows:
                        for k, v in r.items():
                            out[k].append(v)
                    held += len(content) * (8 if s["large"] else 1)  # every start of a large group's segment is a number
                if held > 1 << 22 and i + 1 < len(docs):
                    yield _batch(out)
                    out, held = {k: [] for k in out}, 0
            yield _batch(out)

    return cut


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    parts = pa.list_(pa.struct([("part", pa.int32()), ("core", pa.int64()), ("at", pa.int64()), ("starts", pa.list_(pa.int64()))]))
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [(k, kinds.get(t, parts)) for k, t in (x.split() for x in CUT.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in fields], [k for k, _ in fields])


def repeated_distances(before: list[bytes], after: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Per string the ranges (least, most) of distances ``a`` at which another agrees on ``a`` bytes of ``before`` and ``length - a`` of ``after``."""
    k = len(before)
    (bo, bl), (ao, al) = deep_shallow_order(before), deep_shallow_order(after)
    if k == 2:
        found = [(length - al[1], bl[1])] if length - al[1] <= bl[1] else []
        return [found, found]
    bl_, al_ = np.array(bl), np.array(al)
    most = max(bl)
    # classes change only where a common prefix ends
    at = np.unique(np.concatenate([bl_ + 1, length - al_, [0]]))
    at = at[(at >= length - max(al)) & (at <= most)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(k)]
    if not len(at):
        return out
    ends = np.append(at[1:] - 1, most)
    cb, ca = np.empty((len(at), k), np.int64), np.empty((len(at), k), np.int64)
    cb[:, bo] = (bl_ < at[:, None]).cumsum(axis=1)
    ca[:, ao] = (al_ < length - at[:, None]).cumsum(axis=1)
    # strings too short for the distance are alone: their common prefix with any is shorter
    both = cb * (k + 1) + ca
    order = np.argsort(both, axis=1, kind="stable")
    sorted_ = np.take_along_axis(both, order, 1)
    same = sorted_[:, 1:] == sorted_[:, :-1]
    twin = np.zeros((len(at), k), bool)
    twin[:, 1:] |= same
    twin[:, :-1] |= same
    hit = np.zeros((len(at), k), bool)
    np.put_along_axis(hit, order, twin, 1)
    for i in np.flatnonzero(hit.any(axis=0)):
        out[i] = [(int(at[j]), int(ends[j])) for j in np.flatnonzero(hit[:, i])]
    return out


SPAN = "doc long, tkey long, lo long, hi long"


def sorter(length: int, gram: int):
    """Repeated starts of the segments of each gram; rows come sorted by gram, and a gram's rows in one partition."""

    def group(rows: list[dict]) -> Iterator[tuple]:
        if len(rows) < 2 or all(r["times"] > 1 for r in rows):
            return
        before = [r["content"][: r["a"]][::-1] for r in rows]
        after = [r["content"][r["a"] + gram :] for r in rows]
        for r, ranges in zip(rows, repeated_distances(before, after, length - gram), strict=True):
            if r["times"] == 1:
                anchor = r["lo"] + r["a"]
                yield from ((r["doc"], r["tkey"], anchor - most, anchor - least) for least, most in ranges)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            found: list[tuple] = []
            for r in batch.to_pylist():
                if held and held[0]["gram"] != r["gram"]:
                    found += group(held)
                    held = []
                held.append(r)
            yield _spans(found)
        yield _spans(list(group(held)))

    return sort


def _spans(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SPAN.split(", ")])


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, code=None) -> DataFrame:
    """``doc, tkey, lo, hi``: runs of starts (bytes) in ``docs`` (doc, tkey, text or bytes) whose strings repeat.

    ``code`` turns batches of texts into batches of the bytes to be searched. Runs may overlap. Rows of one doc and tkey have one text and one list of runs, however many they are. The runs are a
    table in the shared folder; all other tables of the search are deleted.
    """
    scratch = Scratch(docs.sparkSession)
    docs, find = docs.select("doc", "tkey", "text"), finder(length, gram)
    # coded and searched by one Python process: one for each of the two steps would double a task's memory
    found = scratch.write(docs.mapInArrow(find if code is None else lambda batches: find(code(batches)), FOUND), "segments")
    if code is not None:
        docs = docs.mapInArrow(code, "doc long, tkey long, text binary")
    segs = found.where("gram IS NOT NULL")
    # counts only: which grams are met twice, and which contents
    same_content = ["gram", "c1", "c2"]
    contents = segs.groupBy(*same_content).agg(F.sum("times").alias("times"), F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("doc", "tkey", "lo", "n", "a")])
    contents = scratch.write(contents, "contents")
    n_segs, n_contents = contents.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count("*")).first()
    grams = scratch.write(contents.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "grams")
    # one gram may have most contents, and one content most segments
    by_gram, by_content = Salted(grams, ["gram"], n_contents), Salted(contents.select(*same_content, "m"), same_content, n_segs)
    multiple = by_gram.join(contents.drop("m"), "c1", grams).withColumn("large", F.col("m") > group)
    listed = multiple.groupBy("doc", "tkey").agg(F.collect_list(F.struct("gram", "times", "lo", "n", "a", "large")).alias("listed"))
    # rows of one doc and tkey are equal: one is cut, and tasks drop others before the shuffle
    texts = docs.select("doc", "tkey", "text").dropDuplicates(["doc", "tkey"]).join(listed, ["doc", "tkey"])
    cut = scratch.write(texts.select("doc", "tkey", "text", "listed").mapInArrow(cutter(length, gram, CELL, PART), CUT), "cut")
    small = cut.where("content IS NOT NULL").select("doc", "tkey", "lo", "n", "a", "gram", "times", "content")
    by_sort = small.repartition("gram").sortWithinPartitions("gram").mapInArrow(sorter(length, gram), SPAN)
    cells = cut.where("cell IS NOT NULL").select("doc", "tkey", "times", "gram", "cell", "k1", "k2", "parts")
    core = ["gram", "cell", "k1", "k2"]
    # keys of one hot group hold many rows: what is counted of them is a table, and joined salted

    def counted(rows: DataFrame, keys: list[str], name: str, *more: Column) -> tuple[DataFrame, Salted]:
        table = scratch.write(rows.groupBy(*keys).agg(F.sum("times").alias("times"), F.count("*").alias("m"), *more).where("times > 1"), name)
        return table, Salted(table.select(*keys, "m"), keys, rows.count())

    def among(rows: DataFrame, by: str, of: tuple[DataFrame, Salted], how: str = "left_semi") -> DataFrame:
        return of[1].join(rows, by, of[0].select(*of[1].keys), how=how)

    cells = among(cells, "doc", counted(cells, core, "met"))
    parts = cells.select("doc", "tkey", "times", *core, F.explode("parts").alias("p")).select("doc", "tkey", "times", *core, "p.*")
    parts = scratch.write(parts.withColumn("n", F.size("starts")).withColumn("whole", F.xxhash64("starts")), "parts")
    same = counted(parts, [*core, "part", "n", "whole"], "same", F.first("core").alias("core"), F.first("starts").alias("starts"))
    by_part = among(parts.where("times = 1"), "doc", same).select("doc", "tkey", F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1).alias("hi"))
    inner = counted(parts, [*core, "part", "core"], "inner")
    open_ = among(among(parts, "doc", same, "left_anti"), "doc", inner)
    # a part met as a whole counts once more against the starts of parts that a segment's end cut short
    cols = [*core, "part", "times", "starts"]
    both = open_.select("doc", "tkey", "at", *cols).union(same[0].select(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"), *cols))
    starts = scratch.write(both.select("doc", "tkey", "at", "times", *core, F.posexplode("starts").alias("i", "h")), "starts")
    twice = counted(starts, [*core, "h"], "twice")
    by_start = among(starts.where("times = 1"), "doc", twice).select("doc", "tkey", (F.col("at") + F.col("i")).alias("lo"), (F.col("at") + F.col("i")).alias("hi"))
    equal = by_content.join(segs, "doc", contents.where("times > 1").select(*same_content), how="left_semi")
    known = found.where("gram IS NULL")
    whole = equal.unionByName(known).select("doc", "tkey", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))
    every = whole.union(by_sort).union(by_part).union(by_start)
    # equal rows find the same runs: of each start the longest is enough, and tasks see to that before the shuffle
    out = scratch.write(every.groupBy("doc", "tkey", "lo").agg(F.max("hi").alias("hi")), "spans")
    scratch.drop(found, contents, grams, cut, parts, starts, same[0], inner[0], twice[0])
    return out


def coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the codes of their words, one after the other."""
    for batch in batches:
        for first, part, at in tb.runs(*tb.strings(batch.column(2))):
            start, end, row = tb.words(part, at)
            codes = (tb.Slices(part).hashes(start, end) >> np.uint64(64 - 8 * CODE)).astype(f"<u{CODE}")
            offsets = np.searchsorted(row, np.arange(len(at))).astype(np.int32) * CODE
            coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, len(at) - 1) for i in (0, 1)), coded], ["doc", "tkey", "text"])


def passages(docs: DataFrame, words: int = PASSAGE, gram: int = PASSAGE_GRAM, group: int = GROUP) -> DataFrame:
    """``spans`` of the words' codes of ``docs`` (doc, tkey, text): runs of ``words`` words and more that occur again."""
    return spans(docs, words * CODE, gram * CODE, group, coder)


def _runs(lows: pa.Scalar, highs: pa.Scalar, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (from, to) that strings of ``length`` cover."""
    if not lows.is_valid or not len(lows):
        return []
    lo, hi = lows.values.to_numpy(), highs.values.to_numpy() + length
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], len(lo)) - 1].tolist(), strict=True))


def remover(length: int, words: int, content: bool):
    """Documents without their repeated bytes, with what is left if ``content``."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sha, kept = [], [], []
            ids, texts, lows, highs, first, last = (batch.column(i) for i in range(6))
            for i in range(len(batch)):
                text = texts[i].as_buffer() if texts[i].is_valid else pa.py_buffer(b"")
                at, digest, parts, gone = 0, hashlib.sha256(), [], _runs(lows[i], highs[i], length)
                for a, b in [*gone, (text.size, text.size)]:
                    digest.update(text.slice(at, a - at))
                    if content:
                        parts.append(text.slice(at, a - at).to_pybytes())
                    at = b
                # a run of codes may reach into words on both sides that differ
                held = [b // CODE - -(-a // CODE) for a, b in _runs(first[i], last[i], words * CODE)]
                held = [n for n in held if n >= words]
                numbers.append((text.size, sum(b - a for a, b in gone), len(gone), len(held), sum(held)))
                sha.append(digest.hexdigest())
                kept.append(b"".join(parts))
            n_bytes, n_removed, n_spans, *held = (pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)) if numbers else [pa.array([], pa.int64())] * 5
            columns = [ids, n_bytes, n_removed, n_spans, pa.array(sha, pa.string()), *held, *([pa.array(kept, pa.binary())] if content else [])]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")][: len(columns)])

    return remove


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, words: int = PASSAGE, content: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words, kept`` for each row of ``docs`` (doc_id, text).

    ``kept`` are the bytes that are left, given if ``content``. ``n_passages`` counts the maximal runs of words that
    ``words`` successive words cover which occur again anywhere, whatever blanks part them, and ``n_passage_words``
    their words; they are not removed unless their bytes are (a word is told by 32 bits here).

    A null text is empty. Rows are documents of their own: rows that repeat a doc_id and text repeat each other's bytes.
    A null doc_id is a value like others. A cut may part a multi-byte character, so ``kept`` is binary. Texts shorter
    than ``length`` bytes and ``words`` words lose nothing and hold no passage. Texts are worked on whole, however long.
    An empty table gives an empty result. Other columns are not used.
    """
    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("doc_id", text).alias("tkey"))
    # a text of fewer bytes than either kind of string takes no part, and its row needs no join
    long = F.coalesce(F.octet_length("text") >= min(length, 2 * words - 1), F.lit(False))
    both = spans(keyed.where(long), length, gram, group).withColumn("bytes", F.lit(True)).union(passages(keyed.where(long), words, group=group).withColumn("bytes", F.lit(False)))
    lists = both.groupBy("doc", "tkey").agg(*(F.collect_list(F.when(F.col("bytes") == kind, F.col(c))).alias(f"{c}{kind}") for kind in (True, False) for c in ("lo", "hi")))
    given = ["doc_id", "text", "loTrue", "hiTrue", "loFalse", "hiFalse"]
    none = F.lit(None).cast("array<long>")
    joined = keyed.where(long).join(lists, ["doc", "tkey"], "left").select(*given).union(keyed.where(~long).select("doc_id", "text", none, none, none, none))
    return joined.select(F.col("doc_id").cast("long"), *given[1:]).mapInArrow(remover(length, words, content), OUT if content else OUT.rpartition(", ")[0])
