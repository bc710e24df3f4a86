"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

A document is its set of word shingles. One permutation of the hash space is cut into ``BANDS * ROWS`` bins; a bin keeps
its least hash, and an empty one borrows from a bin that a universal hash of (bin, attempt) picks, until that bin has a
value (optimal densification). ``ROWS`` bins make a band, a band's value a bucket. With 60 bands of 6 rows a pair at
similarity 0.8 misses all buckets with probability ``(1 - 0.8 ** 6) ** 60``, about 1e-8.

Equal sets collapse to one representative before anything is paired. In a bucket, every member is tied to the centre, the
member that meets most others over all buckets: m - 1 edges, not m * m. Edges are confirmed on full sets. Where members of
a bucket are still in different components, two members that link share a shingle among the first few of their sets in any
fixed order (prefix filter with positions). The order puts the centre's shingles last, so what all members have in common
deals nobody together; lists of members by such a shingle are small buckets, which get stars too, with more and more of
their members as centres, against members of other components only, until each list is one component or all its members
have been centres: no link of a bucket is lost. Buckets, lists and groups of equal sets with many members are dealt out to
several tasks wherever a table is joined to their members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .shared import Salted, Scratch

BANDS, ROWS = 60, 6
#: Ids (8 bytes each) that are sent to all tasks at most, to pick their sets before a shuffle.
FEW_IDS = 100_000
#: Shingle words and least similarity in per cent, unless a caller says otherwise.
WORDS, PERCENT = 5, 80


@lru_cache(1)
def _picks(bins: int, attempts: int = 256) -> np.ndarray:
    """The bin that each empty bin asks at each attempt."""
    at = np.arange(attempts, dtype=np.uint64)[:, None] * np.uint64(bins) + np.arange(bins, dtype=np.uint64)
    return (tb.mixed(at + np.uint64(77)) % np.uint64(bins)).astype(np.int64)


def densified(sig: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Signatures (rows x bins) with values for empty bins; rows without any value stay as they are."""
    out, bins = sig.copy(), sig.shape[1]
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        table = _picks(bins)
        # after the table's end a shifted bin asks, so that attempts never run out
        pick = table[attempt % len(table), (col + attempt // len(table)) % bins]
        got = filled[row, pick]
        out[row[got], col[got]] = sig[row[got], pick[got]]
        row, col = row[~got], col[~got]
        attempt += 1
    return out


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    at = np.searchsorted(row, np.arange(n + 1))
    return ends[at[1:]] - ends[at[:-1]]


def signer(size: int, bands: int, rows: int):
    bins = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tb.strings(batch.column(2))
            for first, part, at in tb.runs(buf, offsets):
                n = len(at) - 1
                h, row = _distinct(*tb.shingles(part, at, size))
                count = np.bincount(row, minlength=n)
                bin_ = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
                least = np.ones(len(h), bool)
                least[1:] = (bin_[1:] != bin_[:-1]) | (row[1:] != row[:-1])
                sig, filled = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
                sig[row[least], bin_[least]] = h[least]
                filled[row[least], bin_[least]] = True
                sig = densified(sig, filled).reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (n, bands))
                for i in range(rows):
                    key = tb.mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, :, i])
                lists = pa.ListArray.from_arrays(pa.array(np.where(count > 0, bands, 0).cumsum() - np.where(count > 0, bands, 0), pa.int32()).tolist() + [int((count > 0).sum()) * bands], pa.array(np.ascontiguousarray(key[count > 0]).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, n) for i in (0, 1)), pa.array(count, pa.int64()), pa.array(_sums(tb.mixed(h ^ np.uint64(1)), row, n).view(np.int64)), pa.array(_sums(tb.mixed(h ^ np.uint64(2)), row, n).view(np.int64)), lists],
                    ["doc_id", "tkey", "n", "d1", "d2", "bands"],
                )

    return sign


def setter(size: int):
    """Sorted full shingle sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = tb.strings(batch.column(1))
            for first, part, at in tb.runs(buf, offsets):
                h, row = _distinct(*tb.shingles(part, at, size))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(at))), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), lists], ["id", "shingles"])

    return sets


def _by(rows: DataFrame, key: str) -> Salted:
    """Joins of ``rows`` (a table) by ``key``, of which a few may hold most rows."""
    return Salted(rows.groupBy(key).agg(F.count("*").alias("m")), [key], rows.count())


def _confirmed(scratch: Scratch, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity; a centre is in many pairs, on either side."""
    pairs = scratch.write(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if ids.count() <= FEW_IDS:
        # later rounds ask for few sets: those alone are shuffled
        sets = sets.join(F.broadcast(ids), "id", "left_semi")
    one = _by(pairs, "a").join(pairs, "b", sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")))
    both = _by(pairs, "b").join(one, "a", sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")))
    shared = F.size(F.array_intersect("sa", "sb"))
    found = scratch.write(both.where(F.lit(100) * shared >= F.lit(percent) * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "links")
    scratch.drop(pairs)
    return found


def _close(n: str, m: str, percent: int) -> Column:
    """Set sizes that allow the similarity at all."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """Shingles that sets of two sizes share at least if they link."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _bits(hashes: Column) -> Column:
    """128 bits, one for each class of hashes that occurs."""
    one = F.lit(1).cast("long")
    half = lambda k: F.aggregate(F.filter(hashes, lambda x: F.shiftright(x, 6).bitwiseAND(1) == k), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int"))))
    return F.array(half(0), half(1))


def _count(f, *masks: str) -> Column:
    return sum((F.bit_count(f(*[F.col(m)[k] for m in masks])) for k in (0, 1)), F.lit(0))


def _lists(docs_sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """``a, na, token, pos, id, n, own, gaps, marks``: the first shingles of every member ``id`` of a star ``a``, those of the centre last.

    ``own`` is the number of a member's shingles that the centre hasn't, and ``gaps`` a bit for each class of hashes in
    which it lacks one of the centre's: the bits of two members together count no more than what either lacks of it.
    ``marks`` are such bits of a member's own shingles: a bit that another has not stands for one that they don't share.
    """
    least = stars.groupBy("a").agg(F.min("n").alias("least"))
    centres = docs_sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    both = _by(stars, "a").join(stars, "id", least, centres).join(docs_sets.select("id", F.col("shingles").alias("sb")), "id")
    ordered = F.concat(F.array_sort(F.array_except("sb", "sa")), F.array_sort(F.array_intersect("sb", "sa")))
    partner = F.greatest("least", F.ceil(F.lit(percent) * F.col("n") / 100))
    length = (F.col("n") - _least_shared(F.col("n"), partner, percent) + 1).cast("int")
    cut = both.select("a", F.size("sa").alias("na"), "id", "n", F.array_except("sb", "sa").alias("more"), F.array_except("sa", "sb").alias("less"), F.slice(ordered, F.lit(1), length).alias("first"))
    # numbers of a row are made before it is dealt out by its first shingles
    counted = cut.select("a", "na", "id", "n", F.size("more").alias("own"), _bits(F.col("less")).alias("gaps"), _bits(F.col("more")).alias("marks"), "first")
    return counted.select("a", "na", "id", "n", "own", "gaps", "marks", F.posexplode("first").alias("pos", "token"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def _sets(scratch: Scratch, docs: DataFrame, equal: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Sorted shingle sets by ``id``, each from the very text of its representative; tasks drop equal rows before the shuffle."""
    wanted = equal.join(ids, "id", "left_semi").select("id", "doc_id", "tkey")
    texts = _keyed(docs).dropDuplicates(["doc_id", "tkey"]).join(wanted, ["doc_id", "tkey"]).select("id", "text")
    return scratch.write(texts.mapInArrow(setter(size), "id long, shingles array<long>"), "sets")


def _relabelled(scratch: Scratch, labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after more ``links`` (a, b): components of components, as few as the links join."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    every = scratch.write(labels.union(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))), "labels")
    name = lambda c: every.select(F.col("id").alias(c), F.col("component").alias(c + c))
    joined = components(scratch, links.join(name("a"), "a").join(name("b"), "b").select(F.col("aa").alias("a"), F.col("bb").alias("b")))
    found = every.join(joined.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    found = scratch.write(found, "labels")
    scratch.drop(every, labels, joined)
    return found


def _of_one_document(scratch: Scratch, real: DataFrame, equal: DataFrame) -> DataFrame | None:
    """Links (a, b) between the sets of rows that repeat a doc_id with another set; none where no id has several."""
    key, sets = F.xxhash64("n", "d1", "d2"), ["n", "d1", "d2"]
    several = real.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("m")).where("lo < hi").select("doc_id", "m")
    several = scratch.write(several, "several")
    if not (total := several.agg(F.sum("m")).first()[0]):
        return None
    by_id = Salted(several, ["doc_id"], total)
    named = by_id.join(real.select("doc_id", *sets), "d1", several.select("doc_id"), how="left_semi").distinct().join(equal.select("id", *sets), sets)
    named = scratch.write(named.select("doc_id", "id"), "named")
    first = named.groupBy("doc_id").agg(F.min("id").alias("a"))
    return by_id.join(named, "id", first).where("a < id").select("a", F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` says that it is the row's own. Null and empty
    texts and texts of blanks have no shingles, link with nothing and are kept. A doc_id names one document: rows that
    repeat it, with the same text or others, are in one component and link by each of their texts. Rows with a null
    doc_id have a null component, link with nothing and are kept. Texts are worked on whole, however long. Columns
    beyond doc_id and text are not used. An empty table gives an empty result, in any order of rows the same.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(_keyed(docs).mapInArrow(signer(size, bands, rows), "doc_id long, tkey long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    # a row for each set: the representative is a row of the smallest id, and id is the set's own number
    first = F.min(F.struct("doc_id", "tkey")).alias("r")
    equal = real.groupBy("n", "d1", "d2").agg(first, F.count("*").alias("m"), F.first("bands").alias("bands"))
    equal = scratch.write(equal.select(F.monotonically_increasing_id().alias("id"), "n", "d1", "d2", "m", "r.*", "bands"), "equal")
    dealt = equal.select("id", "n", F.explode("bands").alias("bucket"))
    shared = scratch.write(dealt.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    by_bucket = Salted(shared, ["bucket"], shared.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    met = scratch.write(by_bucket.join(dealt, "id", shared), "met")
    popular = met.groupBy("id").agg(F.sum("m").alias("mates"))
    known = scratch.write(met.join(popular, "id"), "known")
    centres = known.groupBy("bucket").agg(F.max(F.struct("mates", -F.col("id"), "n")).alias("c")).select("bucket", (-F.col("c.col2")).alias("a"), F.col("c.n").alias("na"))
    tied = scratch.write(by_bucket.join(known, "id", centres).where("a <> id").select("bucket", "m", "a", "na", "id", "n"), "tied")
    scratch.drop(met, known)
    ordered = (F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    pairs = tied.where(_close("na", "n", percent)).select(*ordered).distinct()
    sets = _sets(scratch, docs, equal, tied.select(F.explode(F.array("a", "id")).alias("id")).distinct(), size)
    confirmed = _confirmed(scratch, sets, pairs, percent)
    of_one = _of_one_document(scratch, real, equal)
    labels = components(scratch, confirmed if of_one is None else confirmed.union(of_one))
    scratch.drop(confirmed)

    def labelled(members: DataFrame) -> DataFrame:
        return members.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    mixed = (F.min("label").alias("lo"), F.max("label").alias("hi"))
    now = labelled(tied.where("m > 2"))
    split = now.groupBy("bucket").agg(*mixed).where("lo < hi").select("bucket")
    stars = scratch.write(by_bucket.join(now, "id", split).select("a", "id", "n").distinct(), "stars")
    scratch.drop(tied, shared)
    lists, asked = scratch.write(_lists(sets, stars, percent), "lists"), 0
    while n_rows := lists.count():
        before, list_of = lists, ["a", "token"]
        now = labelled(lists)
        open_ = now.groupBy(*list_of).agg(F.count("*").alias("m"), *mixed).where((F.col("lo") < F.col("hi")) & (F.col("m") > asked)).select(*list_of, "m")
        lists = scratch.write(Salted(open_, list_of, n_rows).join(lists.drop("m"), "id", open_), "lists")
        scratch.drop(before)
        by_list = Salted(lists.select(*list_of, "m").distinct(), list_of, n_rows)
        more = 8 * asked if asked else 1
        if asked:
            # each member's turn comes by its hash; when ``more`` is a list's size, all have had it
            turn = (F.pmod(F.xxhash64("id", "token"), F.lit(1 << 30)) / (1 << 30)) * F.col("m")
            ranked = labelled(lists).withColumn("turn", turn)
            stand = ranked.where((F.col("turn") >= (asked if asked > 1 else 0)) & (F.col("turn") < more))
        else:
            mates = lists.groupBy("a", "id").agg(F.sum("m").alias("mates"))
            ranked = labelled(lists).join(mates, ["a", "id"])
            # the member with most mates stands: its own row is what is wanted of it
            best = F.max(F.struct("mates", -F.col("id"), "id", "n", "pos", "own", "gaps", "marks", "label")).alias("c")
            stand = ranked.groupBy(*list_of).agg(best).select(*list_of, "c.id", "c.n", "c.pos", "c.own", "c.gaps", "c.marks", "c.label")
        stand = stand.select(*list_of, F.col("id").alias("c"), F.col("n").alias("nc"), F.col("pos").alias("pc"), F.col("own").alias("oc"), F.col("gaps").alias("gc"), F.col("marks").alias("mc"), F.col("label").alias("lc"))
        need = _least_shared(F.col("n"), F.col("nc"), percent)
        fit = (F.col("id") != F.col("c")) & (F.col("label") != F.col("lc")) & _close("n", "nc", percent) & (F.col("pos") <= F.col("n") - need) & (F.col("pc") <= F.col("nc") - need)
        # what two members share of the centre, and, if their first common shingle is not the centre's, of their own
        only = lambda x, y: x.bitwiseAND(F.bitwise_not(y))
        common = F.least(F.col("own") - _count(only, "marks", "mc"), F.col("oc") - _count(only, "mc", "marks"))
        most = F.col("na") - _count(lambda x, y: x.bitwiseOR(y), "gaps", "gc") + F.when(F.col("pos") < F.col("own"), common).otherwise(0)
        fit &= most >= need
        new = by_list.join(ranked, "id", stand).where(fit).select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct()
        asked, links = more, _confirmed(scratch, sets, new, percent)
        if not links.isEmpty():
            labels = _relabelled(scratch, labels, links)
        scratch.drop(links)
    # a component's name is the smallest doc_id of its sets
    smallest = labels.join(equal.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    key = ["n", "d1", "d2"]
    by_set = scratch.write(equal.join(labels.join(smallest, "component").select("id", "component_id"), "id", "left").select(*key, "m", F.coalesce("component_id", "doc_id").alias("component_id")), "by_set")
    scratch.drop(sets, stars, lists, labels, equal)
    by_key = Salted(by_set.select(*key, "m"), key, signed.count())
    out = by_key.join(real.select("doc_id", *key), "doc_id", by_set.drop("m"))
    # rows without words or id need no join
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n", "component_id").union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
