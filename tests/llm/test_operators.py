"""Each numbered operator against a brute-force version, an oracle or held-out labels; and odd tables."""

import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paperloom.llm import bm25, features, html_text, mixing, neardup, pii, quality, queries, repeats, shared, suffix_sort, textbytes, topk, toxicity, url_filter

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, size string, row int, bucket string, score string, label string, tkey int"
EXTRA = ("x", 1, "y", 2, "z", "s", "l", 3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows, null ids and sources, a long text, and columns named like the operators' own."""
    long = " ".join(f"word{i % 911} is{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (None, "one two"), (None, None), (5, long), (6, long), (7, "mail a@b.example and 10.0.0.1"), (8, "é" * 500), (9, "é" * 500)]
    return spark.createDataFrame([(i, t, "en", None if i == 7 else "s", 1, *EXTRA) for i, t in rows], DOCS)


def table(spark, name, sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, "documents", sf).select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL).toArrow(), con.sql(queries.ORACLES[name]).to_arrow_table()
    order = sorted(want.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in order], strict=True)))
    assert sorted(got.column_names) == order and rows(got) == rows(want)


# near duplicates


def components(docs: dict, size: int, percent: int = 80) -> dict:
    """All pairs by brute force."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, up = {}, {d: d for d in docs}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            by[g].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for g in s for e in by[g] if e < d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), top(d)) for d in docs}


def test_near_duplicates(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_minhash(spark, MIDDLE).collect()}
    assert got == components(texts(spark, MIDDLE), 4)


def test_near_duplicates_in_a_group_around_a_late_centre(spark):
    """Copies of one text link with it and often not with each other; others link with copies only."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    docs = {500: " ".join(base)}
    for i in range(160):
        w = list(base)
        for k in rng.choice(150, size=int(rng.integers(2, 8)), replace=False):
            w[k] = f"v{rng.integers(40)}"
        docs[i] = " ".join(w)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, size=4).collect()}
    assert got == components(docs, 4)


def test_near_duplicates_of_repeated_ids(spark):
    """A row that repeats an id with another text links by that text, whatever the order of rows."""
    long = " ".join(f"w{i}" for i in range(100))
    near = " ".join(["v0", *(f"w{i}" for i in range(1, 100))])
    rows = [(7, "short text of seven words for it"), (7, long), (9, near), (3, "short text of seven words for it"), (7, ""), (8, "of another kind altogether it is"), (9, near)]
    want = sorted([(7, 3), (7, 3), (9, 3), (9, 3), (3, 3), (7, 7), (8, 8)])
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        for parts in (1, 3):
            assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df.repartition(parts), size=4).collect()) == want


def test_near_duplicates_with_hot_groups(spark, monkeypatch):
    """The same when keys of ten rows already count as hot."""
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    rng = np.random.default_rng(11)
    base, docs = [f"w{i}" for i in range(60)], {}
    for i in range(120):
        w = list(base)
        for k in rng.choice(60, size=int(rng.integers(0, 4)), replace=False):
            w[k] = f"v{rng.integers(30)}"
        docs[i] = " ".join(w) if i < 90 else ["", "the same few words"][i % 2]
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, size=4).collect()}
    assert got == components(docs, 4)


def test_near_duplicates_odd(spark, odd):
    got = sorted((r.doc_id or 0, r.n_shingles > 0, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert [g for g in got if g[0] in (0, 4)] and (6, True, 5, False) in got and (9, True, 8, False) in got and (1, False, 1, True) in got
    assert [g[2:] for g in got if g[0] == 0] == [(None, True)] * 2
    assert neardup.near_duplicates(odd.where("false")).count() == 0


# repeated bytes


def removed(docs: dict, length: int) -> dict:
    seen = Counter(b[i : i + length] for b in docs.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in docs.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats(spark):
    got = {r.doc_id: tuple(r)[1:5] for r in queries.op10_suffix_array(spark, SMALL).collect()}
    assert got == removed({d: t.encode() for d, t in texts(spark, SMALL).items()}, 400)


@pytest.mark.parametrize("group", [2, 64])
def test_repeats_in_hot_groups(spark, group):
    """One passage in all documents, with endings of many kinds; once with groups sorted, once counted by hashes."""
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh "), size=900))
    docs = {}
    for i in range(40):
        a, b = rng.integers(0, 400), rng.integers(500, 900)
        docs[i] = "".join(rng.choice(list("xyz "), size=rng.integers(0, 60))) + passage[a:b] + "".join(rng.choice(list("uvw"), size=rng.integers(0, 60)))
    docs[40] = docs[41] = "ab" * 700
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.without_repeats(rows, group=group).collect()}
    assert got == removed({d: t.encode() for d, t in docs.items()}, 400)


def test_repeats_with_hot_keys(spark, monkeypatch):
    """The same when keys of five rows already count as hot: a gram of many contents, and a content of many segments."""
    hot = []

    class Seen(shared.Salted):
        def __init__(self, counts, keys, total):
            super().__init__(counts, keys, total)
            if self.hot is not None:
                hot.append(tuple(keys))

    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(repeats, "Salted", Seen)
    rng = np.random.default_rng(5)
    text = lambda letters, n: "".join(rng.choice(list(letters), size=n))
    passage, copy = text("abcdefgh ", 700), text("ijklmnop ", 800)
    docs = {i: text("xyz ", rng.integers(0, 60)) + passage[rng.integers(0, 200) : rng.integers(450, 700)] + text("uvw", rng.integers(0, 60)) for i in range(40)}
    docs |= dict.fromkeys(range(40, 60), copy)
    # copies in runs of rows of their own, so that they don't collapse before they are counted
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(20, "doc_id")
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.without_repeats(rows).collect()}
    assert got == removed({d: t.encode() for d, t in docs.items()}, 400)
    assert ("gram",) in hot and ("gram", "c1", "c2") in hot


def passages(docs: dict, size: int) -> dict:
    """Maximal runs of words that repeated strings of ``size`` words cover, and their words."""
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", b) for d, b in docs.items()}
    seen = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = {}
    for d, w in words.items():
        held = np.zeros(len(w), int)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                held[i : i + size] = 1
        out[d] = (int((np.diff(np.concatenate([[0], held])) == 1).sum()), int(held.sum()))
    return out


def test_repeated_passages(spark):
    """Over 50 words that occur again, other blanks between them too, are a passage also where their bytes are fewer than 400."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefg"), size=rng.integers(2, 7)))
    shared = [word() for _ in range(60)]
    docs = {}
    for i in range(30):
        n = int(rng.integers(48, 61))
        docs[i] = " ".join(word() for _ in range(rng.integers(0, 40))) + " " + ("\n" if i % 2 else " ").join(shared[60 - n :]) + " " + " ".join(word() for _ in range(rng.integers(0, 40)))
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in repeats.without_repeats(rows).collect()}
    want = passages({d: t.encode() for d, t in docs.items()}, 51)
    assert got == want and 10 < sum(n > 0 for n, _ in want.values()) < 30
    got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in queries.op10_suffix_array(spark, SMALL).collect()}
    assert got == passages({d: t.encode() for d, t in texts(spark, SMALL).items()}, 51)


def test_repeats_in_equal_rows(spark):
    """Ten thousand rows of one id and text: each is a document, and their runs are found once."""
    text = " ".join(f"word{i}" for i in range(90))
    rows = spark.range(10_000).selectExpr("1L AS doc_id", f"'{text}' AS text").union(spark.createDataFrame([(2, "x" + text[5:] + "y"), (3, text[:300])], "doc_id long, text string"))
    got = Counter(tuple(r)[:4] for r in repeats.without_repeats(rows, content=False).collect())
    assert got == {(1, len(text), len(text), 1): 10_000, (2, len(text) - 3, len(text) - 5, 1): 1, (3, 300, 0, 0): 1}


def test_repeats_odd(spark, odd):
    got = repeats.without_repeats(odd).collect()
    assert len(got) == odd.count() and {r.n_removed for r in got if r.doc_id in (8, 9)} == {1000} and sum(r.n_bytes == 0 for r in got) == 3
    assert repeats.without_repeats(odd.where("false")).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.choice([97, 98], size=rng.integers(0, 60)).astype(np.uint8)) for _ in range(300)] + [b"a" * 40] * 3
    order, common = suffix_sort.deep_shallow_order(strings)
    found = [strings[i] for i in order]
    assert sorted(order) == list(range(len(strings))) and found == sorted(strings)
    assert common[1:] == [suffix_sort.common_prefix(a, b) for a, b in zip(found, found[1:], strict=False)]


# classifiers


def test_quality_on_held_out_labels(spark):
    got = queries.op1_quality(spark, MIDDLE).join(table(spark, "labels", MIDDLE), "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.quality).mean() > 0.85 and got.score.between(0, 1).all()


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, "documents", MIDDLE), table(spark, "labels", MIDDLE)
    held = F.col("doc_id") % 3 == 0
    models = toxicity.fit(docs, labels.where(~held))
    got = toxicity.score(docs, models).join(labels.where(held).withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    assert (got.toxic.astype(int) == got.y).mean() > 0.93
    assert [len(m.earlier) for m in models] == list(range(len(toxicity.CATEGORIES)))


def hashed(b: bytes, lower: bool = False) -> int:
    """The hash of a slice, by its definition."""
    values, top = textbytes._byte_values(0, lower), 1 << 64
    total = sum(int(values[c]) * pow(int(textbytes._BASE), i, top) for i, c in enumerate(b)) + len(b) * 0xD6E8FEB86659FD93
    return int(textbytes.mixed(np.array([total % top], np.uint64))[0])


WORDS_OF, OTHER = re.compile(r"[^\x20\x09-\x0D]+"), 0x5851F42D4C957F2D
PLAIN_TEXTS = ["The cat sat on the mät", "", "x", "Été à la plage  été", "one two\nthree four five six seven idiot", "ööö ö öö"]


def test_quality_score_by_its_definition(spark):
    """The mean over all words and 2- to 4-grams of the learned table, one by one."""
    rng = np.random.default_rng(13)
    model = quality.Model(rng.normal(size=quality.BUCKETS) * 5, 0.3)
    rows = spark.createDataFrame(list(enumerate(PLAIN_TEXTS)), "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(rows, model).collect()}
    for i, t in enumerate(PLAIN_TEXTS):
        found = [(hashed(w.encode()) ^ OTHER) % quality.BUCKETS for w in WORDS_OF.findall(t)]
        found += [hashed(t[k : k + n].encode()) % quality.BUCKETS for n in quality.GRAMS for k in range(len(t) - n + 1)]
        score = 1 / (1 + np.exp(-(np.mean(model.table[found]) if found else 0) - 0.3))
        assert abs(got[i][0] - score) < 1e-9 and got[i][1] == (score >= 0.5)


def toxic_probabilities(models: list, text: str) -> list[float]:
    """Each link's logistic sum over the buckets that it knows and the probabilities before it."""
    words = WORDS_OF.findall(text)
    held = {hashed(w.encode(), True) % toxicity.BUCKETS for w in words} | {(hashed(w[:n].encode(), True) ^ (OTHER + n)) % toxicity.BUCKETS for w in words for n in toxicity.PREFIXES if len(w) >= n}
    p: list[float] = []
    for m in models:
        z = sum(w for b, w in zip(m.buckets.tolist(), m.weights.tolist(), strict=True) if b in held) + sum(a * b for a, b in zip(m.earlier, p, strict=True)) + m.bias
        p.append(1 / (1 + np.exp(-min(max(z, -60), 60))))
    return p


def test_toxicity_score_by_its_definition(spark):
    rng = np.random.default_rng(14)
    known = sorted({hashed(w.encode(), True) % toxicity.BUCKETS for t in PLAIN_TEXTS for w in WORDS_OF.findall(t)})
    models = [toxicity.Linear(np.array(sorted(rng.choice(known, size=8, replace=False))), rng.normal(size=8), rng.normal(size=j), 0.1) for j in range(len(toxicity.CATEGORIES))]
    rows = spark.createDataFrame(list(enumerate(PLAIN_TEXTS)), "doc_id long, text string")
    for r in toxicity.score(rows, models).collect():
        p = toxic_probabilities(models, PLAIN_TEXTS[r.doc_id])
        assert np.allclose(tuple(r)[1:-1], p) and r.toxic == (p[-1] >= 0.5)


def test_toxicity_learns_kinds_on_any_vocabulary():
    """Two groups of invented words: each gets a kind of its own, and a later link uses what an earlier one says."""
    rng = np.random.default_rng(15)
    n, bucket, row = 900, [], []
    y = np.zeros(n, np.int64)
    for i in range(n):
        own = set(rng.integers(1000, 3000, size=20).tolist())
        if i % 3 == 0:
            y[i] = 1
            own |= set(rng.choice(10, size=3, replace=False) + (0 if i % 2 else 100))
        bucket += own
        row += [i] * len(own)
    ys = toxicity.kinds(np.array(bucket), np.array(row), n, y)
    groups = [np.flatnonzero(ys[:, k]) % 2 for k in range(toxicity.KINDS)]
    most = {int(g.mean() > 0.5) for g in groups if len(g) > 50 and abs(g.mean() - 0.5) > 0.4}
    assert most == {0, 1} and (ys[:, -1] == y).all() and (ys[y == 0] == 0).all()
    models = toxicity.fit_chain(np.array(bucket), np.array(row), n, ys)
    assert [len(m.earlier) for m in models] == list(range(toxicity.KINDS + 1)) and np.abs(models[-1].earlier).max() > 0.1


def test_repeated_ids_train_on_one_text(spark):
    docs = [(1, "a b"), (1, "c d"), (2, None), (1, "a b")]
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    got = [sorted(map(tuple, features.labelled(spark.createDataFrame(x, "doc_id long, text string"), labels, "toxic", 9).collect())) for x in (docs, docs[::-1])]
    assert got[0] == got[1] and len(got[0]) == 2 and got[0][0][1] == 1


def test_classifiers_odd(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.where("false")):
        q, t = quality.score(odd, quality.fit(odd, rows)).collect(), toxicity.score(odd, toxicity.fit(odd, rows)).collect()
        assert len(q) == len(t) == odd.count() and all(0 <= r.score <= 1 for r in q)
        assert toxicity.clean(odd, toxicity.fit(odd, rows)).columns == odd.columns
    assert quality.score(odd.where("false"), quality.fit(odd, labels)).count() == 0


# decontamination


def test_wand_finds_what_scoring_all_finds():
    rng = np.random.default_rng(2)
    vocabulary = [f"t{i}" for i in range(60)] + ["the"] * 30
    items = [(i, " ".join(rng.choice(vocabulary, size=rng.integers(4, 40)))) for i in range(50)]
    index = bm25.Index(items)
    for _ in range(60):
        text = " ".join(rng.choice(vocabulary, size=30)) + " " + items[rng.integers(50)][1]
        h = bm25.terms_of(text)
        got = {(k, round(s, 9)) for _, k, s in index.search(h, np.zeros(len(h), np.int64), 1, 0.5)}
        half, best = bm25.WINDOW // 2, {}
        for start in range(0, max(1, len(h) - half), half):
            there = set(index.numbers(h[start : start + bm25.WINDOW])[1].tolist())
            scores = defaultdict(float)
            for t in there:
                for piece, w in index.postings[t]:
                    scores[piece] += w
            for piece, s in scores.items():
                if s >= 0.5 - 1e-9:
                    best[index.owner[piece]] = max(best.get(index.owner[piece], 0), s)
        assert got == {(k, round(s, 9)) for k, s in best.items()}


def plain_contaminated(docs: dict, items: dict, threshold: float = 0.5, overlap: float = 0.5) -> dict:
    """Scores of all pairs of a document and an item that it holds, from words: BM25 of all pieces in all windows, then both overlaps."""
    terms = lambda t: re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    half, pieces = bm25.WINDOW // 2, []
    for k, text in items.items():
        t = terms(text)
        pieces += [(k, Counter(t[i : i + half])) for i in range(0, len(t), half)]
    df, mean = Counter(w for _, c in pieces for w in c), sum(c.total() for _, c in pieces) / max(len(pieces), 1)
    weights = []
    for k, c in pieces:
        w = {x: np.log(1 + (len(pieces) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * c.total() / mean)) for x, n in c.items()}
        weights.append((k, w, sum(w.values())))
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)} if len(t) >= 3 else {(x,) for x in t}
    out = {}
    for d, text in docs.items():
        t = terms(text)
        windows = [set(t[i : i + bm25.WINDOW]) for i in range(0, max(1, len(t) - half), half)]
        for k, w, whole in weights:
            score = max(sum(x for term, x in w.items() if term in there) for there in windows) / whole
            if score >= threshold - 1e-9:
                out[d, k] = max(out.get((d, k), 0), score)
        for k in [k for e, k in out if e == d]:
            held = grams(t) | {(x,) for x in t}
            parts = [grams(terms(x)) for x in bm25.question_and_answer(items[k])]
            if any(len(p & held) < overlap * len(p) for p in parts):
                del out[d, k]
    return out


def test_decontamination_by_brute_force(spark):
    """Whole results on the table, one row repeated, with extra columns that clash."""
    docs, items = texts(spark, SMALL), {r.item_id: r.text for r in table(spark, "benchmark").collect()}
    # and documents that hold parts of items, most of them enough
    parts = {10_000 + k: "words before it " * k + " ".join(t.split()[: 3 + len(t.split()) * (4 + k % 6) // 10] + t.split()[-3:]) for k, t in list(items.items())[:40]}
    docs |= parts
    again = min(d for d, _ in plain_contaminated(docs, items))
    rows = table(spark, "documents").select("doc_id", "text").union(spark.createDataFrame(list(parts.items()), "doc_id long, text string"))
    rows = rows.union(rows.where(F.col("doc_id") == again)).withColumn("item_id", F.lit("x")).withColumn("score", F.lit(0))
    want = plain_contaminated(docs, items)
    got = sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in bm25.contaminated(rows, table(spark, "benchmark")).collect())
    assert got == sorted([(d, k, round(s, 9)) for (d, k), s in want.items()] + [(d, k, round(s, 9)) for (d, k), s in want.items() if d == again]) and 20 < len(want) < 43


def test_decontamination(spark, odd):
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    docs = [(i, ("filler words come first " * 50) + t + (" and more follow" * 20)) for i, t in items[:20]] + [(1000 + i, "nothing of that sort " * 30) for i in range(5)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, None), (99_999, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in bm25.contaminated(rows, bench).collect()}
    assert {(i, i) for i, _ in items[:20]} <= got and max(d for d, _ in got) < 1000
    assert {r.doc_id for r in bm25.clean(rows, bench).collect()} == set(range(1000, 1005))
    assert bm25.contaminated(odd, bench).count() == 0 and bm25.clean(odd, bench).count() == odd.count()
    assert bm25.contaminated(rows, bench.where("false")).count() == 0 and bm25.contaminated(rows.where("false"), bench).count() == 0


@pytest.mark.parametrize("bound", ["SHARD", "SHARD_TERMS"])
def test_decontamination_scores_do_not_depend_on_shards(spark, monkeypatch, bound):
    """Items dealt over several indexes, by their number or their terms, give the scores of one index."""
    bench = table(spark, "benchmark").select("item_id", "text")
    items = [(r.item_id, r.text) for r in bench.collect()]
    docs = [(i, "filler words come first " * 9 + " ".join(t.split()[: 3 + len(t.split()) * 3 // 4])) for i, t in items]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    # a part of the items has words of its own kind, so counts differ from index to index
    bench = bench.union(spark.createDataFrame([(1000 + i, f"filler words come{i} first and then more of the question{i}? One answer{i}.") for i in range(30)], bench.schema))
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in bm25.contaminated(rows, bench, threshold=0.3, overlap=0.1).collect())
    whole = found()
    monkeypatch.setattr(bm25, bound, 20 if bound == "SHARD" else 700)
    assert len(list(bm25.indexes(bench))) > 1 and found() == whole and len(whole) >= 20


# personal data

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text: str) -> list:
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b.c@d.e.f", "x@@y.z q@r", "1.2.3.4.5 256.1.1.1 0001.2.3.4 1.2.3.4", "4111 1111 1111 1111-4111111111111111", "+1 (555) 010-9999) +12 +49 30 1234567890123456", "é a.b-c@d-e.fg. ..@x.y 1..2", "12.3.4.5.6.7.8.9", "+4+41 44 668 18 00"]


def test_base_spans(spark):
    for text in [*TRICKY, *texts(spark, MIDDLE).values()]:
        assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark, odd):
    got = {r.doc_id: r for r in queries.op6_pii(spark, SMALL).collect()}
    for d, text in texts(spark, SMALL).items():
        base = plain_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[d].spans.startswith(joined)
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, *_ in base) for k in pii.KINDS]
    found = pii.personal_data(odd).collect()
    assert len(found) == odd.count() and {r.spans for r in found if r.doc_id == 7} == {"email:5:16,ip:21:29"}
    assert {r.text for r in pii.redacted(odd).collect() if r.doc_id == 7} == {"mail [email] and [ip]"}
    assert pii.redacted(odd).columns == odd.columns and pii.personal_data(odd.where("false")).count() == 0


def test_long_key_is_judged_whole():
    """A key that begins with a plain run: its entropy is that of all its characters."""
    rest = "".join(np.random.default_rng(8).choice(list("abcdefghijkmnpqrstuvwxyz23456789"), size=2000))
    text = "value a1" + "a1" * 140 + rest
    assert pii.votes("secret", text, 6, len(text))[pii.LABELERS.index("variety")] == 1


def test_silent_labelers_add_nothing(spark):
    """A candidate that no labeler knows, alone in its table, stays."""
    rows = spark.createDataFrame([(1, "boxes 73918264 shipped")], "doc_id long, text string")
    ((kind, *at),) = pii.candidates("boxes 73918264 shipped", [])
    assert set(pii.votes(kind, "boxes 73918264 shipped", *at)) == {2}
    assert [(r.spans, r.n_card) for r in pii.personal_data(rows).collect()] == [("", 0)]
    assert [r.text for r in pii.redacted(rows).collect()] == ["boxes 73918264 shipped"]


def test_added_spans_on_planted_ones(spark):
    """Recall and precision of added spans: keys, numbers and names among others that look like them."""
    rng = np.random.default_rng(12)
    hexa, digits = (lambda n, a=a: "".join(rng.choice(list(a), size=n)) for a in ("0123456789abcdef", "0123456789"))
    given = sorted(pii.GIVEN)
    docs, want = [], set()
    for i in range(600):
        text = "the words of a page go on and on here "
        kind = i % 6
        secret = hexa(40)
        planted = {0: ("secret", 'token = "', secret, '" and'), 1: ("number", "ssn ", f"{digits(3)}-{digits(2)}-{digits(4)}", " and"), 2: ("name", "contact ", f"Dr {given[i % len(given)].title()} Walker", " and"),
                   3: (None, "order ", "7" + digits(9) + "00", " and"), 4: (None, "see. ", "Falling Water", " and"), 5: (None, "path ", "lib/" + "plain" * 5 + "/part1", " and")}[kind]
        if planted[0]:
            want.add((i, f"{planted[0]}:{len(text + planted[1])}:{len(text + planted[1] + planted[2])}"))
        docs.append((i, text + "".join(planted[1:]) + " more words of the page"))
    got = {(r.doc_id, s) for r in pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in r.spans.split(",") if s.split(":")[0] in pii.ADDED}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_added_spans_of_the_table(spark):
    """Of the table's documents, those with a key assigned to a token have it added, and few others have anything."""
    docs = texts(spark, MIDDLE)
    want = {(d, f"secret:{m.start(1)}:{m.end(1)}") for d, t in docs.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    got = {(r.doc_id, s) for r in queries.op6_pii(spark, MIDDLE).collect() for s in r.spans.split(",") if s.split(":")[0] in pii.ADDED}
    assert len(want) >= 5 and want <= got and len(got - want) <= 0.05 * len(got)


def test_reliabilities():
    """Labelers that agree are trusted, one that votes at random is not."""
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.3
    votes = [np.where(rng.random(4000) < r, truth, ~truth).astype(int) for r in (0.95, 0.9, 0.92, 0.55, 0.9, 0.88)]
    codes = sum(v * 3 ** (5 - i) for i, v in enumerate(votes))
    code, count = np.unique(codes, return_counts=True)
    post, yes, no = pii.reliabilities(code, count.astype(float))
    assert (post[np.searchsorted(code, codes)] > 0.5).mean() > 0.2 and np.mean((post[np.searchsorted(code, codes)] > 0.5) == truth) > 0.97
    assert yes[3] + no[3] < min(yes[0] + no[0], yes[4] + no[4])


# pages and addresses

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><nav><a href=x>Home</a> <a href=y>News</a></nav>
<div class="cookie-notice">We use cookies for all that you do on this site and more.</div>
<article><h1>Rain &amp; wind</h1><p>The rain in the north was heavy and it is said that more of it will come by the end of the week.</p><p>Short   one.</p>
<script>var a = "<p>no</p>";</script><aside>Buy this now and save</aside></article>
<div id="comments"><p>I think that this is the best of all the articles that I have read here.</p></div><footer>Copyright of the site</footer></body></html>"""


def test_html(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (None, "u", "<p>The cat is on the mat and it is not the dog of the house, is it &mdash; or was it that?", 1), (5, "u", "<" * 3000 + "a", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    assert got[1] == "Rain & wind The rain in the north was heavy and it is said that more of it will come by the end of the week. Short one."
    assert got[2] == got[3] == "" and got[None].endswith("it — or was it that?")
    assert all(r.n_chars == len(r.text) for r in queries.op3_html_text(spark, SMALL).collect())
    assert html_text.extract(rows.where("false")).count() == 0


RUNNING = "The rain in the north was heavy and it is said that more of it will come by the end of the week."
LINKS = "".join(f"<li><a href=/{w}>{w} news of today</a></li>" for w in ("north", "south", "east"))
#: Pages and the text of each.
PAGES = [
    (f"<body><h1>Weather</h1><p>{RUNNING}</p><ul>{LINKS}</ul></body>", f"Weather {RUNNING}"),  # no article: the head goes with its text
    (f"<body><p>{RUNNING}</p><div>More of this</div><div>To read</div><ul>{LINKS}</ul></body>", f"{RUNNING} More of this"),  # and the list's with the list
    (f"<article><p>{RUNNING}</p><p>Photo: A. Person</p><p>{RUNNING}</p></article>", f"{RUNNING} Photo: A. Person {RUNNING}"),
    (f"<article><p>{RUNNING}</p><p>Short one.</p><h4>Related</h4><h5>To read</h5><ul>{LINKS}</ul></article>", f"{RUNNING} Short one. Related"),
    (f"<article><h4>Related</h4><ul>{LINKS}</ul><p>{RUNNING}</p></article>", RUNNING),
    (f"<article><p>{RUNNING}</p><table><tr><td>1999</td><td>12.5</td></tr></table></article>", f"{RUNNING} 1999 12.5"),
    (f"<article><p>{RUNNING}</p><pre>{'x1 = y2 + z3; ' * 12}</pre></article>", f"{RUNNING} {'x1 = y2 + z3; ' * 12}".strip()),  # code of an article stays
    (f"<body><p>{RUNNING}</p><p>{'sku4711 EUR12.50 qty1 ' * 12}</p><p>Add</p></body>", RUNNING),  # and elsewhere goes, with what is near it
    (f"<article><p>{RUNNING}</p><p>{'sku4711 EUR12.50 ' * 6}<a href=x>{'shop now ' * 6}</a></p></article>", RUNNING),
    (f"<article><p>{RUNNING} <a href=x>a link</a> in it.</p></article>", f"{RUNNING} a link in it."),
    (f"<article><p>{RUNNING}</p><aside>{RUNNING}</aside><p>Near the aside.</p></article>", f"{RUNNING} Near the aside."),  # a place says nothing of its neighbours
    (f"<article><h1>Only a head</h1></article><footer>{RUNNING}</footer>", "Only a head"),
    (f"<main><p>{RUNNING}</p><form>{RUNNING}<input value=x></form></main>", RUNNING),
    (f"<body><div class=cookie-notice>{RUNNING}</div><div class=post>{RUNNING}</div><div id=comments>{RUNNING}</div></body>", RUNNING),
    (f"<body><header>{RUNNING}</header><article><header><h1>Weather</h1></header><p>{RUNNING}</p></article></body>", f"Weather {RUNNING}"),
    ("<p>A &lt;b&gt; &amp; c &eacute;&#233;&#xe9;</p>", "A <b> & c ééé"),
    (f"<article><p>One<br>two\n\t three</p>{RUNNING}</article>", f"One two three {RUNNING}"),
    (f"<article><p>{RUNNING}<script>if (a < b) document.write('<p>no</p>')</script><style>p > b {{}}</style></article>", RUNNING),
    ("<nav><ul>" + LINKS + "</ul></nav>", ""),
    (f"<p>{RUNNING}" * 4000, " ".join([RUNNING] * 4000)),  # a very long page, with tags left open
]


def test_html_pages(spark):
    """Expected texts of pages with and without articles; ids may be null or repeat, and columns may clash."""
    rows = [(i if i else None, "u", h, "n", 1) for i, (h, _) in enumerate(PAGES)] + [(3, "u", PAGES[3][0], "n", 2)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    want = [(i if i else None, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(3, PAGES[3][1], len(PAGES[3][1]))]
    assert sorted(map(repr, ((r.page_id, r.text, r.n_chars) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("off", ["stop words", "inheritance"])
def test_both_passes_decide(monkeypatch, off):
    """Without stop words, or without inheritance, pages come out otherwise, inside articles too."""
    if off == "stop words":
        monkeypatch.setattr(html_text, "STOPS", frozenset())
    else:
        monkeypatch.setattr(html_text, "main_blocks", lambda found: [b.text for b in found if b.label > 0 or b.label == 0 and b.home])
    assert {i for i, (h, t) in enumerate(PAGES) if html_text.main_text(h) != t} >= ({0, 1, 3, 4, 8} if off == "stop words" else {0, 3, 4})


class Plain(HTMLParser):
    """The text of a page's article element by a plain walk, without what the table's pages put into articles besides."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.skip, self.blocks = [], None, [""]

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "
        if tag in html_text.VOID | html_text.LEAVES:
            return
        self.open.append(tag)
        words = set(re.findall("[a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()))
        if self.skip is None and (tag in ("aside", "nav", "form", "footer", "script", "style") or words & {"ad", "comments", "related", "share", "newsletter", "cookie", "sidebar"}):
            self.skip = len(self.open)

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.blocks.append("")
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if self.skip is not None and len(self.open) < self.skip:
                self.skip = None

    def handle_data(self, data):
        if "article" in self.open and self.skip is None:
            self.blocks[-1] += data


def test_html_of_the_table(spark):
    for r in table(spark, "pages", MIDDLE).collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        assert html_text.main_text(r.html) == " ".join(" ".join(b.split()) for b in plain.blocks if b.split()), r.page_id


@pytest.mark.parametrize("quote", ['"', "'"])
def test_html_long_attribute(quote):
    """A '>' or a word such as hidden in a quoted value, however long, is neither text nor a mark; an open quote ends with its tag."""
    inner = "<p class=ad hidden>The cat that was in the house of the man is not for the dog.</p>" * 2000
    article = "The rain in the north was heavy and it is said that more of it will come by the end of the week."
    assert html_text.main_text(f"<body><div data-json={quote}{inner}{quote} title=x><p>{article}</p></div></body>") == article
    assert html_text.main_text(f"<body><div title={quote}x><p>{article}</p></div>" + "<b a=>" * 50_000) == article


def test_url_rules_by_kind(spark):
    """Hosts by the kind of what they offer, in words, glued words and pairs of words; each page gets its row, repeated ones too."""
    urls = ["http://free-bets.com/", "http://ads-track.com/a", "http://x.adult-x.com", "http://cheap-pills.com/", "http://spam-farm.com/", "http://casino-win.com/", "http://my.poker.example:8080/x", "http://onlinecasino.com/", "http://free--spins.com/", "http://Viagrashop.com/", "http://tracked.com/", "http://a.com/bets", "http://ads-track.org/fr/", "http://spins-free.com/", "http://a.net\n", "http://" + "a." * 20_000 + "xxx/"]
    rows = spark.createDataFrame([(i or None, u, 1, "v") for i, u in enumerate(urls)] + [(1, urls[1], 1, "v")] * 3, "page_id long, url string, m int, verdict string")
    got = defaultdict(set)
    for r in (found := url_filter.judge(rows).collect()):
        got[r.page_id].add((r.verdict, r.pattern_rule))
    block = ["gambling: bets", "adverts: ads", "adult: adult", "pharmacy: pills", "link farms: spam", "gambling: casino", "gambling: poker", "gambling: onlinecasino", "gambling: free spins", "pharmacy: viagrashop"]
    want = [*(("block", r) for r in block), *[("allow", None)] * 5, ("block", "adult: xxx")]
    assert len(found) == len(urls) + 3 and [got[i or None] for i in range(len(urls))] == [{w} for w in want]
    assert len(url_filter.KIND_RULES) > 500


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://WWW.Example.net/en/1", "http://example.net/de/", "http://shop.example.com/de/x?q", "http://example.com/en", "http://x.org/fr/", "http://forge.com/fr/", "http://netty.com/", "no address", None, "http://spam-farm.com/", "http://a.net", "x://b.org/fr"]
    rows = spark.createDataFrame([(i, u, "r") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(rows).collect()}
    assert [got[i] for i in range(len(urls) + 1)] == [
        ("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), ("net/", "block"), (None, "allow"), ("net/", "block"),
    ]
    assert url_filter.judge(rows.where("false")).count() == 0


# top-k and mixing


@pytest.mark.parametrize("kind", ["dense", "few great components", "alike"])
def test_topk_index_stops_on_proof_only(kind, monkeypatch):
    """The index finds all of the k best, ties included; on vectors of few great components it reads a part of the postings."""
    monkeypatch.setattr(topk, "SEED", 64)
    rng = np.random.default_rng(16)
    v = np.floor(64 * rng.normal(size=(3000, 32)) * {"dense": 1, "few great components": rng.random((3000, 32)) ** 12, "alike": 0}[kind])
    index = topk.ShardIndex(v.astype(np.float32), segment=256)
    queries, own = v[:96], np.arange(3000)[:, None] == np.arange(96)
    for j, (places, scores) in enumerate(index.top(queries.astype(np.float32), 9, own)):
        whole = np.where(own[:, j], -np.inf, v @ queries[j])
        kth = np.sort(whole)[-9]
        assert set(np.flatnonzero(whole >= kth)) <= set(places) and (scores == whole[places]).all()
    assert kind != "few great components" or index.read < 0.8 * index.whole


def test_topk_of_great_components(spark):
    """Whole numbers beyond what doubles hold are scored exactly."""
    rng = np.random.default_rng(17)
    rows = [(i, [float(x) for x in rng.integers(-(2**22), 2**22, size=4)]) for i in range(60)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect())
    want = []
    for q, v in rows[::20]:
        best = sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best[:5])]
    assert got == sorted(want)


def test_topk_odd(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)] + [(20, None, 0), (None, [1.0] * 8, 0), (41, [float("nan")] * 8, 0), (42, [None, *[1.0] * 7], 0), (1, [0.5] * 8, 0), (60, [0.25] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, k=7).collect())
    good = {(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    scores = defaultdict(list)
    for q, v in good:
        if q % 20 == 0:
            scores[q] += [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)]
    assert got == sorted((q, k + 1, i, -s) for q, found in scores.items() for k, (s, i) in enumerate(sorted(found)[:7]))
    assert topk.top_k(df.where("false")).count() == 0


def plain_mix(rows: list) -> list:
    """What is taken of each (doc_id, source, text), by a walk over each source's documents in the order of their keys."""
    size = lambda t: len(WORDS_OF.findall(t or ""))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    by = defaultdict(list)
    for d, s, t in rows:
        by[s].append((md5(f"mix:{'null' if d is None else d}:{'null' if t is None else md5(t)}"), d, size(t)))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    whole = {s: sum(n for *_, n in by[s]) for s in by}
    weight, full, share = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(), {}
    while True:
        left = 1.5 * sum(whole.values()) - sum(2.0 * whole[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: 2.0 * whole[s] if s in full else left / sum(weight[x] for x in open_) * weight[s] for s in names}
        more = {s for s in open_ if share[s] >= 2.0 * whole[s]}
        if not more:
            break
        full |= more
    out = []
    for s in names:
        epochs, at = (int(share[s]) // whole[s] if whole[s] else 0), 0
        for _, d, n in sorted(by[s], key=lambda x: (x[0], x[2])):
            out.append(Row(doc_id=d, source=s, size=n, source_size=whole[s], target=share[s], taken=epochs * n + max(0, min(n, int(share[s]) - epochs * whole[s] - at))))
            at += n
    return out


def test_mixing_of_rows_alike(spark, monkeypatch):
    """Rows of one source, id and text, more of them than a task makes at once, and null ids with texts of their own."""
    monkeypatch.setattr(mixing, "ALIKE_ROWS", 7)
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    rows = [(1, "a", "one two three")] * 40 + [(None, "b", f"w{i} x") for i in range(30)] + [(i, None, "y " * i) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = plain_mix(rows)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, want))
    whole = Counter()
    for r in mixing.mixed(df.repartition(5)).collect():
        whole[r.doc_id, r.source, r.text] += r.mix_words
        assert 1 <= r.mix_epoch <= 2 and 0 < r.mix_words <= len(r.text.split())
    per = Counter()
    for r in want:
        per[r.doc_id, r.source] += r.taken
    assert {k: v for k, v in per.items() if v} == {k: sum(n for (d, s, _), n in whole.items() if (d, s) == k) for k, v in per.items() if v}


def test_mixing_odd(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        assert rows[0].source_size == sum(r["size"] for r in rows) and abs(sum(r.taken for r in rows) - min(rows[0].target, 2 * rows[0].source_size)) < 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd.repartition(3)).collect()))
    assert sorted(map(str, got)) == sorted(map(str, plain_mix([(r.doc_id, r.source, r.text) for r in odd.collect()])))
    whole = mixing.mixed(odd)
    assert whole.columns == [*odd.columns, "mix_epoch", "mix_words"] and sum(r.mix_words for r in whole.collect()) == sum(r.taken for r in got)
    assert mixing.mix(odd.where("false")).count() == 0
