"""Periodic runs, the filter audit and language labels against brute force, SQL and planted cases; and odd tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from paperloom.llm import features, filter_audit, lang_crf, queries, runs, shared

from .test_operators import MIDDLE, SMALL, odd, table, texts  # noqa: F401  odd is a fixture


def plain_runs(words: list, least: int = 24, repeats: int = 3) -> list:
    """Every period by comparison with the words so far on; a stretch's smallest period comes first."""
    found, n = [], len(words)
    for q in range(1, n // repeats + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                length = i - start + q
                if length >= max(least, repeats * q) and not any(s <= start and start + length <= s + m and q % p == 0 for s, m, p in found):
                    found.append((start, length, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(40):
        kind, n = rng.randrange(4), rng.randrange(0, 90)
        base = [rng.choice("ab") for _ in range(n)] if kind < 2 else [rng.choice("abc") for _ in range(rng.randrange(1, 9))] * (n // 4) + ["x"] * rng.randrange(6)
        if kind == 3 and base:
            base[rng.randrange(len(base))] = "y"
        docs.append([w.encode() for w in base])
    for least, repeats in ((2, 2), (6, 2), (5, 3), (24, 3)):
        s, opposite, doc = runs._numbered(docs)
        got = runs.runs_of(s, opposite, doc, least, repeats)
        begin = np.searchsorted(doc, np.arange(len(docs)))
        for k, words in enumerate(docs):
            mine = [(int(a - begin[k]), int(m), int(q)) for a, m, q in got if doc[a] == k]
            assert mine == plain_runs(words, least, repeats), (words, least, repeats)


def test_suffixes_next_smaller_and_common():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (2, 1), (7, 2), (64, 1), (300, 2), (501, 3)):
        s = rng.integers(0, k, n)
        x = runs.Suffixes(s)
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        assert x.sa.tolist() == order
        rank = {i: r for r, i in enumerate(order)}
        assert x.next_smaller().tolist() == [next((j for j in range(i + 1, n) if rank[j] < rank[i]), n) for i in range(n)]
        i, j = rng.integers(0, n, (2, 50))
        i, j = i[i != j], j[i != j]
        common = lambda a, b: next((m for m in range(n) if max(a, b) + m >= n or s[a + m] != s[b + m]), 0)
        assert x.common(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_periodic_runs(spark):
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, SMALL).collect()))
    want = sorted(plain_row(d, t) for d, t in texts(spark, SMALL).items() if len(t) < 40_000)
    assert [r for r in got if r[0] in {w[0] for w in want}] == want and len(got) == 200 and sum(r[1] > 0 for r in got) > 10


def test_runs_collapse(spark):
    """Real outputs: whole stretches with their root once, in long texts too; runs that overlap are both told."""
    line = "the same nine words come again and again here"
    rows = [(1, "before " + " ".join([line] * 5) + " after"), (2, line), (3, " ".join(f"w{i}" for i in range(70_000)) + " x y" * 30_000), (4, " ".join(["a b"] * 20 + ["a c"] * 20))]
    got = {r.doc_id: r for r in runs.collapsed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == f"before {line} after" and [tuple(r) for r in got[1].runs] == [(1, 45, 9)]
    assert got[2].text == line and not got[2].runs
    assert got[3].text.endswith(" w69999 x y") and [tuple(r) for r in got[3].runs] == [(70_000, 60_000, 2)]
    assert [tuple(r) for r in got[4].runs] == [(0, 41, 2), (40, 40, 2)] or [tuple(r) for r in got[4].runs] == plain_runs(rows[3][1].split())


def test_runs_of_odd_tables(spark, odd):  # noqa: F811
    got = runs.collapsed(odd).collect()
    assert len(got) == odd.count() and all(r.text is not None and r.n_words == len((r.text).split()) for r in got if not r.runs)
    assert runs.summary(runs.collapsed(odd.where("false"))).count() == 0


def audit_sql(con) -> list:
    return sorted(con.sql(filter_audit.ORACLE).fetchall())


def test_filter_audit_of_odd_tables(spark, odd, monkeypatch):  # noqa: F811
    """Null texts, languages, ids and labels, repeated rows and ids, hot texts and ids, by SQL over the same rows."""
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    docs = odd.select("doc_id", "text", "lang")
    more = [(100 + i, "the one text # " + ("A" * 9), [None, "en", "de"][i % 3]) for i in range(40)] + [(7, f"repeated id {i}", "fr") for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    labels = spark.createDataFrame([(100, 1, 0), (101, None, 1), (101, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", labels.toArrow())
    got = filter_audit.replay(filter_audit.flags(docs.withColumn("row", docs["lang"]), labels))
    order = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = sorted(map(tuple, got.select(order).collect()))
    assert rows == audit_sql(con) and len(rows) == 600 * len({r[0] for r in rows}) and sum(r[4] for r in rows) > 0
    assert filter_audit.replay(filter_audit.flags(docs.where("false"), labels)).count() == 0


# language labels


def plain_chances(model, words):
    """Forward and backward one word at a time."""
    scores = np.exp(model.scores(words))
    ahead, behind = [np.exp(model.start) * scores[0]], [np.ones(len(model.langs))]
    for e in scores[1:]:
        ahead.append((ahead[-1] @ np.exp(model.move)) * e)
    for e in scores[:0:-1]:
        behind.append(np.exp(model.move) @ (e * behind[-1]))
    p = np.array(ahead) * np.array(behind[::-1])
    return p / p.sum(axis=1, keepdims=True)


def some_model(seed=1, langs=("de", "en", "fr")):
    rng, n = np.random.default_rng(seed), len(langs)
    return lang_crf.Model(list(langs), rng.normal(0, 3, (lang_crf.BUCKETS, n)).astype(np.float32), {"der": 0, "the": 1}, np.eye(n)[:2], rng.normal(0, 1, (n, n)), rng.normal(0, 1, (n, n)), rng.normal(0, 1, n))


def test_chains_in_blocks_equal_plain_passes(monkeypatch):
    """Texts of fewer and more words than a block, in slabs of two blocks, all at once."""
    monkeypatch.setattr(lang_crf, "BLOCK", 4)
    monkeypatch.setattr(lang_crf, "SLAB", 2)
    model, rng = some_model(), random.Random(2)
    vocabulary = ["der", "the", "le", "Wörter", "words", "mots", "x"]
    docs = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 3, 4, 5, 8, 40, 2)]
    number = np.array([vocabulary.index(w) for d in docs for w in d])
    got = np.concatenate(list(lang_crf.Chains(model, model.scores(vocabulary), number, np.array([len(d) for d in docs])).chances()))
    assert np.allclose(got, np.concatenate([plain_chances(model, d) for d in docs]), atol=1e-8)


def test_expected_counts_equal_slopes():
    """What training takes for the slope of the logarithm of all chains' sum is that, by small steps."""
    rng = np.random.default_rng(4)
    emitted, move, start = rng.normal(0, 1, (2, 3, 2)), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)

    def total(move):
        out = 0.0
        for e in emitted:
            v = np.exp(start + e[0])
            for x in e[1:]:
                v = (v @ np.exp(move)) * np.exp(x)
            out += np.log(v.sum())
        return out

    _, moved = lang_crf._expected(emitted, move, start)
    for a in range(2):
        for b in range(2):
            step = np.zeros((2, 2))
            step[a, b] = 1e-5
            assert abs((total(move + step) - total(move - step)) / 2e-5 - moved[a, b]) < 1e-6


def test_language_of_held_out_documents(spark):
    got = queries.op13_language_id(spark, MIDDLE).join(table(spark, "documents", MIDDLE).select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    right = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(right) > 150 and np.mean(right) > 0.98


def test_code_switched_text(spark):
    """Sentences of held-out documents of three languages in one text: most words get their own language."""
    docs = table(spark, "documents", MIDDLE)
    model = lang_crf.fit(docs.where(~lang_crf.held_out()))
    held = [(r.lang, r.text[:160].rpartition(" ")[0]) for r in docs.where(lang_crf.held_out()).where("n_chars > 400").orderBy("doc_id").collect()]
    pieces = [p for i in range(8) for lang in ("de", "en", "fr", "es") for p in [x for x in held if x[0] == lang][i : i + 1]]
    text, truth = " \n".join(t for _, t in pieces), []
    for lang, t in pieces:
        truth += [lang] * len(t) + [""] * 2
    (r,) = lang_crf.label(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert len(r.spans) >= len(pieces) / 2 and all(text[s.start : s.end].strip() == text[s.start : s.end] for s in r.spans)
    agree = [truth[i] == s.lang for s in r.spans for i in range(s.start, s.end) if truth[i]]
    assert np.mean(agree) > 0.9


def test_language_of_odd_tables(spark, odd):  # noqa: F811
    """Nothing learned: all undecided. One language: always it, but for texts without letters. Labels of nulls teach nothing."""
    none = lang_crf.fit(odd.where("false"))
    assert {(r.lang_pred, r.score, len(r.spans)) for r in lang_crf.label(odd, none).collect()} == {("und", 0.0, 0)}
    one = lang_crf.fit(odd)
    for r in lang_crf.label(odd, one).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert (r.lang_pred, round(r.score, 9)) == (("en", 1.0) if r.text and re.search(r"[^\W\d_]", r.text) else ("und", 0.0))
        assert [tuple(s) for s in r.spans] == ([(re.search(r"[^\W\d_]", r.text).start(), len(r.text.rstrip("0123456789.@ ")), "en")] if r.lang_pred == "en" else [])
    assert lang_crf.label(odd.where("false"), one).count() == 0
    several = odd.unionByName(odd.selectExpr("*").withColumn("lang", odd["label"]))
    assert lang_crf.fit(several).langs == ["en", "l"]


def test_labels_without_documents_take_no_room(spark):
    """Of a thousand labels ten have a document; a bound of a hundred rows leaves all ten."""
    docs = spark.createDataFrame([(100 * i, f"text {i}") for i in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int")
    assert sorted(r.doc_id for r in features.labelled(docs, labels, "quality", 100).collect()) == [100 * i for i in range(10)]
    assert features.labelled(docs, labels, "quality", 4).count() == 4
