"""Each stage of the pipeline against a plain version of its decision, and on odd tables."""

from collections import Counter
from functools import cache

import corpus_pipeline
from paperloom.llm import pii, toxicity

from .test_operators import SMALL, components, odd, plain_contaminated, plain_mix, plain_spans, table, toxic_probabilities  # noqa: F401  odd is a fixture

STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    docs = table(spark, "documents")
    columns = docs.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = texts(docs)

    clean = STAGES["toxicity"](spark, docs, SMALL).cache()
    models = toxicity.fit(docs, table(spark, "labels"))
    assert clean.columns == columns and set(texts(clean)) == {d for d, t in before.items() if not t or toxic_probabilities(models, t)[-1] < 0.5}

    once = STAGES["near_duplicates"](spark, clean, SMALL).cache()
    assert once.columns == columns and set(texts(once)) == {d for d, (_, c) in components({d: t or "" for d, t in texts(clean).items()}, 5).items() if c == d}

    apart = STAGES["decontamination"](spark, once, SMALL).cache()
    held = {d for d, _ in plain_contaminated({d: t or "" for d, t in texts(once).items()}, {r.item_id: r.text or "" for r in table(spark, "benchmark").collect()})}
    assert apart.columns == columns and set(texts(apart)) == set(texts(once)) - held and held

    hidden = STAGES["personal_data"](spark, apart, SMALL).cache()
    added = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s.split(":")[0] in pii.ADDED] for r in pii.personal_data(apart).collect()}
    for d, text in texts(apart).items():
        at, want = 0, ""
        for a, b, kind in sorted([(a, b, k) for k, a, b in plain_spans(text or "")] + [(int(a), int(b), k) for k, a, b in added[d]]):
            want, at = (want + text[at:a] + f"[{kind}]" if a >= at else want), max(at, b)
        assert texts_of(hidden)[d] == (want + text[at:] if text else text)
    assert hidden.columns == columns and hidden.count() == apart.count() and any(plain_spans(t or "") for t in texts(apart).values())

    taken = Counter()
    for r in STAGES["mixing"](spark, hidden, SMALL).collect():
        taken[r.doc_id] += r.mix_words
    assert taken == {r.doc_id: r.taken for r in plain_mix([(r.doc_id, r.source, r.text) for r in hidden.collect()]) if r.taken}


@cache
def texts_of(df) -> dict:
    return {r.doc_id: r.text for r in df.collect()}


def test_repeated_ids_stay_once(spark):
    """Of the rows that repeat an id one with words stays, the same in any order; rows without words or id all stay."""
    rows = [(1, "a b c d e f", "x"), (1, "g h i j k l m", "y"), (1, "", "z"), (2, "a b c d e f", "x"), (3, None, "x"), (3, None, "x"), (None, "a b c d e f", "x"), (None, None, "x")]
    got = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        got.append(sorted(map(repr, STAGES["near_duplicates"](spark, docs, SMALL).collect())))
    assert got[0] == got[1] and len(got[0]) == 6 and sum("doc_id=1" in r for r in got[0]) == 2 and not any("doc_id=2" in r for r in got[0])


def test_odd_tables(spark, odd):  # noqa: F811
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == odd.columns, name
        assert STAGES["mixing"](spark, docs, SMALL).count() >= 0


def test_run(spark):
    first, again = (corpus_pipeline.run(spark, SMALL) for _ in range(2))
    assert first.count() > 0 and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
