"""Writes that fail or come twice, detectors that fail, chains that are killed, and copies that come days later."""

import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.operators import chain, fanout, load, writes
from paperloom.plans import catalog
from paperloom.sources import store
from paperloom.streaming import copies

from .conftest import DATA

SCHEMA = "document_id long, value string"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def ids(spark, *of):
    return spark.createDataFrame([(i,) for i in of], "document_id long")


def held(table):
    return sorted((r.document_id, r.value) for r in table.read().collect())


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_replace_is_old_or_new(spark, tmp_path, monkeypatch):
    table = writes.Children(spark, str(tmp_path / "t"), SCHEMA, buckets=8)
    assert held(table) == []
    first = [(i, f"a{k}") for i in range(20) for k in range(2)]
    table.replace(0, ids(spark, *range(20)), rows(spark, first))
    assert held(table) == sorted(first)
    before = files(tmp_path / "t/rows")
    table.replace(1, ids(spark, 3, 4), rows(spark, [(3, "b")]))
    want = sorted([x for x in first if x[0] not in (3, 4)] + [(3, "b")])
    assert held(table) == want
    # other files are as they were, and only touched buckets have new ones
    after = files(tmp_path / "t/rows")
    touched = {r.b for r in ids(spark, 3, 4).select(table._bucket().alias("b")).collect()}
    assert {k: after[k] for k in before} == before and {int(k.split("bucket=")[1].split("/")[0]) for k in after if k not in before} <= touched
    # a batch that comes again does nothing
    table.replace(1, ids(spark, 3), rows(spark, [(3, "twice")]))
    assert held(table) == want
    # one that fails before it is said leaves the old ones, and comes through when it is repeated
    monkeypatch.setattr(store, "rename", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        table.replace(2, ids(spark, 5), rows(spark, [(5, "c")]))
    assert held(table) == want
    monkeypatch.undo()
    table.replace(2, ids(spark, 5), rows(spark, [(5, "c")]))
    want = sorted([x for x in want if x[0] != 5] + [(5, "c")])
    assert held(table) == want
    # a document without children now, in a bucket that may be empty then
    table.replace(3, ids(spark, *range(20)), rows(spark, []))
    assert held(table) == []
    table.sweep()
    assert held(table) == [] and not files(tmp_path / "t/rows")


def test_replace_from_a_stream(spark, tmp_path):
    """The last children of each document stay, batch by batch."""
    table = writes.Children(spark, str(tmp_path / "t"), SCHEMA, buckets=4)
    for n in range(3):
        rows(spark, [(i, f"{n}.{k}") for i in range(n, 6) for k in range(2)]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(lambda df, k: table.replace(k, df, df)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert held(table) == sorted((i, f"{min(i, 2)}.{k}") for i in range(6) for k in range(2))


def test_fan_out_with_failures(spark):
    good = {"document_type": '{"document_type":"invoice","confidence":0.8,"reasoning":"r"}', "entities": '{"entities":[{"entity_type":"date","value":"x","confidence":1}]}', "risks": '{"risks":[]}', "deadlines": '{"deadlines":[]}'}
    table = [(i, *(("no json" if n == "risks" and i % 2 else None if n == "entities" and i == 2 else text) for n, text in good.items())) for i in range(4)]
    found = fanout.FanOut(spark.createDataFrame(table, "id long, " + ", ".join(f"{n} string" for n in good)))
    assert found.counts == {"documents": 4, "document_type": 0, "entities": 1, "risks": 2, "deadlines": 0}
    assert sorted((r.id, r.detector) for r in found.rejects().collect()) == [(1, "risks"), (2, "entities"), (3, "risks")]
    assert {r.id: (r.document_type, r.entities, r.risks, r.failed) for r in found.summary().collect()} == {0: (1, 1, 0, ""), 1: (1, 1, None, "risks"), 2: (1, None, 0, "entities"), 3: (1, 1, None, "risks")}
    assert sorted(r.id for r in found.findings("entities").collect()) == [0, 1, 3]


def test_a_chain_resumes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, text string")
    calls, broken = [], [True]

    def stage(name, bad):
        def work(live):
            calls.append((name, sorted(r.id for r in live.collect())))
            if name == "three" and broken[0]:
                raise RuntimeError("killed")
            return live.withColumn("text", F.concat("text", F.lit(name[0]))).withColumn("error", F.when(F.col("id") == bad, f"{name} failed"))

        return name, work

    stages = [stage("one", 1), stage("two", 4), stage("three", 99)]
    with pytest.raises(RuntimeError, match="killed"):
        chain.run(docs, stages, str(tmp_path))
    broken[0] = False
    got = {r.id: (r.done, r.stopped_at, r.error) for r in chain.run(docs, stages, str(tmp_path)).collect()}
    assert [c[0] for c in calls] == ["one", "two", "three", "three"] and calls[-1][1] == [0, 2, 3, 5]
    assert got == {**{i: (3, None, None) for i in (0, 2, 3, 5)}, 1: (0, "one", "one failed"), 4: (1, "two", "two failed")}
    assert {r.text for r in chain.passed(spark, stages, str(tmp_path)).collect()} == {"t0ott", "t2ott", "t3ott", "t5ott"}


def test_copies_days_later_are_refused(spark, tmp_path):
    """Micro-batches together accept what one batch of all documents accepts; a batch that comes again, the same."""
    t0 = datetime(2024, 1, 1)
    docs = [(i, None if i % 5 == 0 else f"w{i % 3}", f"{i % 7:02x}hash", t0 + timedelta(days=i)) for i in range(60)] + [(100, "w", None, t0), (101, "w", None, t0)]
    schema = "id long, workspace_id string, file_hash string, created_at timestamp"
    seen, got = copies.FirstCopies(spark, str(tmp_path / "seen")), []
    for n in range(4):
        batch = spark.createDataFrame(docs[15 * n : 15 * n + 15] + (docs[60:] if n == 3 else []), schema)
        for again in range(1 + (n == 2)):
            judged = [r.id for r in seen.judge(batch, n).where("accepted").collect()]
            got += judged if not again else []
            assert not again or sorted(judged) == sorted(got[-len(judged) :])
    want = [r.id for r in load.first_copies(spark.createDataFrame(docs[:60], schema)).collect()] + [100, 101]
    assert sorted(got) == sorted(want)


def test_fan_out_reads_once(spark):
    """One scan of the documents, however many detectors."""
    from paperloom.plans.validation import _all_responses

    plan = _all_responses(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and os.path.exists(DATA) and "intelligence_fanout" in catalog.queries()
