"""Reports kept up by changes: the same rows as made anew, and files only where something changed."""

from collections import Counter
from pathlib import Path

import pytest

from paperloom.operators import upkeep
from paperloom.sources import store

DOCS, KIDS = "document_id long, workspace_id string, name string", "document_id long, value string"
ROWS = "document_id long, workspace_id string, name string, value string"


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def spaces(spark, report, names):
    return {spark.createDataFrame([(n,)], "w string").select(report._space(upkeep.F.col("w"))).first()[0] for n in names}


@pytest.fixture
def tables(spark):
    docs = [(i, f"w{i % 4}" if i % 5 else None, f"d{i}") for i in range(40)]
    kids = [(i % 40, f"v{i % 3}") for i in range(100)] + [(7, "twice"), (7, "twice"), (None, "nobody's")]
    return docs, kids


def start(spark, tmp_path, docs, kids):
    report = upkeep.Report(spark, str(tmp_path / "r"), ROWS, slots=2)
    d, k = spark.createDataFrame(docs, DOCS), spark.createDataFrame(kids, KIDS)
    report.apply(0, upkeep.joined_changes(d.limit(0), upkeep.signed(d, 1), k.limit(0), upkeep.signed(k, 1)))
    return report, d, k


def test_equal_to_the_view_anew(spark, tmp_path, tables):
    docs, kids = tables
    report, d, k = start(spark, tmp_path, docs, kids)
    assert bag(report.read()) == bag(d.join(k, "document_id"))
    # documents and children change in one batch: one is renamed, one goes with its children, one comes
    docs2 = [(i, w, "renamed" if i == 7 else n) for i, w, n in docs if i != 9] + [(99, "w1", "new")]
    kids2 = [x for x in kids if x[0] != 9 and x != (7, "twice")] + [(7, "twice"), (99, "a"), (99, "a")]
    d2, k2 = spark.createDataFrame(docs2, DOCS), spark.createDataFrame(kids2, KIDS)
    report.apply(1, upkeep.joined_changes(d, upkeep.changes(d, d2), k, upkeep.changes(k, k2)))
    assert bag(report.read()) == bag(d2.join(k2, "document_id"))
    assert bag(report.read(["w1", None])) == bag(d2.join(k2, "document_id").where("workspace_id = 'w1' OR workspace_id IS NULL"))
    # only files of the asked workspaces are opened
    assert all(any(f"part={s}-" in f for s in spaces(spark, report, ["w1", None])) for f in report.read(["w1", None]).inputFiles())


def test_files_of_other_workspaces_stay(spark, tmp_path, tables):
    docs, kids = tables
    report, d, k = start(spark, tmp_path, docs, kids)
    before = files(tmp_path / "r/rows")
    more = upkeep.signed(spark.createDataFrame([(1, "more")], KIDS), 1)  # document 1 is of w1
    report.apply(1, upkeep.joined_changes(d, upkeep.signed(d, 1).limit(0), k, more))
    after = files(tmp_path / "r/rows")
    assert {f: after[f] for f in before} == before
    new = [f for f in after if f not in before]
    (space,) = spaces(spark, report, ["w1"])
    assert new and all(f"part={space}-" in f for f in new)
    used = report.read().inputFiles()
    report.sweep()
    assert set(files(tmp_path / "r/rows")) == {f.removeprefix("file://") for f in used}
    assert bag(report.read())[(1, "w1", "d1", "more")] == 1


def test_failed_and_repeated_batches(spark, tmp_path, tables, monkeypatch):
    docs, kids = tables
    report, d, k = start(spark, tmp_path, docs, kids)
    want = bag(report.read())
    none = upkeep.signed(d, 1).limit(0)
    gone = upkeep.joined_changes(d, none, k, upkeep.signed(k.where("document_id = 3"), -1))
    with monkeypatch.context() as m:
        m.setattr(store, "rename", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            report.apply(1, gone)
    assert bag(report.read()) == want
    for _ in range(2):
        report.apply(1, gone)
    left = Counter({x: n for x, n in want.items() if x[0] != 3})
    assert bag(report.read()) == left
    # a row that is not there can't go, and nothing changes
    with pytest.raises(Exception, match="not there"):
        report.apply(2, gone)
    assert bag(report.read()) == left and not report.done(2)


def test_nothing_changes(spark, tmp_path, tables):
    docs, kids = tables
    report, d, k = start(spark, tmp_path, docs, kids)
    want, before = bag(report.read()), files(tmp_path / "r/rows")
    report.apply(1, upkeep.joined_changes(d, upkeep.changes(d, d), k, upkeep.changes(k, k)))
    assert report.done(1) and bag(report.read()) == want and files(tmp_path / "r/rows") == before
    empty = upkeep.Report(spark, str(tmp_path / "e"), ROWS)
    assert empty.read().count() == 0 and empty.read(["w1"]).count() == 0
    # a report that loses all its rows
    report.apply(2, upkeep.joined_changes(d, upkeep.signed(d, -1), k, upkeep.signed(k, -1)))
    assert report.read().count() == 0


def test_batches_of_a_stream(spark, tmp_path, tables):
    """Changes of children as they come in; the report equals the view of all of them."""
    docs, kids = tables
    report, d, k = start(spark, tmp_path, docs, [])
    feed = spark.createDataFrame([(*x, 1) for x in kids] + [(7, "twice", -1)], KIDS + ", sign long")
    feed.coalesce(1).orderBy("sign", ascending=False).repartition(3).write.parquet(str(tmp_path / "feed"))

    def step(rows, batch):
        report.apply(batch + 1, upkeep.joined_changes(d, upkeep.signed(d, 1).limit(0), k, rows))

    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
    stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    kids.remove((7, "twice"))
    assert bag(report.read()) == bag(d.join(spark.createDataFrame(kids, KIDS), "document_id"))
