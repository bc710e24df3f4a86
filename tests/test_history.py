"""Limits, states, runs and changes over histories: hot keys, ties, planted ledgers, and streams that equal batch."""

import random
from datetime import datetime, timedelta

import pytest

from paperloom.operators import history, limits, load
from paperloom.streaming import ordered

T0 = datetime(2024, 1, 1)


def plain_verdicts(hits, seconds, most, patience):
    out, state = {}, {}
    for id_, key, ts in sorted(hits, key=lambda h: (h[2], h[0])):
        opened, n = state.get(key, (None, 0))
        if opened is None or ts >= opened + timedelta(seconds=seconds):
            opened, n = ts, 0
        n += 1
        state[key] = (opened, n)
        left = (opened + timedelta(seconds=seconds) - ts).total_seconds()
        out[id_] = (opened, n, "allowed" if n <= most else "delayed" if left <= patience else "refused")
    return out


def hits_of(seed, n, spread, keys):
    rng = random.Random(seed)
    # many at the same moment, many a bucket's length apart to the second
    return [(i, rng.choice(keys), T0 + timedelta(seconds=rng.randrange(spread))) for i in range(n)]


@pytest.mark.parametrize(("n", "spread", "keys"), [(400, 4000, ["a"]), (600, 900, ["a", "a", "a", "b", None]), (60, 100_000, ["a", "b"]), (300, 50, ["a"])])
def test_verdicts(spark, n, spread, keys):
    hits = hits_of(n, n, spread, keys)
    got = limits.verdicts(spark.createDataFrame(hits, "id long, key string, ts timestamp_ntz"), 60, 5, 20)
    assert {r.id: (r.bucket_start, r.hit, r.verdict) for r in got.collect()} == plain_verdicts(hits, 60, 5, 20)


def test_verdicts_of_odd_hits(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, T0), (3, "none", T0)], "id long, key string, ts timestamp_ntz")
    assert sorted((r.id, r.hit) for r in limits.verdicts(rows, 60, 1, 20).collect()) == [(2, 1), (3, 1)]
    assert limits.verdicts(rows.where("false")).count() == 0


def test_a_long_history_is_many_ranges(spark):
    """One document has most events; small ranges give what one fold gives."""
    rng = random.Random(4)
    events = [(1 if rng.random() < 0.8 else rng.randrange(2, 6), T0 + timedelta(seconds=rng.randrange(200)), i, rng.choice(["approve", "reject", "reprocess", "failed", "insights", "ocr_failed", None])) for i in range(500)]
    want, state = {}, {}
    for d, _, i, e in sorted(events, key=lambda x: (x[1], x[2])):
        s, n, refused, first = state.get(d, ("Processing", 0, 0, None))
        to = load.TRANSITIONS.get((s, e))
        state[d] = (to or s, n + 1, refused + (to is None), first if first is not None or to else i)
    want = {d: (n, s, refused, first) for d, (s, n, refused, first) in state.items()}
    table = spark.createDataFrame(events, "document_id long, at timestamp_ntz, id long, event string")
    for rows in (20, 100_000):
        got = {r.document_id: (r.events, r.status, r.refused, r.first_refused) for r in history.final_states(table, rows=rows).collect()}
        assert got == want
    assert history.final_states(table.where("false")).count() == 0


def test_runs_of_a_planted_ledger(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(1, "processing", 0), (2, "processing", 1), (3, "skipped", 2), (4, "failed", 3), (5, "completed", 4), (6, "processing", 5), (7, "queued", 6)]
    ledger = spark.createDataFrame([(i, 1, "risks", s, at(m)) for i, s, m in rows], "id long, document_id long, stage string, status string, created_at timestamp_ntz")
    got = [(r.attempt, r.status, r.started_at, r.ended_at) for r in history.stage_runs(ledger).collect()]
    assert sorted(got, key=str) == sorted([(1, "orphaned", at(0), None), (2, "failed", at(1), at(3)), (2, "skipped", at(2), at(2)), (2, "unstarted", None, at(4)), (3, "open", at(5), None)], key=str)


def streamed(spark, rows, make, folder, parts):
    """The rows in files of shuffled order within ``parts``, read as a stream a file at a time."""
    schema = rows[0]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = make(spark.readStream.schema(schema).parquet(str(folder / "in")))
        stream.writeStream.format("parquet").option("checkpointLocation", str(folder / "cp")).outputMode("append").trigger(availableNow=True).start(str(folder / "out")).awaitTermination(180)
        assert k >= 0
    return spark.read.parquet(str(folder / "out"))


def test_verdicts_of_a_stream(spark, tmp_path):
    """Late hits within the watermark find their place; what the watermark has passed is the batch's."""
    hits = hits_of(9, 300, 1200, ["a", "a", "b"])
    by_time = sorted(hits, key=lambda h: h[2])
    parts = [by_time[:100], by_time[100:200], by_time[200:]]
    parts[0][-1], parts[1][0] = parts[1][0], parts[0][-1]  # comes a file later
    got = streamed(spark, ["id long, key string, ts timestamp_ntz"], lambda s: ordered.verdicts(s, 60, 5, 20), tmp_path, [*parts, [(1000, "c", T0 + timedelta(hours=2))], [(1001, "c", T0 + timedelta(hours=4))]])
    got = {r.id: (r.bucket_start, r.hit, r.verdict) for r in got.collect() if r.id < 1000}
    assert got == plain_verdicts(hits, 60, 5, 20)


def test_changes_of_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(4), T0 + timedelta(seconds=i), i, rng.choice(["Ready", "Ready", "Failed", None]), rng.choice(["Public", "Restricted", None])) for i in range(200)]
    schema = "document_id long, ts timestamp_ntz, version long, status string, classification string"
    want = {tuple(r) for r in history.change_feed(spark.createDataFrame(rows, schema)).collect()}
    parts = [rows[:70], rows[71:140], [rows[70], *rows[140:]]]
    end = [[(9, T0 + timedelta(hours=h), 1000 + h, "Ready", "Public")] for h in (2, 4)]
    got = [tuple(r) for r in streamed(spark, [schema], lambda s: ordered.change_feed(s, "2 minutes"), tmp_path, [*parts, *end]).collect() if r.document_id < 9]
    assert len(got) == len(set(got)) and set(got) == want
