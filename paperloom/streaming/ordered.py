"""Keyed state over events in order of time: what must see a key's events one after the other, on a stream.

Events wait in the key's state until the watermark has passed them, so late ones still find their place; then they are
taken in order of time and number. What waits is what a key brings within the watermark's delay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import limits
from ..operators.load import ACTIONS


def in_order(events: DataFrame, key: str, values: list[str], late: str, state: str, start: tuple, step: Callable[[tuple, tuple], tuple[tuple, tuple | None]], output: str) -> DataFrame:
    """``step(state, event) -> (state, row or None)`` over a stream's events (``key``, ``ts``, ``id`` and ``values``) of each key.

    An event is ``(key, microseconds, id, *values)``. ``state`` is the schema of what ``step`` carries, ``output`` that of
    its rows.
    """
    names = [x.split()[0] for x in output.split(", ")]

    def run(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        *carried, waiting = held.get if held.exists else (*start, "[]")
        carried, rows = tuple(carried), [tuple(x) for x in json.loads(waiting)]
        for frame in frames:
            rows += [(int(t), int(i), *(None if pd.isna(x) else x for x in rest)) for t, i, *rest in frame[["at", "id", *values]].itertuples(index=False)]
        passed = held.getCurrentWatermarkMs() * 1000
        out: list[tuple[Any, ...]] = []
        rows.sort(key=lambda r: r[:2])
        while rows and rows[0][0] <= passed:
            carried, row = step(carried, (name[0], *rows.pop(0)))
            if row is not None:
                out.append(row)
        held.update((*carried, json.dumps(rows)))
        if rows:
            held.setTimeoutTimestamp(max(rows[0][0] // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = stamped.select(key, "ts", F.unix_micros("ts").alias("at"), "id", *values)
    return rows.groupBy(key).applyInPandasWithState(run, output, f"{state}, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def verdicts(events: DataFrame, seconds: int = limits.SECONDS, most: int = limits.MOST, patience: int = limits.PATIENCE, late: str = "1 minute") -> DataFrame:
    """``id, bucket_start, hit, verdict`` of a stream's hits (id, key, ts), as in batch."""
    width = seconds * 1_000_000

    def step(state: tuple, hit: tuple) -> tuple[tuple, tuple]:
        opened, n = state
        _, at, id_ = hit
        if opened is None or opened < 0 or at >= opened + width:
            opened, n = at, 0
        n += 1
        verdict = "allowed" if n <= most else "delayed" if opened + width - at <= patience * 1_000_000 else "refused"
        return (opened, n), (id_, opened, n, verdict)

    keyed = events.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("none")))
    found = in_order(keyed, "key", [], late, "opened long, n long", (-1, 0), step, "id long, opened long, hit long, verdict string")
    return found.select("id", F.timestamp_micros("opened").cast("timestamp_ntz").alias("bucket_start"), "hit", "verdict")


def change_feed(versions: DataFrame, late: str = "1 minute") -> DataFrame:
    """``document_id, version, was, status, action, bi_status`` of a stream of versions (document_id, ts, version, status, classification), as in batch.

    Versions are numbered in order of their times.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        seen, was, kind = state
        document, _, version, status, classification = row
        changed = seen and (status != was or classification != kind)
        told = "synced" if status == "Ready" and classification not in (None, "Restricted") else "excluded" if classification == "Restricted" else "not-synced"
        out = (document, version, was, status, ACTIONS.get(status) if status != was else None, told) if changed else None
        return (True, status, classification), out

    rows = versions.withColumnRenamed("version", "id")
    return in_order(rows, "document_id", ["status", "classification"], late, "seen boolean, was string, kind string", (False, None, None), step, "document_id long, version long, was string, status string, action string, bi_status string")
