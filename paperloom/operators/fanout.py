"""Several detectors over one reading of the documents, of which any may fail for any document.

Each detector makes a column of its outcome, an error or a value; a failure is a row's, not the job's. Outcomes are written
once; findings, rejects and the summary are read from them. The summary has every document, whatever failed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import store
from . import validation as v


class Detector(NamedTuple):
    """``value`` of a decoded response, and its ``error``, which sees the value too; null where there is none."""

    value: Callable[[Column], Column]
    error: Callable[[Column, Column], Column]


def listing(name: str) -> Detector:
    """Entities, risks or deadlines: one bad item rejects the response."""
    return Detector(lambda j: v.items(j, name, v.FIELDS[name]), lambda j, items: v.list_error(j, items, name))


DETECTORS = {
    "document_type": Detector(lambda j: v.string(v.field(j["v"], "document_type")), lambda j, _: v.type_error(j)),
    "entities": listing("entities"),
    "risks": listing("risks"),
    "deadlines": listing("deadlines"),
}


class FanOut:
    """Outcomes of ``detectors`` over ``responses``: ``id`` and a text for each detector, by its name."""

    def __init__(self, responses: DataFrame, detectors: dict[str, Detector] | None = None):
        self.detectors = detectors or DETECTORS
        names = list(self.detectors)
        # each step's columns are made once, for all detectors together
        rows = responses.select("id", *[v.decoded(F.col(n)).alias(f"j_{n}") for n in names])
        rows = rows.select("*", *[self.detectors[n].value(F.col(f"j_{n}")).alias(f"v_{n}") for n in names])
        rows = rows.select("id", *[f"v_{n}" for n in names], *[self.detectors[n].error(F.col(f"j_{n}"), F.col(f"v_{n}")).alias(f"e_{n}") for n in names])
        seen = Observation()
        rows = rows.observe(seen, F.count("*").alias("documents"), *[F.count_if(F.col(f"e_{n}").isNotNull()).alias(n) for n in names])
        self.outcomes = store.kept(rows, f"{store.shared_folder(rows.sparkSession, 'fanout')}/outcomes")
        #: Documents, and how many each detector failed for, counted as the outcomes were written.
        self.counts: dict[str, int] = seen.get

    def findings(self, name: str) -> DataFrame:
        """``id, k, x`` for each item of a detector whose value is a list, where it didn't fail."""
        good = self.outcomes.where(F.col(f"e_{name}").isNull()).select("id", F.posexplode_outer(f"v_{name}").alias("k", "x"))
        return good.where("k IS NOT NULL")

    def rejects(self) -> DataFrame:
        """``id, detector, error`` for each failure."""
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.col(f"e_{n}").alias("error")) for n in self.detectors]))
        return self.outcomes.select("id", each.alias("x")).select("id", "x.*").where("error IS NOT NULL")

    def summary(self) -> DataFrame:
        """``id``, each detector's number of findings (null where it failed), ``failed``, the names of those that did."""
        names = list(self.detectors)

        def found(n: str) -> Column:
            value = F.col(f"v_{n}")
            many = self.outcomes.schema[f"v_{n}"].dataType.typeName() == "array"
            return F.when(F.col(f"e_{n}").isNull(), F.size(value) if many else F.lit(1)).cast("int").alias(n)

        failed = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"e_{n}").isNotNull(), n) for n in names])), ",")
        return self.outcomes.select("id", *map(found, names), failed.alias("failed"))
