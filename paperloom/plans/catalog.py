"""Names of all queries of the engine, with their SQL oracles."""

from __future__ import annotations

from . import access, history, listing, reporting, scalars, state, text, upkeep, validation, vectors  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
