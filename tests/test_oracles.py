"""Every query of the engine gives its oracle's rows, in the same kinds of columns."""

import pyarrow as pa
import pytest

from paperloom.plans import catalog

from .conftest import DATA

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def rows(table: pa.Table) -> list:
    show = lambda v: "null" if v is None else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v + 0.0) if isinstance(v, float) else str(v)
    columns = [map(show, table.column(c).to_pylist()) for c in sorted(table.column_names)]
    return sorted(zip(*columns, strict=True))


def kinds(table: pa.Table) -> dict:
    of = lambda t: "int" if pa.types.is_integer(t) else "text" if pa.types.is_string(t) or pa.types.is_large_string(t) else "time" if pa.types.is_timestamp(t) else str(t)
    return {f.name: of(f.type) for f in table.schema}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    assert kinds(got) == kinds(want)
    assert rows(got) == rows(want)
