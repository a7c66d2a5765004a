"""Every query against its DuckDB SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from terratess.plans.oracle import ORACLES
from terratess.plans.queries import QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(a - b) <= 1e-6 * max(1.0, abs(a))
    return a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(columns, table):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    key = lambda r: [(v is not None, v if v is not None else 0) for v in r]
    return order, sorted(([r[i] for i in at] for r in table), key=key)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    found = QUERIES[name](spark, str(SF)).toArrow()
    cursor = duck.execute(ORACLES[name])
    columns, expected = rows([c[0] for c in cursor.description], cursor.fetchall())
    own, got = rows(found.column_names, [tuple(r.values()) for r in found.to_pylist()])
    assert own == columns
    assert len(got) == len(expected)
    assert all(same(a, b) for x, y in zip(got, expected) for a, b in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0
