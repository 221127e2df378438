"""Every registered query that has an SQL twin gives the twin's rows."""

import datetime
import decimal
import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(x):
    """A value as text that is the same from both engines."""
    if isinstance(x, bool | str | None):
        return repr(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, int):
        return f"{x:.9g}" if abs(x) < 2**53 else str(x)
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return plain([x[k] for k in sorted(x)])
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, list | tuple):
        return "[" + ",".join(plain(y) for y in x) + "]"
    return str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values), sorted(columns)


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for path in pathlib.Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_twin_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, twin, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    result = twin.execute(ORACLES[name])
    assert got == rows([c[0] for c in result.description], result.fetchall())
