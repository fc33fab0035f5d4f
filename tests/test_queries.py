"""Every registered query of the engine against its SQL on the smallest tables."""

import pathlib

import duckdb
import pytest

from pagelake import plans

DATA = pathlib.Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    rows = sorted(([plain(v) for v in r] for r in found.select(*columns).collect()), key=repr)
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(plans.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(([plain(r[k]) for k in order] for r in result.fetchall()), key=repr)
