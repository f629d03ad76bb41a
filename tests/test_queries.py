"""Every query against its SQL on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidewatch import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    out = catalogue.QUERIES[name](spark, DIR)
    got = rows_of(out.columns, out.collect())
    if name not in catalogue.SQL:
        assert out.columns
        return
    found = db.execute(catalogue.SQL[name])
    names = [c[0] for c in found.description]
    want = rows_of(names, found.fetchall())
    assert sorted(names) == sorted(out.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (a, b)
