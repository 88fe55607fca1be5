"""Every registered query against its checking SQL on the smallest test tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from specmill.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    if isinstance(v, (float, Decimal)) and not isinstance(v, bool):
        return round(float(v), 9)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def _rows(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = _rows(df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in registry.CHECKS:
        assert len(got) > 0
        return
    listed = ", ".join(f'"{c}"' for c in cols)
    assert got == _rows(duck.execute(f"SELECT {listed} FROM ({registry.CHECKS[name]})").fetchall())
