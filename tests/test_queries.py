"""Every query with SQL against DuckDB on the same tables; the others give rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quern.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    a, b = rows(df.columns, got), rows(columns, want.fetchall())
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b) if x != y and not all(u == v or isinstance(u, float) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-4) for u, v in zip(x, y))]
    assert not different, str(different[:2])[:800]
