"""Every registered query with SQL against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tapeloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.4g}"
    except (TypeError, ValueError):
        return str(x).removesuffix(" 00:00:00")


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def near(a: str, b: str) -> bool:
    """Equal, or numbers that differ by rounding only."""
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=2e-3, abs_tol=2e-5)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_duckdb(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir)
    want = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    want = want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    got = got.collect()
    assert len(got) == len(want)
    for a, b in zip(canonical(got, got[0].__fields__ if got else columns), canonical(want, columns), strict=True):
        assert all(near(x, y) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0
