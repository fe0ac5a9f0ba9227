"""Every registered query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def key(row):
    return tuple("" if v is None else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda df: sorted((tuple(None if pd.isna(v) else float(v) if isinstance(v, (float, int)) and not isinstance(v, bool) else v for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=key)
    a, b = norm(got), norm(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, rel=1e-9, abs=2e-6) if all(isinstance(v, float) for v in x) else all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(q))) for p, q in zip(x, y)), (x, y)
