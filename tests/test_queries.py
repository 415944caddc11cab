"""Every registered query of the library, against DuckDB where it has SQL."""

import os

import duckdb
import pytest

from sieveline.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    frame = catalog.QUERIES[name](spark, DATA)
    found = _rows([tuple(r) for r in frame.collect()], frame.columns)
    if name in catalog.ORACLES:
        result = oracle.execute(catalog.ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(frame.columns)
        assert found == _rows(result.fetchall(), columns)
    else:
        assert found
    spark.catalog.clearCache()
