"""The catalogue's queries against their SQL on the smallest tables, but for those that a test of their own covers."""

import duckdb
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem embeddings".split()
#: Meshes cost seconds each; the partitioners' are in test_mesh.
SLOW = [n for n in catalog.ORACLES if n.startswith("mesh_") and n not in ("mesh_embeddings_2d", "mesh_neighbours", "mesh_fingerprints")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if n not in SLOW])
def test_query(spark, con, name):
    mine = catalog.QUERIES[name](spark, SF).toPandas()
    real = con.execute(catalog.ORACLES[name]).df()
    columns = sorted(real.columns)
    assert sorted(mine.columns) == columns and len(mine) == len(real)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, real))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["v0", "v1", "v2"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
