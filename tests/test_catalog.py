"""Every registered query against its SQL, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from patternlake.plans import catalog, registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    if name in registry.SQL:
        want = sql.execute(registry.SQL[name]).df()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        rows = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(want)
