"""Every query with SQL gives the SQL's rows on the smallest tables; those without SQL run."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.spans.QUERIES]


def value(v):
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame, columns):
    return sorted(tuple(value(v.item() if hasattr(v, "item") else v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    if name not in entry.oracle_sql():
        assert len(got)
        return
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "masked"]
