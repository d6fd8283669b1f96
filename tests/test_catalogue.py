from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue, elements, scripts, streams, trees

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not DATA.exists():
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def values(rows):
    return sorted(str([round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in rows)


QUERIES = catalogue.QUERIES | elements.QUERIES | scripts.QUERIES | streams.QUERIES | trees.QUERIES
ORACLE = catalogue.ORACLE | elements.ORACLE | scripts.ORACLE | streams.ORACLE | trees.ORACLE


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert values(got.select(*[f"`{c}`" for c in columns]).collect()) == values(want.fetchall())


def test_entry(spark):
    if DATA.exists():
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
