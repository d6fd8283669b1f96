from pathlib import Path

import pytest

from tessera.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_sql(spark, name):
    if not DATA.exists():
        pytest.skip("no tables here")
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.fetchall()))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
