import duckdb
import pytest

import __spark_entry__
from docgrid import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cells):
    return list(tuple("∅" if v is None or v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in cells)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(rows(got.select(*names).collect()), key=key) == sorted(rows(want.fetchall()), key=key)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
