"""Every query of the library against its DuckDB twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from turnloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(shown(r[c]) for c in columns) for r in df.collect()], key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    r = duck.execute(ORACLE_SQL[name])
    kinds = {x[0]: str(x[1]) for x in r.description}
    names = [x[0] for x in r.description]
    want = sorted([tuple(shown(row[names.index(c)]) for c in columns) for row in r.fetchall()], key=repr)
    assert sorted(names) == columns
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    assert got == want
