"""Every query of the subpackage that has a DuckDB twin against it, on the two smaller tables."""

import duckdb
import pytest

from turnloom.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def shown(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    df = QUERIES[name](spark, f"/root/testdata/{sf}")
    columns = sorted(df.columns)
    got = sorted([tuple(shown(r[c]) for c in columns) for r in df.collect()], key=repr)
    r = con.execute(ORACLE_SQL[name])
    kinds = {x[0]: str(x[1]) for x in r.description}
    names = [x[0] for x in r.description]
    want = sorted([tuple(shown(row[names.index(c)]) for c in columns) for row in r.fetchall()], key=repr)
    assert sorted(names) == columns and {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    assert got == want
