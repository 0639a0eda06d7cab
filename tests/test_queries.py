"""Every tile query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from quadrille import catalogue

FOLDER = "/root/testdata/sf0.001"


def same(a, b) -> bool:
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "events", "part", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    expected = sorted(found.fetchall(), key=repr)
    df = catalogue.queries()[name](spark, FOLDER)
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert len(got) == len(expected) and all(same(x, y) for a, b in zip(got, expected) for x, y in zip(a, b))
