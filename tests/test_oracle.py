"""Every registered query against its SQL over the smallest tables."""

import pytest

from weftline.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(got.columns)
    if name == "chunk_emitted_log":
        assert df.count() == len(got.fetchall())
    assert _rows(df.columns, df.collect()) == _rows(got.columns, got.fetchall())
