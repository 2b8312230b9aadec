"""Every registered query with an oracle equals it on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from glotmill import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def bag(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = core.QUERIES[name](spark, SF)
    want = con.sql(core.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    index = [want.columns.index(c) for c in cols]
    assert bag(got.select(*cols).collect()) == bag([[r[i] for i in index] for r in want.fetchall()])


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "greedy_batches" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
