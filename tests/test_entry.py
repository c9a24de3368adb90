from __future__ import annotations

import os

import pytest

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", ["p4_found", "null_quantiles", "verdict_quadrant", "hop_windows", "source_overlap", "task_similarity", "recording_pairs", "knn_search"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    df = E.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    text = lambda r: tuple(str(x + 0.0 if isinstance(x, float) else x) for x in r)
    want = c.execute(f"SELECT {', '.join(chr(34) + x + chr(34) for x in cols)} FROM ({E.oracle_sql()[name]})").fetchall()
    assert sorted(text(r) for r in df.select(cols).collect()) == sorted(text(r) for r in want)
