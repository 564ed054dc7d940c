import os

import duckdb
import pytest

import __spark_entry__ as entry
from cutlab.plans.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
CHEAP = ["threshold_flags", "viterbi_segments", "greedy_match", "normalize_events", "split_plan", "best_per_group", "apply_edits"]


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "orders", "lineitem", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    r = con.execute(ORACLE[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    flat = lambda rows: sorted(tuple(repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v) for v in x) for x in rows)
    assert flat([tuple(x[i] for i in at) for x in r.fetchall()]) == flat([tuple(x[c] for c in cols) for x in df.collect()])
