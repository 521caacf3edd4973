"""The driver's entry: registered queries run, and agree with their SQL."""

import os

import pytest

SF = "/root/testdata/sf0.001"
FAST = ["clean_reads", "filter_counts", "dropped_base_tally", "paired_filter", "contig_offsets", "ambiguity_runs", "insert_size_stats", "mapq_single_end", "eval_confusion", "eval_quality"]


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(FAST) <= set(e.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    want = con.sql(e.oracle_sql()[name])
    df = e.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    plain = lambda rows: sorted(str([float(x) if isinstance(x, (int, float)) else x for x in r]) for r in rows)
    assert plain(map(tuple, df.select(columns).collect())) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
