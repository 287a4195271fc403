import duckdb
import pytest

import __spark_entry__ as entry

SMALL = ["s1_phrase_and_word", "s8_proximity_counts", "x1_browse_absent", "x6_sorted_set", "j7_zip_surplus", "k8_parity", "v_problems", "v_fault_kinds", "g9_overview", "f17_excerpts", "g6_tiers", "k3_wide_rows", "k4_load", "d4_full_card", "a15_values", "b7_combine_not"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cols, data):
    return sorted(tuple(str(r[c]) for c in sorted(cols)) for r in data)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SMALL)
def test_query_gives_the_rows_of_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = entry.queries()[name](spark, data)
    rel = con.sql(entry.oracle_sql()[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [r.asDict() for r in df.collect()]) == rows(rel.columns, want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ord", "rank"]
