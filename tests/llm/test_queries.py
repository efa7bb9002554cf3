"""Every query runs over whole small tables; those with SQL equal it."""

import os

import duckdb
import pytest

from tessella.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows or name in ("p3_found", "p3_report", "p3_members")
    if name in Q.ORACLE:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
        want = con.execute(Q.ORACLE[name])
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in cols) for r in rows) == sorted(want.fetchall())


def test_found_columns(spark, data):
    want = {"p1_found": ["rec_id", "group_id"], "p2_found": ["rec_id", "seg_no", "lang"], "p3_found": ["rec_id_a", "rec_id_b"], "p4_found": ["rec_id", "defect"], "p5_found": ["raw_id_a", "raw_id_b"], "p6_found": ["gen_id", "field_name", "canon_id"], "p9_found": ["doc_id", "start_pos", "end_pos"], "p7_ids": ["doc_id", "ids"]}
    for name, cols in want.items():
        assert Q.QUERIES[name](spark, data).columns == cols
