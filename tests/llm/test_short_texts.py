"""Line deduplication of texts that are shorter than a window."""

import duckdb

from spanlake.llm import line_dedup, queries
from spanlake.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"


def test_copies_of_short_texts_are_found(spark):
    data = [(1, "one line"), (2, "one line"), (3, "a\nb"), (4, "a\nb"), (5, "a"), (6, "b\na"), (7, ""), (8, ""), (9, "one line\na\nb"),
            (10, " \n"), (11, " \n"), (12, "q\n"), (13, "q\n"), (14, "q"), (15, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.covered, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert {d for d, v in got.items() if v[1]} == {2, 4, 13}
    assert got[2] == (1, 1, [0], "") and got[4] == (2, 2, [0, 1], "") and got[13][:3] == (2, 2, [0, 1])
    assert all(got[d][3] == t for d, t in data if d not in (2, 4, 13))


def test_whole_table_equals_the_twin_with_short_copies(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: r for r in con.execute(ORACLE["op4_line_dedup"]).fetchall()}
    got = {r.doc_id: tuple(r) for r in queries.op4_line_dedup(spark, SF).collect()}
    assert got == want and any(r[1] < 3 and r[2] for r in got.values())
