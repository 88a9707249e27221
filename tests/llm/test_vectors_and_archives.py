"""Nearest neighbours and archives against brute force and round trips, and their edge cases."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import matrix_knn, queries, warc_chunks

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>"


def brute(rows, k=10, step=100):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for n, (q, x) in sorted(enumerate(ok), key=lambda e: e[1][0]):
        if q % step == 0:
            near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for m, (i, v) in enumerate(ok) if m != n and len(v) == len(x))[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def same(got, want):
    got = sorted(tuple(r) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)


def test_op3_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(queries.op3_matrix_knn(spark, SF).collect(), brute(rows))


@pytest.mark.parametrize("blocks", [(4096, 1024), (3, 17)])
def test_ties_copies_and_odd_vectors(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(0, 300)]
    rows += [(i, [1.0] * 8) for i in range(1000, 1400)]  # a hot vector, ids 1000.. are queries too
    rows += [(i, [1e-4 * (i % 3), 1e4] + [0.0] * 6) for i in range(500, 540)]
    rows += [(600, None), (700, []), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [float("inf")] + [1.0] * 7), (704, [None] * 8), (None, [1.0] * 8)]
    rows += [(800, [1.0, 2.0]), (801, [2.0, 1.0]), (900, [3.0] * 5)]
    df = spark.createDataFrame(rows, VEC).withColumn("rank", F.lit(0)).withColumn("id", F.lit("x"))
    got = matrix_knn.nearest(df, query_block=blocks[0], vector_block=blocks[1]).select("query_id", "rank", "vec_id", "score").collect()
    same(got, brute(rows))


def test_knn_repeats_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], VEC)
    got = matrix_knn.nearest(df).collect()
    # every row of an id is a query and a candidate of the others
    want = [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 0, np.sqrt(5.0)), (0, 1, 1, np.sqrt(2.0)), (0, 2, 1, np.sqrt(2.0)), (0, 3, 0, np.sqrt(5.0))]
    same([(r.query_id, r["rank"], r.vec_id, r.score) for r in got], sorted(want))
    assert matrix_knn.nearest(df.limit(0)).count() == 0 and matrix_knn.nearest(df.where("vec_id = 0").limit(1)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 16)) * rng.uniform(0.01, 100, (40, 1)), rng.normal(size=(60, 16))
    (qa, sa, ea), (qb, sb, eb) = matrix_knn.quantise(a), matrix_knn.quantise(b)
    near = np.sqrt((((qa * sa[:, None])[:, None] - (qb * sb[:, None])[None]) ** 2).sum(-1))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert (np.abs(near - true) <= ea[:, None] + eb[None] + 1e-9).all()


# --- archives -----------------------------------------------------------------------

PAGE = "page_id long, url string, html string"


def expected(pages, least=0):
    first, out = {}, []
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault((h or "").encode(), i)
    for i, _, h in pages:
        b = (h or "").encode()
        again = i is not None and len(b) >= least and first[b] != i
        out.append((i or -1, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def result(rows):
    assert all(r.verified for r in rows)
    return sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    big = "".join(random.Random(1).choices("abé😀\r\n\0 ", k=300_000))
    pages = [(5, "http://a/é\r\nX: y", big), (3, None, big), (9, "u", ""), (8, "u", None), (2, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", "same"), (6, "u", "same"),
             (None, "u", "same"), (4, "u", "x" * warc_chunks.CHUNK), (10, "u", "y" * (2 * warc_chunks.CHUNK + 1))]
    df = spark.createDataFrame(pages, PAGE).withColumn("row", F.lit("clash")).withColumn("data", F.lit(1))
    got = warc_chunks.round_trip(df, least).collect()
    assert result(got) == expected(pages, least)
    assert {r.page_id: r.n_chunks for r in got if r.record_type == "response"}[10] == 3


def test_archives_are_plain_gzip_members(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" * 1000) for i in range(20)]
    chunks = warc_chunks.chunk_table(spark.createDataFrame(pages, PAGE)).cache()
    plan = warc_chunks.plan_records(chunks.where("last").select("row", "page_id", "url", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest")))
    places = warc_chunks.write_archives(chunks, plan, f"file://{tmp_path}/w").collect()
    assert len(places) == 20
    data = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").iterdir())
    assert data.count(b"WARC/1.1\r\n") == 20 and all(h.encode() in data for _, _, h in pages)
    back = warc_chunks.read_archives(spark.createDataFrame(places), f"file://{tmp_path}/w").orderBy("row", "chunk_no").collect()
    assert {r.page_id: bytes(r.data).decode() for r in back} == {i: h for i, _, h in pages}


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "a")], PAGE)
    got = warc_chunks.round_trip(df).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1)]
    assert warc_chunks.round_trip(df.limit(0)).count() == 0


def test_op7_whole_table(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert result(queries.op7_warc_chunks(spark, SF).collect()) == expected(pages)
