"""Secret scan, line dedup and mixing against brute force, and their edge cases."""

import hashlib

import pytest
from brute import base_spans, removed_lines, spans_text, targets, words
from pyspark.sql import functions as F

from spanlake.llm import line_dedup, queries, secret_scan, source_mix

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string"


def rows(spark, sf, cols="doc_id, text, source"):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr(*cols.split(", ")).collect()]


# --- secret scan --------------------------------------------------------------------


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOC)
    return {r.doc_id: r for r in secret_scan.scan_secrets(df).withColumn("base", secret_scan.span_text(F.col("base"))).withColumn("spans", secret_scan.span_text(F.col("spans"))).collect()}


TEXTS = [
    None, "", "no secret here", "password=abc password = 'abcdef' x", "é😀 Token: \"zzzzzz\" AKIA" + "A1" * 8 + " " + "0a" * 12,
    "AKIAAAAA AKIA" + "Z" * 15, "a" * 23 + " " + "f" * 24 + "0x" + "1" * 30, "api_key:secret=abcdefgh", "apikey==x.y=z-w_1/2+3" * 3,
    "PASSWD : 123456\nSECRET\t=\tno", "token=token=token", "hex deadbeef" * 50, "ſecret=abcdef toKen=abcdefK",
]


def test_base_spans_equal_brute_force(spark):
    got = scan(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        want = base_spans(t or "")
        assert got[i].base == spans_text(want), (i, t)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for x, _, _ in want) for k in ("assign", "access", "hex"))


def test_weak_parts_need_their_complement(spark):
    key = "wJalrXUtnFEMI7K7MDENGabPxRfiCYzEXAMPLE123"[:40]
    access = "AKIA" + "B2" * 8
    far = " " + "x " * 300
    texts = [
        f"{key}", f"{access} {key}", f"{access}{far}{key}", "user=alice", "user=alice password=hunter22", f"user=alice{far}password=hunter22",
        "https://api.example.com/v1", "login: bob secret=abcdef99 at https://api.example.com/v1", "https://api.example.com/v1 secret=abcdef99",
        f"https://api.example.com/v1 {key}",
    ]
    got = scan(spark, texts)
    kinds = {i: [s.split(":")[0] for s in got[i].spans.split(",") if s] for i in got}
    assert kinds[0] == [] and kinds[1] == ["access", "weak_secret"] and kinds[2] == ["access"]
    assert kinds[3] == [] and kinds[4] == ["weak_id", "assign"] and kinds[5] == ["assign"]
    assert kinds[6] == [] and kinds[7] == ["weak_id", "assign", "weak_endpoint"]
    assert kinds[8] == ["assign"] and kinds[9] == ["weak_secret"]


def test_scan_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "password=abcdef"), (1, "password=abcdef"), (None, "token=abcdef"), (2, None)], "doc_id long, text string")
    out = secret_scan.scan_secrets(df.withColumn("row", F.lit("clash")).withColumn("kind", F.lit(1)))
    assert sorted((r.doc_id or -1, r.n_assign) for r in out.collect()) == [(-1, 1), (1, 1), (1, 1), (2, 0)]
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0


def test_scan_of_a_long_text(spark):
    text = ("lorem ipsum " * 20 + "password=abc123def ") * 2000
    got = scan(spark, [text])[0]
    assert got.n_assign == 2000 and got.base == spans_text(base_spans(text))


def test_op1_whole_table(spark):
    got = {r.doc_id: r for r in queries.op1_secret_scan(spark, SF).collect()}
    docs = rows(spark, SF)
    assert len(got) == len(docs)
    for d, t, _ in docs:
        assert got[d].base_sha256 == hashlib.sha256(spans_text(base_spans(t)).encode()).hexdigest()


# --- line dedup ---------------------------------------------------------------------


def dedup(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return {r.doc_id: (r.n_lines, set(r.covered or []), r.text) for r in line_dedup.dedup_lines(df).collect()}


LINES = [
    (1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "b\nc\nd"), (4, "a\nb"), (5, None), (6, ""), (7, "\n\n\n\n\n"), (8, "\n\n\n\nq"),
    (9, "r\nr\nr\nr\nr"), (10, "r\nr\nr"), (11, "é\n😀\n z\n"), (12, "é\n😀\n z\n"), (13, "q\r\nq\r\nq\r\nw"),
]


def test_line_dedup_equals_brute_force(spark):
    want = removed_lines(LINES)
    got = dedup(spark, LINES)
    assert got == want
    assert got[2] == (6, {1, 2, 3, 4}, "x\ny") and got[3][2] == "" and got[1][1] == set()


def test_line_dedup_whole_table(spark):
    docs = rows(spark, SF, "doc_id, text")
    got = {r.doc_id: (r.n_lines, r.removed, r.kept_sha256) for r in queries.op4_line_dedup(spark, SF).collect()}
    for d, (n, gone, kept) in removed_lines(docs).items():
        assert got[d] == (n, ",".join(map(str, sorted(gone))), hashlib.sha256(kept.encode()).hexdigest())


def test_line_dedup_repeats_ids_and_clashing_columns(spark):
    data = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "z\na\nb\nc"), (None, "a\nb\nc\nn")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("covered", F.lit("x")).withColumn("pos", F.lit(7)).withColumn("_id", F.lit(1))
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "pos", "_id", "n_lines", "n_removed", "covered"]
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.pos) for r in out.collect())
    # equal rows are one document; a null id sorts first, so the others are later
    assert len(got) == 4 and [x for x in got if x[0] == "None"] == [("None", 4, 0, 7)]
    assert [x[2] for x in got if x[0] == "1"] == [3, 3, 3]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_a_passage_in_all_documents_stays_once(spark):
    data = [(i, f"own {i}\np\nq\nr\ns\nend {i}") for i in range(3000)]
    got = dedup(spark, data)
    assert got[0][1] == set() and all(got[i][2] == f"own {i}\nend {i}" for i in range(1, 3000))


# --- mixing -------------------------------------------------------------------------


def mix(spark, data):
    return source_mix.mix_sources(spark.createDataFrame(data, DOC)).collect()


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 3, 5, 7], [5], [0, 4], [9, 0, 0, 1, 50, 2]])
def test_targets_equal_resharing(spark, sizes):
    data, i = [], 0
    for s, n in enumerate(sizes):
        for _ in range(max(1, n)):
            data.append((i, "w" if n else "", f"s{s}" if s else None))
            i += 1
    got = mix(spark, data)
    want = targets({(f"s{s}" if s else None): n for s, n in enumerate(sizes)})
    for r in got:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.epochs * r.size + r.part
    for s in want:
        assert sum(r.taken for r in got if r.source == s) == int(want[s])


def test_mix_whole_table_is_stable(spark):
    a = sorted(tuple(r) for r in queries.op9_source_mix(spark, SF).collect())
    b = sorted(tuple(r) for r in queries.op9_source_mix(spark, SF).collect())
    assert a == b
    size = {d: len(words(t)) for d, t, _ in rows(spark, SF)}
    assert {r[0]: r[1] for r in a} == size


def test_mix_edges(spark):
    got = mix(spark, [(1, None, None), (1, "a b", "é"), (1, "a b", "é"), (None, "c", "z"), (2, " \t\x0b ", "z"), (3, "x y   q", "a")])
    assert sorted(r.size for r in got) == [0, 0, 1, 2, 2, 3]
    assert mix(spark, [(1, None, "a"), (2, "", "b")])[0].target == 0.0
    empty = spark.createDataFrame([], DOC)
    assert source_mix.mix_sources(empty).count() == 0


def test_prefix_sums_of_a_hot_source(spark):
    data = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 11}") for i in range(5000)]
    got = mix(spark, data)
    for s in {r.source for r in got}:
        part = [r for r in got if r.source == s]
        assert sum(r.taken for r in part) == int(part[0].target)
