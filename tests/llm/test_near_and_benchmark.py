"""Near-duplicates and decontamination against brute force, and their edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import contamination, near_components, shingles, words
from pyspark.sql import functions as F

from spanlake.llm import common, decontaminate, near_dedup, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def near(spark, data, k=2):
    got = near_dedup.near_duplicates(spark.createDataFrame(data, DOC), shingle=k).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}, got


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_all_pairs(spark, k):
    rng = random.Random(k)
    texts = ["", None, " \t ", "one", "One", "one two", "ONE two", "one two three"]
    for f in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(8, 120))]
        texts += family(rng, base, rng.randrange(2, 14), len(base) // 8)
    texts += texts[10:30]
    data = list(enumerate(texts))
    rng.shuffle(data)
    got, rows = near(spark, data, k)
    assert got == near_components(data, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chain_and_hot_group(spark):
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join(base[i : i + 30]) for i in range(30)]  # neighbours similar, ends not
    rng = random.Random(3)
    data = list(enumerate(chain + family(rng, [f"h{i}" for i in range(80)], 400, 6) + ["copy of one text"] * 300))
    got, _ = near(spark, data)
    assert got == near_components(data, 2)


def test_small_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_TOKENS", 300)
    rng = random.Random(5)
    data = list(enumerate(t for f in range(4) for t in family(rng, [f"w{f}-{i}" for i in range(50)], 25, 8)))
    got, _ = near(spark, data)
    assert got == near_components(data, 2)


def test_forest_roots_and_components(spark):
    chain = [(i, i + 1) for i in range(37)] + [(100, 101), (102, 101), (101, 103)]
    got = {r.node: r.root for r in near_dedup.roots(spark.createDataFrame(chain, "node long, parent long")).collect()}
    assert got == {i: 37 for i in range(37)} | {100: 103, 101: 103, 102: 103}
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 38)} | {101: 100, 102: 100, 103: 100}
    empty = spark.createDataFrame([], "a long, b long")
    assert near_dedup.components(empty).count() == 0 and near_dedup.roots(empty.toDF("node", "parent")).count() == 0


def test_near_edges(spark):
    df = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, "A b C d"), (11, None)], DOC)
    out = near_dedup.near_duplicates(df.withColumn("node", F.lit(0)).withColumn("bucket", F.lit(0)), shingle=2)
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in out.collect())
    assert got == [(-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False), (11, 11, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    kept = near_dedup.keep_representatives(df.withColumn("_gone", F.lit(1)), shingle=2)
    assert kept.columns == ["doc_id", "text", "_gone"] and kept.count() == 4


def test_rows_of_one_document_tie_their_groups(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "k l m n o"
    data = [(3, a), (5, a), (5, b), (9, b), (9, None), (11, c), (12, c), (12, ""), (13, ""), (20, "x y"), (20, "y x"), (21, "y x")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(data, DOC), shingle=2).collect()}
    assert got == {(3, 7): 3, (5, 7): 3, (9, 7): 3, (9, 0): 3, (11, 4): 11, (12, 4): 11, (12, 0): 11, (13, 0): 13, (20, 1): 20, (21, 1): 20}


def test_op6_whole_table(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_near_dedup(spark, SF).collect()}
    assert got == near_components(data, 2)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    common_part = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common_part, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2))
    same = np.mean(near_dedup.signature(a) == near_dedup.signature(b))
    assert abs(same - 0.8**4) < 0.25 and len(near_dedup.signature(a)) == near_dedup.BANDS


def test_word_hashes_follow_the_words():
    texts = ["A b  C", None, "", "a\tb\x0bc d", "x" * 5000, " lead", "trail ", "ab", "a b", "É é"]
    texts.append(" ".join(f"w{i}" for i in range(400_000)))  # longer than a chunk
    got = list(common.word_hashes(pa.array(texts)))
    known = {}
    for t, h in zip(texts, got):
        w = words(t)
        assert len(h) == len(w)
        for x, y in zip(w, h.tolist()):
            assert known.setdefault(x, y) == y
    assert len(set(known.values())) == len(known)


def test_sets_match_sizes():
    for t in ["a b a b a", "one", "a b", ""]:
        (w,) = common.word_hashes(pa.array([t]))
        for k in (1, 2, 5):
            assert len(near_dedup.shingle_set(w, k)) == len(shingles(t, k))


# --- decontamination ----------------------------------------------------------------

PASSAGE = "What is the boiling point of water at sea level in kelvin? Answer: 373.15 degrees."
BENCH = [(1, PASSAGE), (2, "short item"), (3, None), (4, "... !!!"), (5, "What is the boiling point of water at sea level in celsius"), (5, PASSAGE), (None, "null id words")]
DOCS = [
    (1, f"Intro é. {PASSAGE.upper()} outro"), (2, "WHAT is, the boiling-point of water at sea level in kelvin"), (3, "a Short\n\nITEM here; short item"),
    (4, None), (5, ""), (6, "?!"), (7, "clean text"), (8, "null id words"), (9, "x " * 50_000 + PASSAGE), (10, "shortitem short itemised"),
]


def check(spark, docs, bench, **how):
    got = decontaminate.decontaminate(
        spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, "item_id long, text string"), **how).collect()
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got}, {r.doc_id: r.spans for r in got}


@pytest.mark.parametrize("bound", [1 << 20, 200])
def test_contamination_equals_brute_force(spark, bound):
    got, spans = check(spark, DOCS, BENCH, max_bytes=bound)
    assert got == contamination(DOCS, BENCH)
    assert got[8][1:3] == (3, 0) and got[8][4]  # an item without id still contaminates
    a, b = map(int, spans[3].split(",")[0].split(":"))
    assert DOCS[2][1][a:b] == "Short\n\nITEM"
    a, b = map(int, spans[1].split(":"))
    assert DOCS[0][1][a:b] == PASSAGE.upper()[:-1]


def test_contaminated_documents_are_dropped(spark):
    docs, bench = spark.createDataFrame(DOCS, DOC), spark.createDataFrame(BENCH, "item_id long, text string")
    want = sorted(d for d, v in contamination(DOCS, BENCH).items() if not v[4])
    for bound in (1 << 20, 200):
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench, max_bytes=bound).collect()) == want


def test_decontaminate_edges(spark):
    docs = spark.createDataFrame([(1, "short item"), (1, "short item"), (None, "short item")], DOC).withColumn("_row", F.lit(1))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert [r.n_items for r in decontaminate.decontaminate(docs, bench).collect()] == [1, 1, 1]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert [r.contaminated for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()] == [False] * 3
