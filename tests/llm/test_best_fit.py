"""Packing: ids against the vocabulary's own library, invariants of the packing, and its quality
against plain best-fit decreasing."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlake.llm import best_fit, bin_plan, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PART = best_fit.PIECES


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def ids_of(texts):
    return [x.ids + [2] for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def whole_packing(rows, capacity):
    """Checks sequences (gapless from 0, not over the capacity) and gives their number."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for got in by.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def decreasing(lengths, capacity):
    """Bins of plain best-fit decreasing, piece by piece."""
    slack = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, s in enumerate(slack) if s >= x]
        if fit:
            slack[min(fit, key=lambda i: slack[i])] -= x
        else:
            slack.append(capacity - x)
    return len(slack)


def test_query_packs_every_document_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, ids in zip(docs, ids_of([d.text for d in docs])):
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[d.doc_id, k] = (lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()))
    df = queries.op12_best_fit(spark, SF)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = df.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = whole_packing(rows, 1024)
    assert n <= decreasing([w[1] for w in want.values()], 1024) * 1.01 + 1


def test_odd_texts_and_copies(spark, vocabulary):
    odd = [None, "", " ", "x", "a" * 5000, "\n\n\t  é́ 漢字 🙂‍🙂 \x00 end", "<|endoftext|> and <|endoftext", "word " * 4000, " " * 3000 + "7" * 3000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, "no id")] * 2 + [(3, "x")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("kind", F.lit(1))
    got = best_fit.pack_documents(df, vocabulary).collect()
    want = collections.Counter()
    for (d, _), ids in zip(rows, ids_of([t for _, t in rows])):
        want.update((d, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())) for k, (lo, hi) in enumerate(best_fit.cut(ids, 1024)))
    assert collections.Counter(tuple(r[:5]) for r in got) == want
    assert whole_packing(got, 1024) <= -(-sum(r.length for r in got) // 1024) + 3


def test_empty_table(spark, vocabulary):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert best_fit.pack_documents(none, vocabulary).count() == 0


def test_cut_leaves_only_the_first_piece_short():
    for n in (1, 9, 10, 11, 20, 25):
        got = best_fit.cut(np.arange(n), 10)
        assert [i for a, b in got for i in range(a, b)] == list(range(n)) and all(b - a == 10 for a, b in got[1:])


@pytest.mark.parametrize("seed,kind", [(0, "even"), (1, "small"), (2, "large"), (3, "hot"), (4, "full")])
def test_packing_of_lengths(spark, seed, kind):
    rng, n = np.random.default_rng(seed), 4000
    lengths = {
        "even": rng.integers(1, 101, n), "small": rng.integers(1, 13, n), "large": rng.integers(40, 101, n),
        "hot": np.where(rng.random(n) < 0.4, 37, rng.integers(1, 101, n)), "full": np.full(n, 100)}[kind]
    parts = spark.createDataFrame([(i, 0, 0, int(x), i) for i, x in enumerate(lengths)], PART)
    got = best_fit.pack(parts, 100).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(i, int(x)) for i, x in enumerate(lengths)]
    assert whole_packing(got, 100) <= decreasing(lengths.tolist(), 100) * 1.01 + 1


def test_groups_round_up_and_configurations_hold_the_demand():
    rng = np.random.default_rng(5)
    have = dict(collections.Counter(rng.integers(1, 101, 5000).tolist()))
    groups = bin_plan.group(have, 12, 100, 20)
    for size, first, n in groups:
        assert n == sum(c for x, c in have.items() if first <= x <= size)
    assert sum(g[2] for g in groups) == sum(c for x, c in have.items() if x > 12)
    share = sum(c for x, c in have.items() if 12 < x < 100) / 20
    assert all(n <= share or first == size for size, first, n in groups)
    sizes, demand = [g[0] for g in groups], [g[2] for g in groups]
    plan = bin_plan.configurations(sizes, demand, 100)
    assert [sum(c[k] * n for c, n in plan) for k in range(len(sizes))] == demand
    assert all(sum(m * s for m, s in zip(c, sizes)) <= 100 for c, _ in plan)
    assert sum(n for _, n in plan) >= -(-sum(s * d for s, d in zip(sizes, demand)) // 100)


def test_ranks_are_dense_in_every_class(spark):
    df = spark.range(5000).selectExpr("id", "cast(if(id % 3 = 0, 7, id % 50) as int) AS kind")
    counts = {r[0]: r[1] for r in df.groupBy("kind").count().collect()}
    got = collections.defaultdict(list)
    for r in best_fit.ranked(df, "kind", counts, ["id"], "no").collect():
        got[r.kind].append(r.no)
    assert all(sorted(v) == list(range(counts[k])) for k, v in got.items()) and len(got) == len(counts)
