"""Ranks by range, duplicates by hash, documents of varying shape."""

import contextlib
import io
import json
import re

from pyspark.sql import functions as F

from spanlake.operators import dedup, encode, sampling
from spanlake.sources import files


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_vocabulary_with_one_prefix_on_most_tokens(spark):
    words = [f"pre{i}" for i in range(900)] + [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(" ".join(words[i::7]) + (" pre1 pre1" if i == 0 else ""),) for i in range(7)], "text string")
    v = encode.build_vocab(df, ["text"])
    got = {r.tok: (r.cnt, r.id) for r in v.collect()}
    counts = {w: 1 + 2 * (w == "pre1") for w in words}
    order = sorted(counts, key=lambda w: (-counts[w], w))
    assert got == {w: (counts[w], 4 + i) for i, w in enumerate(order)}
    assert not re.search(r"^\(\d+\) Window", _plan(v), re.M)


def test_range_rank_is_dense_on_many_partitions(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("k")).repartition(17)
    got = [(r.k, r.rank) for r in sampling.range_rank(df, [F.col("k")]).collect()]
    assert [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got) and sorted(r for _, r in got) == list(range(1, 3001))
    assert sampling.range_rank(df.limit(0), [F.col("k")]).count() == 0


def _unique(rows, key):
    return sorted(r for r in rows if sum(key(x) == key(r) for x in rows) == 1)


def test_duplicates_with_and_without_broadcast(spark, monkeypatch):
    rows = [(i, f"text {i % 40}" if i < 60 else f"own {i}", None if i % 9 else "x") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, tag string")
    for bound in (dedup.BROADCAST_HASHES, 0):
        monkeypatch.setattr(dedup, "BROADCAST_HASHES", bound)
        got = sorted((r.id, r.text, r.tag) for r in dedup.drop_all_duplicates(df, ["text"]).collect())
        assert [g[0] for g in got] == [r[0] for r in _unique(rows, lambda r: r[1])]
        assert dedup.drop_all_duplicates(df.select("tag")).count() == 0 and dedup.drop_all_duplicates(df.limit(0), ["text"]).count() == 0
    nulls = spark.createDataFrame([(None, "a"), ("a", None), (None, None), (None, None)], "x string, y string")
    assert sorted(map(str, dedup.drop_all_duplicates(nulls).collect())) == ["Row(x='a', y=None)", "Row(x=None, y='a')"]


def test_texts_of_unique_rows_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, text string")
    plan = _plan(dedup.drop_all_duplicates(df, ["text"]).select("id"))
    moved = [x for x in re.findall(r"^\(\d+\) Exchange\n(Input .*)$", plan, re.M) if "text" in x]
    # only behind the semi join with the repeated hashes, in the exact grouping
    assert len(moved) <= 1 and "LeftSemi" in plan and "LeftAnti" in plan, plan[:3000]


def test_documents_of_varying_shape(spark, tmp_path):
    good = {"data": [{"paragraphs": [{"context": "one two", "qas": [{"question": "q1", "id": "a", "answers": [{"text": "two", "answer_start": 4}]},
                                                                        {"question": "q2", "id": 7, "answers": []}]},
                                      {"context": "three", "qas": [{"question": "q3", "id": "c"}], "extra": {"x": 1}}]}], "version": 2}
    odd = [{"data": [{"paragraphs": [{"context": "z", "qas": [{"question": "q4", "id": "d", "answers": [{"text": "z", "answer_start": "0"}]}]}]}]},
           {"data": "none"}, {}, {"data": [{"title": "t"}]}, {"data": [{"paragraphs": [{"qas": [{"id": "e"}]}]}]}, {"data": [{"paragraphs": [{"context": "k"}]}]},
           {"data": [{"paragraphs": [{"context": "m", "qas": [{"id": "f", "question": "q", "answers": [{"text": "m"}]}]}]}]}, [1, 2], 5]
    for i, d in enumerate([good, *odd]):
        (tmp_path / f"{i}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "bad.json").write_text('{"data": [')
    (tmp_path / "empty.json").write_text("\n")
    rows = [tuple(r) for r in files.read_qa_variant(spark, str(tmp_path)).collect()]
    want = [("q1", "two", 4, 7, "one two", "a", None), ("q2", "NA", None, None, "one two", "7", None), ("q3", "NA", None, None, "three", "c", None),
            ("q4", "z", 0, 1, "z", "d", None), (None, "NA", None, None, None, "e", "no context"), (None, None, None, None, "k", None, "no questions"),
            ("q", "m", None, None, "m", "f", "no answer start")]
    want += [(None,) * 6 + (p,) for p in ["no data"] * 4 + ["no paragraphs", "not json"]]
    assert sorted(map(str, rows)) == sorted(map(str, want))
