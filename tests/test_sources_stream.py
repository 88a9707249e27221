import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from spanlake.operators.flatten import flatten_qa, strip_questions, to_references
from spanlake.operators.tokens import tokenize_offsets
from spanlake.sources import files, rowid
from spanlake.streaming import qa_stream

NESTED = {
    "data": [{
        "paragraphs": [
            {"context": "Café ☕ policy, \"quoted\"\nline two 😀 é.",
             "qas": [
                 {"question": "\t What is it? ", "id": "q1", "answers": [{"text": "policy", "answer_start": 7}]},
                 {"question": "Two?", "id": "q2",
                  "answers": [{"text": "Café", "answer_start": 0}, {"text": "policy", "answer_start": 7}]},
                 {"question": "None?", "id": "q3", "answers": []},
             ]},
        ]
    }]
}


def _write_json(d):
    folder = tempfile.mkdtemp(prefix="spanlake-json-")
    with open(os.path.join(folder, "doc.json"), "w", encoding="utf-8") as f:
        json.dump(NESTED, f, ensure_ascii=False)
    return folder


def test_json_flatten_and_strip(spark):
    df = strip_questions(flatten_qa(files.read_qa_json(spark, _write_json(NESTED))))
    rows = {r.id: r for r in df.collect()}
    assert rows["q1"].question == "What is it?"
    assert rows["q1"].answer == "policy" and rows["q1"].answer_end == 13
    assert rows["q2"].answer == "Café"
    assert rows["q3"].answer == "NA" and rows["q3"].answer_start is None and rows["q3"].answer_end is None
    ctx = rows["q1"].context
    assert ctx[rows["q1"].answer_start:rows["q1"].answer_end] == "policy"
    refs = to_references(df).where("id = 'q1'").first()
    assert list(refs.answers.text) == ["policy"] and list(refs.answers.answer_start) == [7]


def test_csv_round_trip_with_pandas(spark):
    df = flatten_qa(files.read_qa_json(spark, _write_json(NESTED)))
    out = os.path.join(tempfile.mkdtemp(prefix="spanlake-csv-"), "train")
    files.write_examples_csv(df, out)
    back = files.read_examples_csv(spark, out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    na = files.read_examples_csv(spark, out, na_as_null=True).where("id = 'q3'").first()
    assert na.answer is None
    # files written by pandas read back the same way
    pdir = tempfile.mkdtemp(prefix="spanlake-pd-")
    df.toPandas().to_csv(os.path.join(pdir, "val.csv"), index=False)
    from_pd = files.read_examples_csv(spark, os.path.join(pdir, "val.csv"))
    assert sorted(r.context for r in from_pd.collect()) == sorted(r.context for r in df.collect())
    splits = files.load_splits(spark, {"train": out, "val": os.path.join(pdir, "val.csv")})
    assert {r.split: r["count"] for r in splits.groupBy("split").count().collect()} == {"train": 3, "val": 3}


def test_tsv_projection_and_ids(spark):
    d = tempfile.mkdtemp(prefix="spanlake-tsv-")
    pd.DataFrame({"Extra": [1, 2, 3], "Query": ["q a", "q b", "q a"], "Segment": ["s, 1", "s \"2\"", "s, 1"],
                  "More": ["x", "y", "z"]}).to_csv(os.path.join(d, "t.tsv"), sep="\t", index=False)
    t = files.read_pairs_tsv(spark, os.path.join(d, "t.tsv"))
    assert t.columns == ["Query", "Segment"]
    assert sorted(map(tuple, t.collect())) == [("q a", "s, 1"), ("q a", "s, 1"), ("q b", 's "2"')]
    ids = rowid.with_row_id(t).select("row_id").distinct().count()
    assert ids == 3
    keys = rowid.with_key_id(t, ["Query", "Segment"]).select("row_key").distinct().count()
    assert keys == 2
    d1 = rowid.describe_dataset(t).first()
    assert d1.features == "Query, Segment" and d1.num_rows == 3
    assert rowid.preview(t, "Query", 1).first().Query == "q a"


def test_stream_flatten(spark):
    src = _write_json(NESTED)
    path = qa_stream.run_to_parquet(qa_stream.qa_json_stream(spark, src), "test-stream")
    got = spark.read.parquet(path)
    assert got.count() == 3
    assert got.where("id = 'q1'").first().question == "What is it?"


def test_stream_windows_and_labels(spark):
    from spanlake.operators import windows

    src = _write_json(NESTED)
    stream = qa_stream.qa_json_stream(spark, src)
    feats = windows.align_span(
        windows.window_features(stream, 16, 4, 3, keep=["answer_start", "answer_end"],
                                answer_cols=("answer_start", "answer_end"))
    ).select("id", "window_no", "start_position", "end_position", "ctx_text")
    path = qa_stream.run_to_parquet(feats, "test-stream-windows")
    got = spark.read.parquet(path)
    static = windows.align_span(
        windows.window_features(
            strip_questions(flatten_qa(files.read_qa_json(spark, src))), 16, 4, 3,
            keep=["answer_start", "answer_end"], answer_cols=("answer_start", "answer_end"),
        )
    ).select("id", "window_no", "start_position", "end_position", "ctx_text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, static.collect()))


def test_stream_of_a_table_in_one_file_or_many(spark):
    """Tables are one file, or a folder of part files that a stream reads whole, in several micro-batches too."""
    docs = spark.createDataFrame([(i, f"Word {i}, more." if i % 5 else None) for i in range(40)], "doc_id long, text string")
    many, one = tempfile.mkdtemp(prefix="spanlake-many-"), tempfile.mkdtemp(prefix="spanlake-one-")
    docs.repartition(5).write.parquet(f"{many}/documents.parquet")
    docs.limit(3).write.parquet(f"{many}/other.parquet")
    docs.toPandas().to_parquet(f"{one}/documents.parquet")
    docs.limit(3).toPandas().to_parquet(f"{one}/my_documents.parquet")
    want = sorted(map(tuple, tokenize_offsets(docs, "doc_id", "text").collect()))
    for folder in (many, one):
        path = qa_stream.run_to_parquet(qa_stream.token_stream(spark, folder), "test-tokens")
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == want
    batches = qa_stream.parquet_table_stream(spark, many, "documents", files_per_batch=2).select("doc_id")
    path = qa_stream.run_to_parquet(batches, "test-batches")
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == list(range(40))
