"""The pipeline's stages against brute force, each on what its predecessor kept."""

from brute import contamination, near_components, removed_lines, targets, words
from pyspark.sql import functions as F

import corpus_pipeline as P
from spanlake.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_documents(docs, model).where("predicted = 1").collect()}

    now = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            want = {d: r["text"] for d, r in rows.items() if d not in toxic}
        elif name == "line_dedup":
            want = {d: t for d, (n, gone, t) in removed_lines(now.items()).items() if not n or len(gone) < n}
        elif name == "near_dedup":
            want = {d: now[d] for d, (_, c) in near_components(list(now.items()), 5).items() if c == d}
        else:
            want = {d: now[d] for d, v in contamination(now.items(), bench).items() if not v[4]}
        assert got == want, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        now = got
    size = {}
    for d, t in now.items():
        size[rows[d]["source"]] = size.get(rows[d]["source"], 0) + len(words(t))
    goal = targets(size)
    final = P.run(spark, SF).collect()
    assert {r.doc_id for r in final} <= set(now) and all(0 < r.taken <= 2 * r.size for r in final)
    for s in goal:
        assert sum(r.taken for r in final if r.source == s) == int(goal[s])


def test_stages_keep_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "word", "en", None, 4), (3, "b c", "en", "a", 3)],
        "doc_id long, text string, lang string, source string, n_chars long").withColumn("covered", F.lit(1))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 4, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert sorted((r.source or "", r.taken) for r in P.STAGES[-1][1](spark, docs, SF).collect())
    assert P.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
