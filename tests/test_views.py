from spanlake.sources import views
from conftest import SF_MID


def test_containment_matches_brute_force(spark):
    docs = [
        (1, "The quick brown fox jumps over the lazy dog. Café au lait, s'il vous plaît."),
        (2, "Lazy dogs sleep; quick foxes jump!"),
        (3, "xyz"),
        (4, "jumps over the lazy dog"),
    ]
    items = [
        (10, "quick brown fox jumps"),      # inner words
        (11, "fox jumps over the lazy"),     # inner words, several docs share some words
        (12, "lait, s'il"),                  # two word runs, no inner word
        (13, "azy do"),                      # partial words only
        (14, "y"),                           # one character
        (15, "not here at all"),
        (16, "over the lazy dog"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in views.containment_pairs(d, i).collect())
    want = sorted((di, ii) for di, dt in docs for ii, it in items if it in dt)
    assert got == want


def test_qa_examples_view_is_whole(spark):
    import duckdb

    ex = views.qa_examples(spark, SF_MID)
    con = duckdb.connect()
    n = con.execute(
        f"SELECT count(*) FROM read_parquet('{SF_MID}/documents.parquet') d "
        f"JOIN read_parquet('{SF_MID}/benchmark.parquet') b ON instr(d.text, b.text) > 0"
    ).fetchone()[0]
    rows = ex.collect()
    assert len(rows) == n
    for r in rows:
        assert r.context[r.answer_start:r.answer_end] == r.answer
        assert r.context.find(r.answer) == r.answer_start


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "xay b"), (2, "zz"), (3, None), (4, ""), (5, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "y b"), (3, "zz"), (4, ""), (5, None), (6, "two"), (7, "one two three"), (8, "zzz")], "item_id long, text string")
    got = sorted(tuple(r) for r in views.containment_pairs(docs, items).collect())
    assert got == [(1, 1), (1, 2), (2, 3), (5, 6), (5, 7)]


def test_source_partitions_setting(spark, tmp_path):
    spark.range(100).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert views.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() == 1
    spark.conf.set(views.PARTITIONS_CONF, "7")
    try:
        assert views.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() == 7
    finally:
        spark.conf.unset(views.PARTITIONS_CONF)
