"""Views of the QA data model on the driver's parquet tables.

``qa_examples``  documents that contain a benchmark passage, as flat QA examples (M2)
``qa_nested``    the same examples folded into the nested QA document shape (M1)
``pairs``        user turn -> next assistant turn (M3)
``runs``         scripted predictions per run over ``qa_examples`` (M10 + M14)
``span_logits``  model-output contract (M8): windows of every document that has a
                 logit vector in ``embeddings`` (joined by key before tokenising)

All views read whole tables; none samples or caps rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.arrays import explode_rows
from spanlake.functions.text import WORD_CLASS


#: Session setting: deal the text tables out to this many partitions (0: leave the scan's
#: splits). Needed only where a table is one unsplittable file, as the test tables are.
PARTITIONS_CONF = "spanlake.source.partitions"
SPREAD_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = int(spark.conf.get(PARTITIONS_CONF, "0"))
    return df.repartition(n, SPREAD_KEYS[name]) if n and name in SPREAD_KEYS else df


def _words(col):
    """Maximal word runs of a text."""
    return F.regexp_extract_all(col, F.lit(f"[{WORD_CLASS}]+"), F.lit(0))


def _inner_words(col):
    """Word runs with a non-word character on both sides *inside* the text: such a run
    is also a whole word run of any text that contains this one."""
    pat = f"(?<=[^{WORD_CLASS}])[{WORD_CLASS}]+(?=[^{WORD_CLASS}])"
    return F.regexp_extract_all(col, F.lit(pat), F.lit(0))


def _grams(col, sizes):
    """Distinct substrings of the given sizes."""
    def of(n):
        return F.when(F.length(col) >= n, F.transform(F.sequence(F.lit(1), F.length(col) - n + 1), lambda i: F.substring(col, i, F.lit(n))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[of(n) for n in sizes]))))


def containment_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, text, item_text, at) with ``at = instr(text, item_text) > 0``, exactly.

    Equi-join plan instead of testing every document against every item: each item is
    anchored on its rarest inner word (fewest documents), candidates come from an
    equi-join of document words with anchors, and only candidates run ``instr``. Items
    without an inner word (two tokens or less) are anchored on their first characters
    (three at most), which join the documents' substrings of that size; the documents'
    substrings are made only if such items exist (a scalar subquery of the same plan).
    Inputs: docs(doc_id, text), items(item_id, text).
    """
    gen, keep = explode_rows(F.array_distinct(_inner_words("text")), "w")
    item_words = items.select("item_id", gen).where(keep)
    gen, keep = explode_rows(F.array_distinct(_words("text")), "w")
    doc_words = docs.select("doc_id", gen).where(keep)
    vocab = item_words.select("w").distinct()
    doc_freq = doc_words.join(vocab, "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    anchors = (
        item_words.join(doc_freq, "w")
        .groupBy("item_id")
        .agg(F.min(F.struct("df", "w")).alias("a"))
        .select("item_id", F.col("a.w").alias("w"))
    )
    cands = doc_words.join(anchors, "w").select("doc_id", "item_id")
    short = items.where((F.size(_inner_words("text")) == 0) & (F.length("text") > 0)).select("item_id", F.substring("text", 1, 3).alias("w"))
    n_short = short.agg(F.count(F.lit(1))).scalar()
    gen, keep = explode_rows(F.when(n_short > 0, _grams(F.col("text"), (1, 2, 3))), "w")
    near = docs.select("doc_id", gen).where(keep).join(short, "w").select("doc_id", "item_id")
    return (
        cands.unionByName(near)
        .join(docs, "doc_id")
        .join(items.select("item_id", F.col("text").alias("item_text")), "item_id")
        .withColumn("at", F.instr("text", F.col("item_text")))
        .where(F.col("at") > 0)
    )


def containment_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All (doc_id, item_id) with ``instr(doc.text, item.text) > 0``."""
    return containment_matches(docs, items).select("doc_id", "item_id")


def qa_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat QA examples (M2): context = document, answer = contained benchmark passage,
    question = that passage. ``id = '<doc_id>-<item_id>'``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = containment_matches(docs, items)
    return found.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("item_id").cast("string")).alias("id"),
        "doc_id",
        "item_id",
        F.col("item_text").alias("question"),
        F.col("item_text").alias("answer"),
        (F.col("at") - 1).alias("answer_start"),
        (F.col("at") - 1 + F.length("item_text")).alias("answer_end"),
        F.col("text").alias("context"),
    )


# fixed value: at most this many questions are folded into one paragraph
QAS_PER_PARAGRAPH = 8


def qa_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples folded back into the nested document shape (M1): one row per
    paragraph (the document) holding its questions as ``qas``.

    Questions of one document are grouped by ``item_id div 8``, so every collected
    group holds at most 8 questions by construction -- a document that contains a large
    share of all passages becomes several paragraphs, never one unbounded row."""
    ex = qa_examples(spark, sf_dir)
    qa = F.struct(
        F.col("question"),
        F.col("id"),
        F.array(F.struct(F.col("answer").alias("text"), F.col("answer_start"))).alias("answers"),
    )
    para = ex.groupBy("doc_id", F.floor(F.col("item_id") / QAS_PER_PARAGRAPH).alias("_part")).agg(
        F.any_value("context").alias("context"), F.collect_list(qa).alias("qas")
    )
    return para.select(
        F.array(
            F.struct(F.array(F.struct("context", "qas")).alias("paragraphs"))
        ).alias("data")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query/segment pairs (M3): a user turn and the assistant turn right after it."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("Query"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("Segment")
    )
    return u.join(a, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
        "conv_id",
        "turn",
        "Query",
        "Segment",
    )


def runs(spark: SparkSession, sf_dir: str, examples: DataFrame | None = None) -> DataFrame:
    """Scripted predictions: ``exact`` (the answer), ``wide`` (answer plus up to 20
    characters each side) and ``empty``; columns (run, id, prediction_text)."""
    ex = examples if examples is not None else qa_examples(spark, sf_dir)
    wide_from = F.greatest(F.col("answer_start") - 20, F.lit(0))
    wide = F.substring(
        "context", wide_from + 1, F.col("answer_end") + 20 - wide_from
    )
    return ex.select(
        "id",
        F.explode(
            F.array(
                F.struct(F.lit("exact").alias("run"), F.col("answer").alias("prediction_text")),
                F.struct(F.lit("wide").alias("run"), wide.alias("prediction_text")),
                F.struct(F.lit("empty").alias("run"), F.lit("").alias("prediction_text")),
            )
        ).alias("p"),
    ).select(F.col("p.run").alias("run"), "id", F.col("p.prediction_text").alias("prediction_text"))


def references(examples: DataFrame) -> DataFrame:
    """Reference answers (M11): ``id, answers struct<text array, answer_start array>``."""
    return examples.select(
        "id",
        F.struct(
            F.array(F.col("answer")).alias("text"), F.array(F.col("answer_start")).alias("answer_start")
        ).alias("answers"),
    )


# fixed values: questions asked about each document, and the distance of their item ids
QUESTIONS_PER_DOC, ITEM_CYCLE = 4, 40


def asked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with several questions (M1 unnested): the passages whose id is (doc_id + 10 k)
    modulo 40, k = 0..3. The answer is the passage if the document contains it, else none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    step = ITEM_CYCLE // QUESTIONS_PER_DOC
    wanted = F.transform(F.sequence(F.lit(0), F.lit(QUESTIONS_PER_DOC - 1)), lambda k: F.pmod(F.col("doc_id") + k * step, F.lit(ITEM_CYCLE)))
    asked = docs.select("*", F.explode(wanted).alias("item_id")).join(items, "item_id")
    at = F.instr("context", F.col("question"))
    return asked.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("item_id").cast("string")).alias("id"), "doc_id", "question", "context",
        F.when(at > 0, at - 1).alias("answer_start"), F.when(at > 0, at - 1 + F.length("question")).alias("answer_end"))


# fixed values: the span_logits contract of the test views
SPAN_MAX_LENGTH = 64
SPAN_STRIDE = 16
SPAN_N_BEST = 5
SPAN_MAX_ANSWER = 10


def doc_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a question-less example: ``id`` (= doc_id), ``context``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("context")
    )


def embedding_logits(features: DataFrame, size: Column | None = None) -> DataFrame:
    """Model output per window from the document's vector ``_e`` (attached by key,
    D3): rotated left by ``window_no`` for start logits, reversed for end logits. With
    ``size`` both are repeated cyclically to that many positions."""
    n = F.size("_e")
    start = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("_e"), (i + F.col("window_no")) % n)
    )
    out = features.withColumn("start_logits", start).withColumn("end_logits", F.reverse("start_logits"))
    if size is not None:
        for c in ("start_logits", "end_logits"):
            out = out.withColumn(c, F.slice(F.flatten(F.array_repeat(F.col(c), F.ceil(size / n).cast("int"))), F.lit(1), size))
    return out.drop("_e")


def logits_table(spark: SparkSession, sf_dir: str, max_length: int = 512, stride: int = 128) -> DataFrame:
    """Model output as a table (M8): (id, window_no, start_logits, end_logits) for every window of
    every document that has a vector, one value per position of the packed sequence."""
    from spanlake.operators.windows import window_features

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("_e")).where(F.size("_e") > 0)
    feats = window_features(doc_examples(spark, sf_dir).join(e, "id"), max_length, stride, question_col=None, keep=["_e"])
    return embedding_logits(feats.select("id", "window_no", "seq_len", "_e"), F.col("seq_len")).drop("seq_len")


def vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` of the documents that have a vector."""
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(F.col("vec_id").alias("id"))


def logits_of(spark: SparkSession, sf_dir: str, features: DataFrame) -> DataFrame:
    """Model output (id, window_no, start_logits, end_logits) for finished windows (id, window_no, seq_len)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("_e")).where(F.size("_e") > 0)
    return embedding_logits(features.join(e, "id"), F.col("seq_len")).drop("seq_len")


def span_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every document that has a vector (64 positions, stride 16) with
    logits attached. The key join runs before tokenising, so documents without
    model output are never tokenised."""
    from spanlake.operators.windows import window_features

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("_e"))
    docs = doc_examples(spark, sf_dir).join(e, "id")
    feats = window_features(
        docs, max_length=SPAN_MAX_LENGTH, stride=SPAN_STRIDE, question_col=None, keep=["_e"],
    )
    return embedding_logits(feats)
