"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each one reads the driver's tables (whole tables, or tables Spark derives from them)
and has a DuckDB twin in ``sql_oracle.ORACLE`` with identical column names. Integer
outputs are cast to bigint and doubles rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.functions import subwords
from spanlake.functions.arrays import top_n_indices
from spanlake.operators import contexts, decode, dedup, encode, sampling, scoring, windows
from spanlake.operators.flatten import flatten_qa, to_pair_references
from spanlake.operators.metrics import bleu, registry, rouge, squad
from spanlake.operators.tokens import tokenize_offsets
from spanlake.plans import pairs as pair_plan
from spanlake.plans import span as span_plan
from spanlake.session import cut_lineage
from spanlake.sources import rowid, views

SEED = 42  # fixed value: seed of every shuffle, sample and split in the queries


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    """QA examples for queries that read them in several branches: written once into the
    shared checkpoint folder."""
    return cut_lineage(views.qa_examples(spark, sf))


def _round(c, n: int = 6):
    return F.round(c.cast("double"), n)


def q_flatten_qa(spark: SparkSession, sf: str) -> DataFrame:
    flat = flatten_qa(views.qa_nested(spark, sf))
    return flat.select(
        "question",
        "answer",
        F.col("answer_start").cast("bigint").alias("answer_start"),
        F.col("answer_end").cast("bigint").alias("answer_end"),
        "context",
        "id",
    )


def q_squad_em_f1(spark: SparkSession, sf: str) -> DataFrame:
    ex = _examples(spark, sf)
    refs = views.references(ex)
    preds = views.runs(spark, sf, ex)
    rows = squad.squad_rows(refs.join(preds, "id"))
    return rows.select("run", "id", "em", _round(F.col("f1")).alias("f1"))


def q_drop_all_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    out = dedup.drop_all_duplicates(docs, ["text"])
    return out.select("doc_id", "lang", "source", "n_chars")


def q_drop_all_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = views.pairs(spark, sf).select("Query", "Segment")
    return dedup.drop_all_duplicates(p)


def q_shuffle_rank(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id")
    return sampling.shuffle(docs, "doc_id", SEED).select("doc_id", F.col("rank").cast("bigint").alias("rank"))


def q_sample_exact(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "lang")
    s = sampling.sample_exact(docs, "doc_id", 100, SEED)
    return s.select("doc_id", "lang", F.col("rank").cast("bigint").alias("rank"))


def q_train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    p = views.pairs(spark, sf).select("pair_id")
    s = sampling.train_val_split(p, "pair_id", 0.10, SEED)
    return s.select("pair_id", "split", F.col("rank").cast("bigint").alias("rank"))


def q_tokenize_offsets(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    t = tokenize_offsets(docs, "doc_id", "text")
    return t.select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        "tok",
        F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
    )


WIN_MAX_LENGTH, WIN_STRIDE = 128, 32  # driver queries: small windows so contexts overflow


def _qa_windows(spark: SparkSession, sf: str, ex: DataFrame | None = None,
                keep: list[str] | None = None) -> DataFrame:
    ex = ex if ex is not None else views.qa_examples(spark, sf)
    return windows.window_features(
        ex, max_length=WIN_MAX_LENGTH, stride=WIN_STRIDE,
        keep=["answer_start", "answer_end", *(keep or [])],
        answer_cols=("answer_start", "answer_end"),
    )


def q_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    f = _qa_windows(spark, sf)
    return f.select(
        "id", *[F.col(c).cast("bigint").alias(c) for c in
                ["window_no", "q_len", "ctx_first", "n_ctx", "seq_len", "ctx_start", "ctx_end"]]
    )


def q_align_span(spark: SparkSession, sf: str) -> DataFrame:
    f = windows.align_span(_qa_windows(spark, sf))
    return f.select(
        "id", *[F.col(c).cast("bigint").alias(c) for c in ["window_no", "start_position", "end_position"]]
    )


def q_top_n_indices(spark: SparkSession, sf: str) -> DataFrame:
    fl = views.span_logits(spark, sf)
    n = views.SPAN_N_BEST
    return fl.select(
        F.col("id").cast("bigint").alias("id"),
        F.col("window_no").cast("bigint").alias("window_no"),
        F.array_join(top_n_indices("start_logits", n), " ").alias("top_start"),
        F.array_join(top_n_indices("end_logits", n), " ").alias("top_end"),
    )


def q_best_span(spark: SparkSession, sf: str) -> DataFrame:
    fl = views.span_logits(spark, sf)
    ex = views.doc_examples(spark, sf)
    b = decode.best_span(ex, fl, views.SPAN_N_BEST, views.SPAN_MAX_ANSWER)
    return b.select(
        F.col("id").cast("bigint").alias("id"),
        "prediction_text",
        F.col("start_char").cast("bigint").alias("start_char"),
        F.col("end_char").cast("bigint").alias("end_char"),
        _round(F.col("score"), 5).alias("score"),
    )


def _run_pairs(spark: SparkSession, sf: str) -> DataFrame:
    ex = _examples(spark, sf)
    return views.runs(spark, sf, ex).join(ex.select("id", "answer"), "id").withColumn(
        "refs", F.array(F.col("answer"))
    )


def q_sentence_bleu(spark: SparkSession, sf: str) -> DataFrame:
    r = bleu.with_bleu(_run_pairs(spark, sf), refs="refs", out="bleu")
    return r.select("run", "id", _round(F.col("bleu")).alias("bleu"))


def q_sacre_bleu(spark: SparkSession, sf: str) -> DataFrame:
    r = bleu.with_bleu(_run_pairs(spark, sf), refs="refs", out="sacre_bleu", sacre=True)
    return r.select("run", "id", _round(F.col("sacre_bleu")).alias("sacre_bleu"))


def q_corpus_bleu(spark: SparkSession, sf: str) -> DataFrame:
    r = bleu.with_bleu(_run_pairs(spark, sf), refs="refs", out="bleu")
    c = bleu.corpus_bleu(r, "bleu_stats", by=["run"])
    return c.select("run", _round(F.col("corpus_bleu")).alias("corpus_bleu"))


def _rouge_q(n: int):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        r = _run_pairs(spark, sf)
        r = r.withColumn("s", rouge.rouge_n(F.col("prediction_text"), F.col("answer"), n))
        return r.select(
            "run", "id",
            _round(F.col("s.precision")).alias("precision"),
            _round(F.col("s.recall")).alias("recall"),
            _round(F.col("s.fmeasure")).alias("fmeasure"),
        )

    return q


def q_rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    r = rouge.with_rouge(_run_pairs(spark, sf), ref="answer")
    return r.select(
        "run", "id",
        _round(F.col("rougeL.precision")).alias("precision"),
        _round(F.col("rougeL.recall")).alias("recall"),
        _round(F.col("rougeL.fmeasure")).alias("fmeasure"),
    )


def q_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    ex = _examples(spark, sf)
    lb = registry.leaderboard(views.runs(spark, sf, ex), views.references(ex),
                              metrics=("exact_match", "bleu", "rouge_n"))
    return lb.select("run", F.col("n").cast("bigint").alias("n"),
                     *[_round(F.col(c)).alias(c) for c in lb.columns if c not in ("run", "n")])


def _ids(c):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), " ")


def q_build_vocab(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("text")
    v = encode.build_vocab(docs, ["text"])
    return v.select("tok", F.col("cnt").cast("bigint").alias("cnt"), F.col("id").cast("bigint").alias("id"))


def _pair_vocab(spark: SparkSession, sf: str):
    """Pairs and their vocabulary, each written once (both feed several branches)."""
    p = cut_lineage(views.pairs(spark, sf), "pairs")
    return p, cut_lineage(encode.build_vocab(p, ["Query", "Segment"]), "pairs-vocab")


def q_encode_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p, v = _pair_vocab(spark, sf)
    e = encode.encode_pairs(p, v, "pair_id", 64)
    return e.select("pair_id", _ids("input_ids").alias("input_ids"),
                    _ids("attention_mask").alias("attention_mask"), _ids("labels").alias("labels"))


def q_batch_pad(spark: SparkSession, sf: str) -> DataFrame:
    p, v = _pair_vocab(spark, sf)
    e = encode.encode_pairs(p, v, "pair_id", max_len=None, pad=False)
    b = encode.batch_pad(e, "pair_id", 16, SEED)
    return b.select("pair_id", F.col("batch").cast("bigint").alias("batch"),
                    _ids("input_ids").alias("input_ids"), _ids("attention_mask").alias("attention_mask"),
                    _ids("labels").alias("labels"))


def q_decode_text(spark: SparkSession, sf: str) -> DataFrame:
    p, v = _pair_vocab(spark, sf)
    e = encode.encode_pairs(p, v, "pair_id", 64)
    return encode.decode(e, "pair_id", "labels", v, out="text")


def q_lexical_score(spark: SparkSession, sf: str) -> DataFrame:
    ex = scoring.with_question_idf(_examples(spark, sf))
    h = scoring.lexical_hits(_qa_windows(spark, sf, ex, keep=["_qidf"]))
    return h.select("id", F.col("window_no").cast("bigint").alias("window_no"),
                    F.col("pos").cast("bigint").alias("pos"), _round(F.col("weight")).alias("weight"))


def q_span_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    ex = _examples(spark, sf)
    r = span_plan.run_span_task(ex)
    return r.select("id", "prediction_text", "em", _round(F.col("f1")).alias("f1"))


def _pair_task(generator: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        r = pair_plan.run_pair_task(views.pairs(spark, sf), k_val=None, seed=SEED, generator=generator)
        return r.select("pair_id", "prediction_text", "em", _round(F.col("f1")).alias("f1"), _round(F.col("bleu")).alias("bleu"))

    return q


def q_stream_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.streaming import qa_stream

    out = qa_stream.run_to_parquet(qa_stream.token_stream(spark, sf), "stream-tokens")
    t = spark.read.parquet(out)
    return t.select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        "tok",
        F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
    )


def q_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.session import shared_dir
    from spanlake.sources import files

    ex = views.qa_examples(spark, sf).select("question", "answer", "answer_start", "answer_end", "context", "id")
    path = shared_dir(spark, "examples-csv")
    files.write_examples_csv(ex, path)
    back = files.read_examples_csv(spark, path)
    return back.select(
        "question", "answer",
        F.col("answer_start").cast("bigint").alias("answer_start"),
        F.col("answer_end").cast("bigint").alias("answer_end"),
        "context", "id",
    )


def q_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.session import shared_dir
    from spanlake.sources import files

    path = shared_dir(spark, "nested-json")
    files.write_qa_json(views.qa_nested(spark, sf), path)
    flat = flatten_qa(files.read_qa_json(spark, path, multi_line=False))
    return flat.select(
        "question", "answer",
        F.col("answer_start").cast("bigint").alias("answer_start"),
        F.col("answer_end").cast("bigint").alias("answer_end"),
        "context", "id",
    )


def q_tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.session import shared_dir
    from spanlake.sources import files

    p = views.pairs(spark, sf)
    wide = p.select("pair_id", "conv_id", "Query", "Segment", "turn")  # more columns than kept
    path = shared_dir(spark, "pairs-tsv")
    files.write_pairs_tsv(wide, path)
    return files.read_pairs_tsv(spark, path)


def q_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.operators import dedup as dd

    p = cut_lineage(views.pairs(spark, sf).select("pair_id", "Query", "Segment"), "pairs")
    uniq = dd.drop_all_duplicates(p, ["Query", "Segment"])
    split = cut_lineage(sampling.train_val_split(uniq, "pair_id", 0.10, SEED), "pairs-split")
    train = split.where(F.col("split") == "train").drop("rank", "split")
    sampled = sampling.sample_exact(train, "pair_id", 100, SEED, strict=False)
    return split.agg(
        p.agg(F.count(F.lit(1))).scalar().alias("n_pairs"),
        F.count(F.lit(1)).alias("n_unique"),
        F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
        F.count(F.when(F.col("split") == "val", 1)).alias("n_val"),
        sampled.agg(F.count(F.lit(1))).scalar().alias("n_train_sampled"),
    )


def q_features_per_example(spark: SparkSession, sf: str) -> DataFrame:
    g = decode.group_features(_qa_windows(spark, sf))
    return g.select("id", F.size("windows").cast("bigint").alias("n_windows"),
                    F.array_join(F.col("windows.window_no").cast("array<string>"), " ").alias("window_nos"))


def q_token_span_text(spark: SparkSession, sf: str) -> DataFrame:
    from spanlake.functions.arrays import token_span

    f = windows.align_span(_qa_windows(spark, sf)).where(F.col("start_position") > 0)
    return f.select(
        "id", F.col("window_no").cast("bigint").alias("window_no"),
        token_span("tokens", F.col("start_position"), F.col("end_position")).alias("span_tokens"),
    )


def q_window_edge_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage as an example with a NULL question, with a NULL context, and with a question
    of ten copies of itself (mostly too long): each id comes out, flagged if no window fits."""
    b = views.table(spark, sf, "benchmark").select("item_id", "text")
    none = F.lit(None).cast("string")
    kinds = F.array(
        F.struct(F.lit("no-question").alias("kind"), none.alias("question"), F.col("text").alias("context")),
        F.struct(F.lit("no-context").alias("kind"), F.col("text").alias("question"), none.alias("context")),
        F.struct(F.lit("long-question").alias("kind"), F.repeat(F.concat("text", F.lit(" ")), 10).alias("question"), F.col("text").alias("context")),
    )
    ex = b.select("item_id", F.explode(kinds).alias("k")).select(
        F.concat_ws("-", F.col("item_id").cast("string"), "k.kind").alias("id"), "k.question", "k.context")
    f = windows.window_features(ex, max_length=512, stride=128)
    return f.select("id", F.col("too_long").cast("bigint").alias("too_long"), *[
        F.col(c).cast("bigint").alias(c) for c in ["window_no", "q_len", "ctx_first", "n_ctx", "seq_len"]])


def q_evaluate_missing(spark: SparkSession, sf: str) -> DataFrame:
    """EM and F1 with missing predictions. References: every passage (gold texts: itself and ``the``)
    and, for every passage, one whose only gold text is ``the``. Run ``found`` answers the
    passages that a document contains, with an article and marks added; the ids of run ``stray`` match nothing."""
    b = views.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    golds = lambda c: F.struct(c.alias("text"), F.transform(c, lambda _: F.lit(0)).alias("answer_start")).alias("answers")
    refs = b.select("id", golds(F.array(F.col("text"), F.lit("the")))).unionByName(
        b.select(F.concat(F.lit("the-"), "id").alias("id"), golds(F.array(F.lit("the")))))
    hit = views.qa_examples(spark, sf).select(F.col("item_id").cast("string").alias("id")).distinct()
    found = b.join(hit, "id").select(F.lit("found").alias("run"), "id", F.concat(F.lit("The "), "text", F.lit("!!")).alias("prediction_text"))
    stray = b.select(F.lit("stray").alias("run"), F.concat(F.lit("no-"), "id").alias("id"), F.col("text").alias("prediction_text"))
    out = registry.leaderboard(found.unionByName(stray), refs, metrics=("exact_match",))
    return out.select("run", F.col("n").cast("bigint").alias("n"), _round(F.col("exact_match")).alias("exact_match"), _round(F.col("f1")).alias("f1"))


def q_rouge_report(spark: SparkSession, sf: str) -> DataFrame:
    """The nine ROUGE means of every run."""
    ex = _examples(spark, sf)
    out = registry.leaderboard(views.runs(spark, sf, ex), views.references(ex), metrics=("rouge",))
    return out.select("run", F.col("n").cast("bigint").alias("n"), *[_round(F.col(c)).alias(c) for c in registry.METRICS["rouge"]])


def q_row_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Row ids, content keys, features, count and first row of the documents."""
    docs = views.table(spark, sf, "documents")
    ids = rowid.with_key_id(rowid.with_row_id(docs), ["doc_id", "text"])
    n = ids.agg(F.countDistinct("row_id").alias("n_row_ids"), F.countDistinct("row_key").alias("n_row_keys"))
    first = rowid.preview(docs, "doc_id").agg(F.min("doc_id").alias("first_id"), F.min("lang").alias("first_lang"))
    return rowid.describe_dataset(docs).select(
        "features", "num_rows", n.select("n_row_ids").scalar().alias("n_row_ids"), n.select("n_row_keys").scalar().alias("n_row_keys"),
        first.select("first_id").scalar().alias("first_id"), first.select("first_lang").scalar().alias("first_lang"))


def q_pair_references(spark: SparkSession, sf: str) -> DataFrame:
    return to_pair_references(views.pairs(spark, sf))


def q_load_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Three named splits, written as CSV and loaded into one frame (A5)."""
    from spanlake.session import shared_dir
    from spanlake.sources import files

    p = cut_lineage(sampling.train_val_split(views.pairs(spark, sf), "pair_id", 0.10, SEED), "pairs-split")
    flat = p.select(
        F.col("Query").alias("question"), F.col("Segment").alias("answer"), F.lit(0).alias("answer_start"),
        F.length("Segment").alias("answer_end"), F.col("Segment").alias("context"), F.col("pair_id").alias("id"), "split")
    paths = {}
    for name, part in (("train", flat.where("split = 'train'")), ("validation", flat.where("split = 'val'")), ("all", flat)):
        paths[name] = shared_dir(spark, f"split-{name}")
        files.write_examples_csv(part.drop("split"), paths[name])
    back = files.load_splits(spark, paths)
    return back.select("split", "id", "question", "answer", F.col("answer_end").cast("bigint").alias("answer_end"))


def q_map_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batched one-to-many map (H1): each pair becomes the sentences of its segment."""

    def sentences(pdf):
        parts = pdf["Segment"].str.split(". ", regex=False)
        out = pdf[["pair_id"]].assign(sentence=parts).explode("sentence")
        out["no"] = out.groupby(level=0).cumcount()
        return out[["pair_id", "no", "sentence"]]

    return scoring.map_batches(views.pairs(spark, sf).select("pair_id", "Segment"), sentences, "pair_id string, no long, sentence string")


def q_unanswerable_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn as a question without answers on the assistant turn: answer ``NA``, labels
    (0, 0) in each window (B3, S2, G6)."""
    none = F.array().cast("array<struct<text:string,answer_start:int>>")
    qa = F.struct(F.col("Query").alias("question"), F.col("pair_id").alias("id"), none.alias("answers"))
    nested = views.pairs(spark, sf).select(
        F.array(F.struct(F.array(F.struct(F.col("Segment").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs"))).alias("data"))
    f = windows.align_span(windows.window_features(
        flatten_qa(nested), max_length=256, stride=32, keep=["answer", "answer_start", "answer_end"], answer_cols=("answer_start", "answer_end")))
    return f.select("id", "answer", *[
        F.col(c).cast("bigint").alias(c) for c in ["window_no", "n_ctx", "start_position", "end_position"]])


def q_span_from_logits(spark: SparkSession, sf: str) -> DataFrame:
    """Model output at rest, decoded with 512/128 and 20/100 (D3, D4): the documents that have a vector are
    windowed once; features and logits are tables bucketed by (id, window_no), joined without an exchange."""
    ex = views.doc_examples(spark, sf)
    feats = span_plan.at_rest(span_plan.decode_features(ex.join(views.vector_ids(spark, sf), "id", "left_semi"), 512, 128), "features")
    logits = span_plan.at_rest(views.logits_of(spark, sf, feats.select("id", "window_no", "seq_len")), "logits")
    b = decode.best_span(ex, decode.attach_logits(feats.hint("merge"), logits), 20, 100)
    return b.select(
        F.col("id").cast("bigint").alias("id"), "prediction_text", F.col("start_char").cast("bigint").alias("start_char"),
        F.col("end_char").cast("bigint").alias("end_char"), _round(F.col("score"), 5).alias("score"))


def q_shared_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Four questions about every document: each different text is tokenised once, windows are cut once per
    question length, and labelled (G1, G3, G6)."""
    ex = views.asked_documents(spark, sf).withColumn("ctx_key", contexts.context_key())
    docs = views.table(spark, sf, "documents").select(F.col("text").alias("context"))
    f = windows.align_span(contexts.shared_window_features(
        ex, contexts.distinct_contexts(docs), max_length=256, stride=64, keep=["answer_start", "answer_end"]))
    return f.select("id", *[F.col(c).cast("bigint").alias(c) for c in
                            ["window_no", "q_len", "ctx_first", "n_ctx", "seq_len", "ctx_start", "ctx_end", "start_position", "end_position"]])


def q_subword_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as sub-word ids and back (G1, G11), with the tokens' last offset and the gaps between them."""
    v = subwords.public_vocabulary()
    docs = views.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    enc = docs.select("doc_id", subwords.subword_array(spark, v)("text").alias("t"))
    gaps = F.size(F.filter(F.zip_with("t.end", F.slice("t.start", F.lit(2), F.size("t")), lambda a, b: a < b), lambda g: g))
    return enc.select("doc_id", subwords.decode_ids(spark, v)(subwords.ids_of("t")).alias("text"),
                      F.coalesce(F.array_max("t.end"), F.lit(0)).cast("bigint").alias("n_chars"), gaps.cast("bigint").alias("n_gaps"))


def q_subword_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 512 sub-words with a stride of 128 over every document (G1, G3): each document is covered from its
    first to its last character, the text of each window is the document's between its offsets."""
    docs = views.doc_examples(spark, sf)
    f = windows.window_features(docs, 512, 128, question_col=None, keep=["context"], tokens=subwords.subword_array(spark, subwords.public_vocabulary()))
    same = F.substring("context", F.col("ctx_start") + 1, F.col("ctx_end") - F.col("ctx_start")) == F.col("ctx_text")
    return f.groupBy("id").agg(
        F.min("ctx_start").cast("bigint").alias("first_char"), F.max("ctx_end").cast("bigint").alias("last_char"),
        F.sum(F.when(~same, 1).otherwise(0)).cast("bigint").alias("n_other"),
        (F.max("window_no") + 1 - F.count(F.lit(1))).cast("bigint").alias("n_missing"))


def q_json_variant(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of varying shape (A1): by doc_id modulo 4 as they are, without answers, with unknown fields and the
    answer start as text, or cut off. Each example is one line, read back as VARIANT."""
    from spanlake.session import shared_dir
    from spanlake.sources import files

    ex = views.qa_examples(spark, sf)
    shape = F.pmod(F.col("doc_id"), F.lit(4))

    def doc(answers, **more):
        qa = F.struct("question", "id", *([answers.alias("answers")] if answers is not None else []), *[F.lit(v).alias(k) for k, v in more.items()])
        para = F.struct("context", F.array(qa).alias("qas"))
        return F.to_json(F.struct(F.array(F.struct(F.array(para).alias("paragraphs"))).alias("data"), *[F.lit(v).alias(k) for k, v in more.items()]))

    whole = doc(F.array(F.struct(F.col("answer").alias("text"), "answer_start")))
    odd = doc(F.array(F.struct(F.col("answer").alias("text"), F.col("answer_start").cast("string").alias("answer_start"))), version="1.1", note="x")
    line = F.when(shape == 0, whole).when(shape == 1, doc(None)).when(shape == 2, odd).otherwise(F.substring(whole, F.lit(1), F.length(whole) - 9))
    path = shared_dir(spark, "varying-json")
    ex.select(line.alias("value")).write.text(path)
    back = files.read_qa_variant(spark, path, multi_line=False)
    return back.select("question", "answer", F.col("answer_start").cast("bigint").alias("answer_start"), F.col("answer_end").cast("bigint").alias("answer_end"), "context", "id", "problem")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flatten_qa": q_flatten_qa,
    "squad_em_f1": q_squad_em_f1,
    "drop_all_duplicates": q_drop_all_duplicates,
    "drop_all_duplicate_pairs": q_drop_all_duplicate_pairs,
    "shuffle_rank": q_shuffle_rank,
    "sample_exact": q_sample_exact,
    "train_val_split": q_train_val_split,
    "tokenize_offsets": q_tokenize_offsets,
    "sliding_windows": q_sliding_windows,
    "align_span": q_align_span,
    "top_n_indices": q_top_n_indices,
    "best_span": q_best_span,
    "sentence_bleu": q_sentence_bleu,
    "sacre_bleu": q_sacre_bleu,
    "corpus_bleu": q_corpus_bleu,
    "rouge_1": _rouge_q(1),
    "rouge_2": _rouge_q(2),
    "rouge_l": q_rouge_l,
    "leaderboard": q_leaderboard,
    "build_vocab": q_build_vocab,
    "encode_pairs": q_encode_pairs,
    "batch_pad": q_batch_pad,
    "decode_text": q_decode_text,
    "lexical_score": q_lexical_score,
    "span_end_to_end": q_span_end_to_end,
    "pair_end_to_end": _pair_task("nearest"),
    "pair_echo": _pair_task("echo"),
    "stream_tokenize": q_stream_tokenize,
    "csv_round_trip": q_csv_round_trip,
    "json_round_trip": q_json_round_trip,
    "tsv_round_trip": q_tsv_round_trip,
    "split_counts": q_split_counts,
    "features_per_example": q_features_per_example,
    "token_span_text": q_token_span_text,
    "window_edge_cases": q_window_edge_cases,
    "evaluate_missing": q_evaluate_missing,
    "rouge_report": q_rouge_report,
    "row_ids": q_row_ids,
    "pair_references": q_pair_references,
    "load_splits": q_load_splits,
    "map_batches": q_map_batches,
    "unanswerable_labels": q_unanswerable_labels,
    "span_from_logits": q_span_from_logits,
    "shared_contexts": q_shared_contexts,
    "subword_round_trip": q_subword_round_trip,
    "subword_windows": q_subword_windows,
    "json_variant": q_json_variant,
}
FLAGSHIP = "span_end_to_end"
