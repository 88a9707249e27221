import random

import pytest
from pyspark.sql import functions as F

import pyref
from spanlake.operators import decode, windows


def _examples(spark, rows):
    return spark.createDataFrame(
        rows, "id string, question string, context string, answer_start int, answer_end int"
    )


def _ctx(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 25, 40])
def test_window_counts_and_coverage(spark, n):
    max_length, stride, n_special = 16, 3, 3
    q = "q1 q2 q3"  # 3 question tokens -> cap = 16 - 3 - 3 = 10
    ex = _examples(spark, [("e", q, _ctx(n), None, None)])
    f = windows.window_features(ex, max_length, stride, n_special, keep=["answer_start", "answer_end"])
    rows = sorted(f.collect(), key=lambda r: r.window_no)
    want = pyref.windows(n, 10, stride)
    assert [(r.ctx_first, r.ctx_first + r.n_ctx) for r in rows] == want
    covered = set()
    for r in rows:
        assert len(r.tokens) == max_length
        assert r.seq_len == 3 + n_special + r.n_ctx
        ctx_toks = [t for t, s in zip(r.tokens, r.seq_ids) if s == 1]
        assert ctx_toks == [f"w{i}" for i in range(r.ctx_first, r.ctx_first + r.n_ctx)]
        covered.update(range(r.ctx_first, r.ctx_first + r.n_ctx))
        masked = [o for o, s in zip(r.offsets, r.seq_ids) if s != 1]
        assert all(o is None for o in masked)
        ctx_idx = [k for k, s in enumerate(r.seq_ids) if s == 1]
        if ctx_idx:
            assert (r.ctx_index_first, r.ctx_index_last) == (ctx_idx[0], ctx_idx[-1])
    assert covered == set(range(n))


def test_align_span_edges(spark):
    ctx = _ctx(25)  # tokens w0..w24, windows of 10 with step 7
    def span(i, j):
        s = ctx.index(f"w{i} ") if i < 24 else ctx.rindex("w24")
        e = ctx.index(f"w{j}") + len(f"w{j}")
        return s, e
    cases = {
        "first": span(0, 0), "last": span(24, 24), "edge": span(8, 11), "none": (None, None),
    }
    ex = _examples(spark, [(k, "q", ctx, s, e) for k, (s, e) in cases.items()])
    f = windows.align_span(windows.window_features(ex, 14, 3, 3, keep=["answer_start", "answer_end"]))
    got = {(r.id, r.window_no): (r.start_position, r.end_position) for r in f.collect()}
    off = 1 + 3 - 1  # q_len + n_special - 1
    assert got[("first", 0)] == (off + 0, off + 0)
    assert got[("none", 0)] == (0, 0)
    # the answer spanning w8..w11 is whole only in window 1 (tokens 7..16)
    assert got[("edge", 0)] == (0, 0)
    assert got[("edge", 1)] == (off + 1, off + 4)
    last_w = max(w for (i, w) in got if i == "last")
    s, e = got[("last", last_w)]
    assert (s, e) != (0, 0) and s == e
    # labelled spans contain the answer text
    for r in f.collect():
        if r.start_position:
            toks = r.tokens[r.start_position: r.end_position + 1]
            assert " ".join(toks) in ctx


def test_label_paths_agree(spark):
    rnd = random.Random(2)
    ctx = _ctx(60)
    rows = []
    for i in range(40):
        a = rnd.randint(0, 59)
        b = min(59, a + rnd.randint(0, 6))
        s = ctx.index(f"w{a}") if a else 0
        s = len(" ".join(f"w{k}" for k in range(a))) + (1 if a else 0)
        e = len(" ".join(f"w{k}" for k in range(b + 1)))
        rows.append((f"e{i}", "q x", ctx, s, e))
    ex = _examples(spark, rows)
    kw = dict(max_length=20, stride=5, n_special=3, keep=["answer_start", "answer_end"])
    fast = windows.align_span(windows.window_features(ex, answer_cols=("answer_start", "answer_end"), **kw))
    slow = windows.align_span(windows.window_features(ex, **kw))
    cols = ["id", "window_no", "start_position", "end_position"]
    assert sorted(map(tuple, fast.select(cols).collect())) == sorted(map(tuple, slow.select(cols).collect()))
    for r in fast.collect():
        if r.start_position:
            assert r.tokens[r.start_position] == f"w{ctx[:r.answer_start].count(' ')}"


def test_mask_offsets_function(spark):
    from spanlake.functions.arrays import mask_offsets

    df = spark.createDataFrame(
        [([("a", 0, 1, None), ("b", 0, 1, 0), ("c", 2, 3, 1)],)],
        "t array<struct<tok:string,start:int,end:int,seg:int>>",
    )
    got = df.select(mask_offsets("t")).first()[0]
    assert got[0] is None and got[1] is None and (got[2].start, got[2].end) == (2, 3)


def test_no_example_is_lost(spark):
    ex = _examples(spark, [("long", " ".join(["q"] * 20), "a b c", None, None), ("ok", "q", "a b c", None, None),
                           ("no-q", None, "a b c", None, None), ("no-c", "q", None, None, None), ("none", None, None, None, None)])
    f = windows.window_features(ex, 16, 3, 3)
    got = {r.id: (r.too_long, r.window_no, r.q_len, r.n_ctx) for r in f.collect()}
    assert got == {"long": (True, 0, 20, 0), "ok": (False, 0, 1, 3), "no-q": (False, 0, 0, 3), "no-c": (False, 0, 1, 0), "none": (False, 0, 0, 0)}


def test_blocks_of_windows_equal_all_windows(spark):
    words = [f"w{i}" for i in range(500)]
    ex = _examples(spark, [("a", " ".join(["q"] * 9), " ".join(words), None, None)])
    f = windows.window_features(ex, 16, 3, 3).orderBy("window_no").collect()  # capacity 4, step 1
    assert [r.window_no for r in f] == list(range(497))
    for r in f:
        assert r.ctx_text == " ".join(words[r.ctx_first : r.ctx_first + 4]) and r.n_ctx == 4
        assert [t.tok for t in r._w] == words[r.ctx_first : r.ctx_first + 4]


def test_best_span_against_reference_loop(spark):
    rnd = random.Random(4)
    ctx = " ".join(f"t{i}" for i in range(30))
    ex = _examples(spark, [("a", "", ctx, None, None), ("b", "", ctx, None, None), ("c", "", "", None, None)])
    feats = windows.window_features(ex, 16, 4, 3, question_col=None)
    rows = feats.collect()
    logit_rows, per_ex = [], {}
    for r in rows:
        # ties on purpose: values from a small set
        sl = [float(rnd.choice([-1.0, 0.5, 1.0, 2.0])) for _ in range(16)]
        el = [float(rnd.choice([-1.0, 0.5, 1.0, 2.0])) for _ in range(16)]
        if r.id == "c":
            continue  # an example without logits -> empty prediction
        logit_rows.append((r.id, r.window_no, sl, el))
        off = [None if o is None else (o.start, o.end) for o in r.offsets]
        per_ex.setdefault(r.id, []).append((r.window_no, sl, el, off))
    logits = spark.createDataFrame(logit_rows, "id string, window_no int, start_logits array<float>, end_logits array<float>")
    fl = decode.attach_logits(feats, logits)
    got = {r.id: r.prediction_text for r in decode.best_span(ex, fl, n_best=5, max_answer_length=4).collect()}
    for k, ws in per_ex.items():
        ws = [w[1:] for w in sorted(ws)]
        assert got[k] == pyref.best_span_loop(ws, 5, 4, ctx)
    assert got["c"] == ""


def test_small_operators(spark):
    import pandas as pd

    from spanlake.functions.arrays import pad_array, skip_specials, token_span, truncate_array
    from spanlake.functions.text import span_text
    from spanlake.operators.scoring import map_batches

    df = spark.createDataFrame([("Café au lait", ["[CLS]", "a", "b", "[SEP]", "c"])], "c string, t array<string>")
    r = df.select(
        span_text("c", F.lit(5), F.lit(7)).alias("s"),
        token_span("t", F.lit(1), F.lit(2)).alias("ts"),
        skip_specials("t", ["[CLS]", "[SEP]"]).alias("sk"),
        pad_array(truncate_array("t", 2), 4, "[PAD]").alias("pd"),
    ).first()
    assert r.s == "au" and r.ts == "a b" and list(r.sk) == ["a", "b", "c"]
    assert list(r.pd) == ["[CLS]", "a", "[PAD]", "[PAD]"]

    def one_to_two(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pdf, pdf]).assign(n=lambda x: x["id"] * 10)

    out = map_batches(spark.range(3), one_to_two, "id long, n long")
    assert sorted(r.n for r in out.collect()) == [0, 0, 10, 10, 20, 20]

    feats = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "id string, window_no int")
    g = {r.id: [w.window_no for w in r.windows] for r in decode.group_features(feats).collect()}
    assert g == {"a": [0, 1], "b": [0]}
