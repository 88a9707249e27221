import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

import pyref
from spanlake.functions import text as T
from spanlake.functions.arrow_helpers import CUT_BYTES, WS_CHARS, text_to_tokens
from spanlake.operators.tokens import token_array, tokenize_offsets

ALPHABET = list("abcXYZ éüñ😀,.;!?-'\"\t\n  _0123456789") + ["the", "a", "an", "The"]


def _random_texts(n, seed=7, max_len=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, max_len))) for _ in range(n)]


def test_ws_chars_match_class():
    import re

    # the Arrow-side whitespace set and the regex class describe the same characters
    assert all(ch.isspace() for ch in WS_CHARS)
    assert " " in WS_CHARS and "　" in WS_CHARS and "\x0b" in WS_CHARS


def test_strip_split_and_normalize(spark):
    texts = _random_texts(300)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    rows = df.select(
        "i",
        T.strip_text("s").alias("st"),
        T.ws_split("s").alias("sp"),
        T.squad_normalize("s").alias("n"),
        T.tokens_13a("s").alias("t13"),
        T.rouge_tokens("s").alias("rt"),
    ).collect()
    for r in rows:
        s = texts[r.i]
        assert r.st == s.strip()
        assert list(r.sp) == s.split()
        assert r.n == pyref.squad_normalize(s)
        assert list(r.t13) == pyref.tok13a(s)
        assert list(r.rt) == pyref.rouge_tokens(s)


def test_question_strip_keeps_inner_whitespace(spark):
    df = spark.createDataFrame([("\t What is it?  ",)], "q string")
    assert df.select(T.strip_text("q")).first()[0] == "What is it?"


def test_token_offsets_property(spark):
    texts = _random_texts(300, seed=11, max_len=60) + ["", "Café 😀 naïve", "áb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = tokenize_offsets(df, "id", "text").collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        toks = sorted(by_id.get(i, []), key=lambda r: r.pos)
        # every token is the text between its offsets, offsets rise, gaps are whitespace
        prev_end = 0
        for k, r in enumerate(toks):
            assert r.pos == k
            assert t[r.start:r.end] == r.tok
            assert r.start >= prev_end
            assert t[prev_end:r.start].strip() == ""
            prev_end = r.end
        assert t[prev_end:].strip() == ""


def test_token_array_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",)], "text string")
    out = [r[0] for r in df.select(token_array("text")).collect()]
    assert out[0] is None
    assert list(out[1]) == [] and list(out[2]) == []


def test_token_offsets_arbitrary_unicode(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    text = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=80)

    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(text, min_size=20, max_size=60))
    def check(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
        rows = tokenize_offsets(df, "id", "text").collect()
        by_id = {}
        for r in rows:
            by_id.setdefault(r.id, []).append(r)
        for i, t in enumerate(texts):
            prev = 0
            for r in sorted(by_id.get(i, []), key=lambda r: r.pos):
                assert t[r.start:r.end] == r.tok and r.start >= prev
                assert t[prev:r.start].strip() == ""
                prev = r.end
            assert t[prev:].strip() == ""

    check()


def test_tokens_leave_in_bounded_pieces(spark):
    """A batch's tokens are several times its texts: they leave the worker in pieces, whatever the batch holds."""
    texts = ["", *_random_texts(200), None, *["naïve café, 漢字 " * 9000] * 20, "x y " * CUT_BYTES, None, "", "end.", None]
    got = list(text_to_tokens.func(iter([pa.array(texts).slice(1), pa.array([None, "a b"])])))
    assert len(got) > 5 and sorted(len(p.flatten()) for p in got)[-2] <= CUT_BYTES
    want = [None if t is None else [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", t)] for t in [*texts[1:], None, "a b"]]
    found = [x for p in got for x in p]
    assert len(found) == len(want)
    for x, w in zip(found, want):
        assert x.is_valid == (w is not None)
        if w is not None:
            t = x.values
            assert list(zip(*(t.field(c).to_pylist() for c in ("tok", "start", "end")))) == w
    # two tokenised columns of one row, read beside each other
    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(texts) if t is not None and len(t) < 10**6], "id int, a string, b string").coalesce(1)
    n = df.select("id", F.size(text_to_tokens("a")).alias("a"), F.size(text_to_tokens("b")).alias("b")).collect()
    assert len(n) > 200 and all(r.a == len(want[r.id - 1] if r.id else []) == r.b for r in n)
