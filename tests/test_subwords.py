"""Sub-words: ids and offsets of the vocabulary's own library, round trips, windows."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlake.functions import subwords
from spanlake.operators import windows

ODD = ["", " ", "plain words, and 3 numbers.", "  two  spaces\n\nand\tlines ", "é́ 漢字 \U0001f642\u200d\U0001f642 ß½", "don't we're I'll", "a" * 3000, " " * 500 + "x", "\x00\x7f end",
       "<|endoftext|> inside <|endof", "naïve café" * 40]


@pytest.fixture(scope="module")
def vocabulary():
    return subwords.public_vocabulary()


def test_ids_and_offsets_equal_the_library(vocabulary):
    v, lib = subwords.vocabulary(vocabulary), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ODD:
        want = lib.encode(t, add_special_tokens=False)
        ids = v.encode(t)
        start, end = v.offsets(t, ids)
        assert ids.tolist() == want.ids
        assert [v.names[i].as_py() for i in ids.tolist()] == want.tokens
        assert list(zip(start.tolist(), end.tolist())) == want.offsets, t
        assert v.decode(ids.tolist()) == t


def test_columns(spark, vocabulary):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "id int, text string").repartition(3)
    enc = df.select("id", subwords.subword_array(spark, vocabulary)("text").alias("t"))
    back = {r.id: r.text for r in enc.select("id", subwords.decode_ids(spark, vocabulary)(subwords.ids_of("t")).alias("text")).collect()}
    assert back == dict(enumerate([*ODD, None]))
    odd = spark.createDataFrame([([464, -1, 99_999_999, None],), (None,), ([],), ([226],)], "ids array<int>")
    assert [r[0] for r in odd.select(subwords.decode_ids(spark, vocabulary)("ids")).collect()] == ["The", None, "", "\ufffd"]


def test_windows_of_subwords(spark, vocabulary):
    text = "Unbelievably longwinded contexts, again and again. " * 30
    ex = spark.createDataFrame([("a", "who's there?", text, 13, 23)], "id string, question string, context string, answer_start int, answer_end int")
    f = windows.align_span(windows.window_features(ex, 64, 16, keep=["answer_start", "answer_end"], answer_cols=("answer_start", "answer_end"),
                                                   tokens=subwords.subword_array(spark, vocabulary)))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    q, c = (lib.encode(x, add_special_tokens=False) for x in ("who's there?", text))
    cap, rows = 64 - 3 - len(q.ids), sorted(f.collect(), key=lambda r: r.window_no)
    for r in rows:
        lo = r.window_no * (cap - 16)
        assert r.tokens[: r.seq_len] == ["[CLS]", *q.tokens, "[SEP]", *c.tokens[lo : lo + cap], "[SEP]"]
        assert [tuple(o) for o in r.offsets if o] == c.offsets[lo : lo + cap]
    first = rows[0]
    assert text[first.offsets[first.start_position].start : first.offsets[first.end_position].end].strip() == text[13:23].strip()
    assert len(rows) == -(-(len(c.ids) - cap) // (cap - 16)) + 1


def test_encoding_hands_back_bounded_pieces(spark, vocabulary):
    """A batch's tokens are many times its texts: they leave the worker in pieces, whatever the batch holds."""
    v, lib = subwords.vocabulary(vocabulary), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = ["", *ODD, None, "plain words and 3 numbers. " * 2000, None, *["naïve café " * 3000] * 60, "one long text " * 100_000, "end", None]
    got = list(v.token_pieces(pa.array(rows).slice(1)))
    assert len(got) > 3 and max(len(p.flatten()) for p in got[:-2]) <= 1 << 20
    assert [x for p in got for x in (None if t is None else [y["id"] for y in t] for t in p.to_pylist())] == [None if t is None else lib.encode(t, add_special_tokens=False).ids for t in rows[1:]]
    assert list(v.token_pieces(pa.array([None, ""]))) == [pa.array([None, []], got[0].type)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, text string").coalesce(1)
    n = {r.id: r.n for r in df.select("id", F.size(subwords.subword_array(spark, vocabulary)("text")).alias("n")).collect()}
    assert [n[i] for i in range(1, len(rows))] == [len(x) if x.is_valid else None for p in got for x in p]


def test_decoding_hands_back_bounded_pieces(vocabulary):
    v = subwords.vocabulary(vocabulary)
    rows = [[464, -1, None, 99_999_999], None, [], [226], *[v.encode("naïve café, 漢字 " * 5000).tolist()] * 9, [464] * 700_000, [], None]
    got = list(v.decoded_pieces(pa.array(rows, pa.list_(pa.int32()))))
    assert len(got) > 3
    assert [x for p in got for x in p.to_pylist()] == [None if r is None else v.decode(i for i in r if i is not None) for r in rows]
    assert [p.to_pylist() for p in v.decoded_pieces(pa.array([[], None], pa.list_(pa.int32())))] == [["", None]]
