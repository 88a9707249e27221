from collections import Counter

from pyspark.sql import functions as F

from spanlake.operators import encode, scoring
from spanlake.plans.pairs import echo_query_scorer, _GEN_SCHEMA


def _pairs(spark):
    return spark.createDataFrame(
        [("p1", "is my chat confidential?", "At Fiverr we care about your privacy."),
         ("p2", "who sees my data", "We share data with partners"),
         ("p3", "a", " ".join(["x"] * 80))],
        "pair_id string, Query string, Segment string",
    )


def test_vocab_order(spark):
    p = _pairs(spark)
    v = {r.tok: (r.cnt, r.id) for r in encode.build_vocab(p, ["Query", "Segment"]).collect()}
    import re
    toks = []
    for r in p.collect():
        for t in (r.Query, r.Segment):
            toks += re.findall(r"\w+|[^\w\s]", t)
    c = Counter(toks)
    order = sorted(c, key=lambda t: (-c[t], t.encode()))
    assert [v[t][1] for t in order] == list(range(4, 4 + len(order)))
    assert all(v[t][0] == c[t] for t in c)


def test_encode_truncate_pad_and_round_trip(spark):
    p = _pairs(spark)
    v = encode.build_vocab(p, ["Query", "Segment"])
    e = {r.pair_id: r for r in encode.encode_pairs(p, v, "pair_id", 16).collect()}
    for r in e.values():
        assert len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 16
        assert r.input_ids[0] == encode.BOS_ID
        n = sum(r.attention_mask)
        assert r.input_ids[n - 1] == encode.EOS_ID and all(x == encode.PAD_ID for x in r.input_ids[n:])
    assert e["p3"].labels[-1] == encode.EOS_ID  # 80 tokens truncated to 14 + 2 specials
    dec = {r.pair_id: r.text for r in encode.decode(encode.encode_pairs(p, v, "pair_id", 64), "pair_id", "labels", v).collect()}
    assert dec["p1"] == "At Fiverr we care about your privacy ."
    unknown = spark.createDataFrame([("u", "zzz", "unseen words")], "pair_id string, Query string, Segment string")
    u = encode.encode_pairs(unknown, v, "pair_id", 8).first()
    assert u.input_ids[1] == encode.UNK_ID


def test_batch_pad_labels(spark):
    p = _pairs(spark)
    v = encode.build_vocab(p, ["Query", "Segment"])
    e = encode.encode_pairs(p, v, "pair_id", None, pad=False)
    b = encode.batch_pad(e, "pair_id", batch_size=2, seed=1).collect()
    for batch in {r.batch for r in b}:
        members = [r for r in b if r.batch == batch]
        L = max(len(r.input_ids) for r in members)
        assert all(len(r.input_ids) == len(r.labels) == L for r in members)
    short = min(b, key=lambda r: r.labels.count(-100) * -1)
    assert -100 in short.labels or all(len(r.labels) == len(r.input_ids) for r in b)


def test_score_contract_runs_factory_per_task(spark):
    p = _pairs(spark)
    v = encode.build_vocab(p, ["Query", "Segment"])
    e = encode.encode_pairs(p, v, "pair_id", 64)
    out = scoring.score(e.select("pair_id", "input_ids"), echo_query_scorer, _GEN_SCHEMA)
    got = {r.pair_id: list(r.pred_ids) for r in out.collect()}
    assert got == {r.pair_id: list(r.input_ids) for r in e.collect()}


def test_scorer_sees_every_row_once(spark):
    p = _pairs(spark)
    v = encode.build_vocab(p, ["Query", "Segment"])
    e = encode.encode_pairs(p, v, "pair_id", 64).cache()
    seen = spark.sparkContext.accumulator(0)

    def counting():
        def run(pdf):
            seen.add(len(pdf))
            return pdf.rename(columns={"input_ids": "pred_ids"})[["pair_id", "pred_ids"]]

        return run

    n = e.count()
    encode.decode(scoring.score(e.select("pair_id", "input_ids"), counting, _GEN_SCHEMA), "pair_id", "pred_ids", v).collect()
    assert seen.value == n


def test_repeated_keys_stay_apart(spark):
    p = spark.createDataFrame([("k", "a b", "c"), ("k", "d", "e f"), ("k", "", "")], "pair_id string, Query string, Segment string")
    v = encode.build_vocab(p, ["Query", "Segment"])
    e = encode.encode_pairs(p, v, "pair_id", 8)
    back = encode.decode(e, "pair_id", "input_ids", v).collect()
    assert sorted(r.text for r in back) == ["", "a b", "d"]
