import random

import pytest
from pyspark.sql import functions as F

import pyref
from spanlake.functions.bags import bag_overlap, counted
from spanlake.functions.text import squad_normalize
from spanlake.operators.metrics import bleu, registry, rouge, squad

WORDS = ["the", "cat", "sat", "on", "a", "mat", "Cat,", "mat.", "3.5", "x-1", "an", "dog", "&amp;", "é"]


def _pairs(n, seed=3):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        ref = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12)))
        if rnd.random() < 0.3:
            pred = ref
        else:
            pred = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12)))
        out.append((pred, ref))
    return out


def test_bag_overlap_matches_counter(spark):
    from collections import Counter

    rnd = random.Random(5)
    data = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))],
             [rnd.choice("abce") for _ in range(rnd.randint(0, 9))]) for _ in range(200)]
    df = spark.createDataFrame(data, "p array<string>, g array<string>")
    got = [r[0] for r in df.select(bag_overlap("p", "g")).collect()]
    want = [sum((Counter(p) & Counter(g)).values()) for p, g in data]
    assert got == want
    runs = df.select(counted("p")).collect()
    for (p, _), r in zip(data, runs):
        assert {x.v: x.c for x in r[0]} == dict(Counter(p))


def test_squad_bleu_rouge_against_python(spark):
    data = _pairs(250)
    df = spark.createDataFrame(
        [(str(i), p, r) for i, (p, r) in enumerate(data)], "id string, prediction_text string, ref string"
    ).withColumn("answers", F.struct(F.array("ref").alias("text")))
    rows = squad.squad_rows(df)
    rows = bleu.with_bleu(rows.withColumn("refs", F.array("ref")), refs="refs", out="bleu")
    rows = bleu.with_bleu(rows, refs="refs", out="sacre", sacre=True)
    rows = rouge.with_rouge(rows, ref="ref")
    for r in rows.collect():
        p, g = data[int(r.id)]
        assert r.em == pyref.squad_em(p, g)
        assert r.f1 == pytest.approx(pyref.squad_f1(p, g), abs=1e-12)
        assert r.bleu == pytest.approx(pyref.sentence_bleu(p, [g]), abs=1e-9)
        assert r.sacre == pytest.approx(pyref.sacre_bleu(p, [g]), abs=1e-9)
        for key, fn in (("rouge1", lambda a, b: pyref.rouge_n(a, b, 1)),
                        ("rouge2", lambda a, b: pyref.rouge_n(a, b, 2)),
                        ("rougeL", pyref.rouge_l)):
            want = fn(p, g)
            got = r[key]
            assert (got.precision, got.recall, got.fmeasure) == pytest.approx(want, abs=1e-12)


def test_special_cases(spark):
    df = spark.createDataFrame(
        [
            ("1", "a b c", ["a b c"]),          # 3-token exact match: EM 1, BLEU 0
            ("2", "", ["x"]),                    # empty prediction
            ("3", "the", ["a"]),                 # articles only: both normalise to ''
            ("4", "red car", ["blue car", "red car"]),  # two gold answers: max
        ],
        "id string, prediction_text string, golds array<string>",
    )
    rows = squad.squad_rows(df, gold_col="golds")
    rows = bleu.with_bleu(rows, refs="golds", out="bleu")
    got = {r.id: r for r in rows.collect()}
    assert got["1"].em == 1.0 and got["1"].bleu == 0.0
    assert got["2"].em == 0.0 and got["2"].f1 == 0.0
    assert got["3"].em == 1.0 and got["3"].f1 == 0.0
    assert got["4"].em == 1.0 and got["4"].f1 == 1.0
    assert got["4"].bleu == pytest.approx(pyref.sentence_bleu("red car", ["blue car", "red car"]))


def test_multi_reference_bleu(spark):
    refs = ["the cat is on the mat", "there is a cat on the mat"]
    pred = "the cat the cat is on the mat"
    df = spark.createDataFrame([(pred, refs)], "prediction_text string, refs array<string>")
    got = bleu.with_bleu(df, refs="refs").first().bleu
    assert got == pytest.approx(pyref.sentence_bleu(pred, refs), abs=1e-12)


def test_corpus_bleu_and_evaluate(spark):
    data = _pairs(60, seed=9)
    df = spark.createDataFrame(
        [(str(i), p, r) for i, (p, r) in enumerate(data)], "id string, prediction_text string, ref string"
    ).withColumn("refs", F.array("ref"))
    rows = bleu.with_bleu(df, refs="refs", out="bleu")
    got = bleu.corpus_bleu(rows, "bleu_stats").first()[0]
    tot = [[0] * 4, [0] * 4, 0, 0]
    for p, r in data:
        num, den, pl, rl = pyref.bleu_stats(p.split(), [r.split()])
        tot[0] = [a + b for a, b in zip(tot[0], num)]
        tot[1] = [a + b for a, b in zip(tot[1], den)]
        tot[2] += pl
        tot[3] += rl
    assert got == pytest.approx(pyref.bleu_from(*tot), abs=1e-12)

    refs = df.select("id", F.struct(F.array("ref").alias("text")).alias("answers"))
    preds = df.select("id", "prediction_text").where(F.col("id").cast("int") % 2 == 0)
    ev = registry.evaluate(preds, refs, ("exact_match",)).first()
    # missing predictions count as 0 over all references
    want = sum(pyref.squad_em(p, r) for i, (p, r) in enumerate(data) if i % 2 == 0) / len(data) * 100
    assert ev.exact_match == pytest.approx(want)
    assert ev.n == len(data)


def test_pair_up_and_span_report(spark):
    from spanlake.plans import span as span_plan

    refs = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, answer string")
    preds = spark.createDataFrame([("a", "x")], "id string, prediction_text string")
    paired = {r.id: r.prediction_text for r in squad.pair_up(preds, refs).collect()}
    assert paired == {"a": "x", "b": ""}
    gold = spark.createDataFrame([("a", ["the"]), ("b", ["the"])], "id string, golds array<string>")
    em = {r.id: r.em for r in squad.squad_rows(squad.pair_up(preds.limit(0), gold), gold_col="golds").collect()}
    assert em == {"a": 0.0, "b": 0.0}

    ex = spark.createDataFrame(
        [("e1", "Where is the cat?", "The cat is on the mat. Dogs run.", 0, 22, "The cat is on the mat.")],
        "id string, question string, context string, answer_start int, answer_end int, answer string",
    )
    rep = span_plan.span_report(ex, max_length=32, stride=8).first()
    assert rep.n == 1 and 0.0 <= rep.f1 <= 100.0


def test_squad_normalise_word_edges(spark):
    texts = ["a\u0301 cat", "an² apple", "the_end the", "A\u200dn b", "é a é", "١a a١"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(squad_normalize("t")).collect()]
    assert got == [pyref.squad_normalize(t) for t in texts]


def test_runs_without_matches_and_rouge_only_boards(spark):
    refs = spark.createDataFrame([("a", (["x y"],)), ("b", (["z"],))], "id string, answers struct<text:array<string>>")
    preds = spark.createDataFrame([("r1", "a", "x y"), ("r2", "q", "x y")], "run string, id string, prediction_text string")
    got = {r.run: r.rouge1_fmeasure for r in registry.leaderboard(preds, refs, ("rouge",)).collect()}
    assert got == {"r1": 0.5, "r2": 0.0}
    none = registry.evaluate(preds.limit(0).drop("run"), refs, ("exact_match",)).first()
    assert none.exact_match == 0.0 and none.n == 2
