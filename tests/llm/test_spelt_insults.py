"""Insults that are spelt to slip through, scored by the query's own way of training."""

import numpy as np

from spanlake.llm import toxicity
from test_models import DOC, made_up_words, planted


def test_variants_are_near_and_bounded():
    got = toxicity.variants("loser", "xq")
    assert {"lqoser", "loxser", "l.o.s.e.r", "lo**ser", "l*ser", "l053r", "looser"} <= set(got)
    assert "loser" not in got and all(len(v) <= toxicity.MAX_UNIT for v in toxicity.variants("a" * 30, "x"))


def test_runs_also_without_their_ends():
    assert {"aword", "word", "awor", "wor"} <= toxicity.raw_units("such a w o r d")
    assert toxicity.raw_units("x y z") == {"x", "y", "z", "xyz"}


def test_spelt_forms_are_predicted_and_clean_texts_left_alone(spark):
    docs, labels = planted(900)
    model = toxicity.train(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, toxic int"))
    insults = ["vilegit", "scumbag", "zwabber", "krutpim"]
    forms = {
        "plain": lambda w: w, "dots": ".".join, "stars": lambda w: w[:3] + "**" + w[3:], "spaced": " ".join, "doubled": lambda w: w[:3] + w[2] + w[3:],
        "inserted": lambda w: w[:4] + "h" + w[4:],
    }
    caught = {n: np.mean(model.score(model.margins([f"you are a {f(w)} now" for w in insults])) >= 0.5) for n, f in forms.items()}
    assert all(caught[n] == 1 for n in ("plain", "dots", "stars", "spaced")) and caught["doubled"] >= 0.75 and caught["inserted"] >= 0.5, caught
    clean = [" ".join(np.random.default_rng(i).choice(made_up_words(800, 4), 30)) for i in range(200)]
    assert (model.score(model.margins(clean)) >= 0.5).mean() <= 0.02


def test_score_place():
    margin, label = np.array([-1.0, 0.0, 0.0, 1.0, 1.2]), np.array([0, 0, 0, 1, 1.0])
    cut = lambda spelt: (lambda s, o: -o / s)(*toxicity.fit_score(margin, label, spelt))
    assert np.isclose(cut(None), 0.4) and np.isclose(cut(np.array([0.5] * 20)), 0.2) and np.isclose(cut(np.array([-0.5] * 20)), 0.4)
