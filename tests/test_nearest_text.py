"""The nearest training text against a comparison with every training text."""

import math
import random
import re
from collections import Counter

from spanlake.operators import nearest_text
from spanlake.plans import pairs as pair_plan
from spanlake.plans.catalog import QUERIES
from conftest import SF_SMALL


def terms(t):
    return set(re.findall(r"\w+|[^\w\s]", (t or "").lower()))


def full(queries, train):
    df = Counter(x for _, t, _ in train for x in terms(t))
    n = sum(bool(terms(t)) for _, t, _ in train)
    w = {x: math.floor((math.log((n + 1) / (c + 1)) + 1) * 1000 + 0.5) for x, c in df.items()}
    out = {}
    for k, t in queries:
        found = [(-sum(w[x] for x in terms(t) & terms(u)), d, s) for d, u, s in train if terms(t) & terms(u)]
        best = min(found) if found else None
        out[k] = (best[1], -best[0], best[2]) if best else (None, None, None)
    return out


def search(spark, queries, train):
    q = spark.createDataFrame(queries, "pair_id string, Query string")
    t = spark.createDataFrame(train, "pair_id string, Query string, Segment string")
    rows = nearest_text.nearest_text(q, t).collect()
    assert len(rows) == len(queries)
    return {r.pair_id: (r.match, r.score, r.Segment) for r in rows}


def test_equals_the_full_comparison(spark):
    rng = random.Random(4)
    common, rare = ["the", "of", "and", "is"], [f"w{i}" for i in range(120)]
    text = lambda: " ".join(rng.choices(common, k=rng.randint(0, 4)) + rng.choices(rare, k=rng.randint(0, 3)))
    train = [(f"t{i:03}", text(), f"answer {i}") for i in range(250)] + [(f"u{i:03}", "the same the", f"copy {i}") for i in range(200)]
    train += [("x1", None, "none"), ("x2", "", "empty"), ("x3", "Only, ONCE!", "once")]
    queries = [(f"q{i:03}", text()) for i in range(150)] + [("n1", None), ("n2", "unseen tokens"), ("n3", "the"), ("n4", "once only"), ("n5", "same THE"), ("n6", "the the the of")]
    assert search(spark, queries, train) == full(queries, train)


def test_empty_sides(spark):
    assert search(spark, [("a", "x")], []) == {"a": (None, None, None)}
    q = spark.createDataFrame([], "pair_id string, Query string")
    t = spark.createDataFrame([("a", "x", "y")], "pair_id string, Query string, Segment string")
    assert nearest_text.nearest_text(q, t).count() == 0


def test_frequent_tokens_are_not_opened():
    """One rare token decides: the posting list of the token that all texts have is never read."""
    texts = [["all", f"r{i}", f"s{i}"] for i in range(60)]
    opened = []
    got = nearest_text.best_in_block([([f"r{i}", f"s{i}", "all"], [4000, 4000, 1000]) for i in range(60)], texts, opened)
    assert got == [(9000, i) for i in range(60)] and opened == [1] * 120


def test_small_blocks(spark, monkeypatch):
    train = [(f"t{i:02}", f"a b{i % 7} c{i % 5} d{i}", f"s{i}") for i in range(80)]
    queries = [(f"q{i}", f"a b{i % 7} c{i % 3} x") for i in range(30)]
    q = spark.createDataFrame(queries, "pair_id string, Query string")
    t = spark.createDataFrame(train, "pair_id string, Query string, Segment string")
    rows = nearest_text.nearest_text(q, t, query_block=7, text_block=9).collect()
    assert {r.pair_id: (r.match, r.score, r.Segment) for r in rows} == full(queries, train)


def test_pair_task_predicts_from_training_data(spark):
    rows = QUERIES["pair_end_to_end"](spark, SF_SMALL).collect()
    assert rows and all(r.prediction_text for r in rows) and 0 < sum(r.f1 for r in rows) / len(rows) < 1


def test_unknown_generator(spark):
    import pytest

    with pytest.raises(ValueError):
        pair_plan.run_pair_task(spark.range(30).selectExpr("concat('p', id) AS pair_id", "concat('q', id) AS Query", "concat('s', id) AS Segment"), k_val=None, generator="none")
