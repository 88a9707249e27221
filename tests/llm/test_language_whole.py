"""A document's language set does not depend on its batch, and a model holds every trigram."""

from collections import Counter

import numpy as np

from spanlake.llm import language_mix


def test_stop_is_decided_per_document():
    rng = np.random.default_rng(5)
    langs = list("abcde")
    words = ["".join(w) for w in rng.choice(list("klmnopqrst"), (60, 4))]
    code = np.unique(language_mix.trigrams(words)[0])
    n = np.floor(rng.gamma(0.15, 40.0, (len(code), 5)))
    at, lang = np.nonzero(n)
    model = language_mix.Model.of_counts(langs, code[at], lang, n[at, lang])
    bags = [Counter(rng.choice(words, size).tolist()) for size in rng.integers(1, 40, 300)]
    together = language_mix.infer(model, bags)
    for i, b in enumerate(bags):
        lang, score, shares = language_mix.infer(model, [b])
        assert lang[0] == together[0][i]
        assert np.allclose(score[0], together[1][i]) and np.allclose(shares[0], together[2][i])


def test_likelihoods_are_over_all_counts(spark):
    # more than 50,000 distinct trigrams of one language
    text = [" ".join(chr(0x4E00 + i) + chr(0x4E00 + i % 977) + chr(0x4E00 + i % 89) for i in range(lo, lo + 2000)) for lo in range(0, 20_000, 2000)]
    docs = [(i, t, "zh") for i, t in enumerate(text)] + [(100 + i, "plain words here", "en") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learned = [tuple(r) for r in df.where(~language_mix.held_out(df.doc_id)).select("lang", "text").collect()]
    want = {}
    for lang, t in learned:
        code, _ = language_mix.trigrams(language_mix.words_of(t))
        want.setdefault(lang, Counter()).update(code.tolist())
    assert len(want["zh"]) > 50_000 and len(want["en"])
    model = language_mix.train(df)
    assert model.langs == ["en", "zh"] and len(model.codes) == len(set(want["zh"]) | set(want["en"]))
    words = sorted(set(language_mix.words_of(" ".join(t for _, t in learned))))[::1500] + ["unseen"]
    got = model.word_likelihoods(words)
    for w, row in zip(words, got):
        for lang, v in zip(model.langs, row):
            total = sum(want[lang].values()) + 0.5 * (len(model.codes) + 1)
            assert np.isclose(v, sum(np.log((want[lang][c] + 0.5) / total) for c in language_mix.trigrams([w])[0].tolist()))


def test_numerals_are_no_letters(spark):
    assert language_mix.words_of("Ab½c² d3e ⅷ x_y 一二") == ["ab", "c", "d", "e", "x", "y", "一二"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["some words here"] * 12 + ["½", "² ³ ¼!", "½ a"])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_mix.identify(df, language_mix.train(df)).collect()}
    assert (got[12], got[13], got[14]) == ("und", "und", "en")
