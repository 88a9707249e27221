"""Toxicity, language identification and main text: held-out accuracy, brute force, edge cases."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanlake.llm import html_content, language_mix, queries, toxicity

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string"


def in_test_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# --- toxicity -----------------------------------------------------------------------


def kernel(s, t, order=toxicity.ORDER, decay=toxicity.DECAY):
    """The gap-weighted subsequence kernel by listing all subsequences."""

    def phi(x):
        out = Counter()
        for at in itertools.combinations(range(len(x)), order):
            out["".join(x[i] for i in at)] += decay ** (at[-1] - at[0] + 1)
        return out

    a, b = phi(f"\x01{s}\x01"), phi(f"\x01{t}\x01")
    return sum(v * b[k] for k, v in a.items())


def test_feature_map_and_norm_give_the_kernel():
    units = ["idiot", "idi-ot", "i.d.i.o.t", "riot", "abc"]
    vocab = toxicity._all_subsequences(units)
    phi = np.concatenate([toxicity._features([u], vocab) for u in units])
    for i, a in enumerate(units):
        assert np.isclose(toxicity.self_kernel(toxicity._codes([a]))[0], kernel(a, a), rtol=1e-4)
        for j, b in enumerate(units):
            want = kernel(a, b) / np.sqrt(kernel(a, a) * kernel(b, b))
            assert np.isclose(phi[i] @ phi[j], want, rtol=1e-3, atol=1e-5)


def made_up_words(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("aeioutnrslmdkg") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_gapped_and_spaced_insults_score_high():
    insults = ["idiot", "moron", "pathetic", "worthless"]
    model = toxicity.fit_svm(insults, made_up_words(3000))
    clean = model.unit_margins(made_up_words(500, 1))
    for text in ["idi.ot", "m0oron", "i d i o t", "path-etic!", "WORTHLESS", "xx i d i o t yy"]:
        assert model.margins([text])[0] > np.quantile(clean, 0.99), text
    assert model.margins(["riot", None, "", " \n"])[1:].max() == -np.inf


def test_units_cover_whole_texts():
    assert toxicity.pieces("(idiot),") == ["idiot"] and toxicity.pieces("...") == []
    long = "".join(made_up_words(50))
    assert "".join(p[: toxicity.MAX_UNIT // 2] for p in toxicity.pieces(long)).startswith(long[:100])
    assert all(any(long[i : i + 6] in p for p in toxicity.pieces(long)) for i in range(len(long) - 6))


def planted(n=600, seed=4):
    """Documents of made-up words; a third toxic with one of six insults, some only as compounds."""
    rng, words = random.Random(seed), made_up_words(800, seed)
    insults = ["vilegit", "scumbag", "zwabber", "krutpim", "fyxxo", "bwlock"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(insults) + rng.choice(["", "", "er", "ung"]))
        docs.append((i, " ".join(w)))
        labels.append((i, toxic))
    return docs, labels


def test_planted_insults_are_found_and_clean_documents_left_alone(spark):
    docs, labels = planted()
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    got = {r.doc_id: r for r in toxicity.score_documents(d, model).collect()}
    want = dict(labels)
    wrong = [i for i in want if got[i].predicted != want[i]]
    assert len(wrong) <= 3 and all(got[i].held_out == in_test_fold(i) for i in want)
    kept = toxicity.reject_toxic(d.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if not got[i].predicted)


def test_toxicity_edges(spark):
    docs, labels = planted(300)
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame([*labels, *labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "scumbag"), (3, "?!"), (4, "x" * 100_000 + " scumbag")], DOC)
    got = toxicity.score_documents(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    low = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(low) == 1 and all(r.predicted == 1 for r in got if r.doc_id in (None, 4))
    assert toxicity.train(d, lab.where("toxic = 0")) is None and toxicity.train(d, lab.limit(0)) is None
    assert {r.score for r in toxicity.score_documents(odd, None).collect()} == {0.0}
    assert toxicity.score_documents(odd.limit(0), model).count() == 0


def test_op5_held_out_accuracy(spark):
    got = queries.op5_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert all(r.held_out == in_test_fold(r.doc_id) for r in got)
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) >= 0.95


# --- language -----------------------------------------------------------------------


def test_op8_held_out_accuracy(spark):
    got = queries.op8_language_mix(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97


def two_languages():
    a, b = made_up_words(400, 1), ["".join(w).replace("a", "ø").replace("t", "þ").replace("n", "x") for w in made_up_words(400, 2)]
    return a, b


def test_mixtures_and_edges(spark):
    a, b = two_languages()
    rng = random.Random(1)
    say = lambda w, n: " ".join(rng.choice(w) for _ in range(n))
    rows = [(i, say((a, b)[i % 2], 40), ("aa", "bb")[i % 2]) for i in range(200)] + [(900, "zzz", None), (901, None, "aa")]
    docs = spark.createDataFrame(rows, DOC + ", lang string")
    model = language_mix.train(docs)
    assert model.langs == ["aa", "bb"]
    odd = [(1, say(a, 70) + " " + say(b, 30)), (2, say(a, 50)), (3, None), (4, ""), (5, "12 ?!"), (None, say(b, 20)), (6, "q" * 100_000), (6, say(b, 9))]
    got = language_mix.identify(spark.createDataFrame(odd, DOC).withColumn("lang_pred", F.lit("clash")), model).collect()
    by = {(r.doc_id, i): r for i, r in enumerate(got)}
    mixed = by[1, 0]
    assert mixed.lang_pred == "aa" and 0.55 < mixed.score < 0.85 and mixed.langs.count(":") == 2
    assert by[2, 1].lang_pred == "aa" and by[2, 1].langs == "aa:1.00"
    assert [by[k].lang_pred for k in [(3, 2), (4, 3), (5, 4)]] == ["und"] * 3
    assert by[None, 5].lang_pred == "bb" and by[None, 5].held_out and by[6, 7].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got)
    assert language_mix.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language_mix.identify(docs, None).collect()} == {"und"}
    assert language_mix.identify(docs.limit(0), model).count() == 0


def test_expectation_maximisation_against_plain_loops():
    rng = np.random.default_rng(0)
    like, n = rng.random((12, 3)), rng.integers(1, 4, 12).astype(float)
    at, doc = np.array([0, 5]), np.repeat([0, 1], [5, 7])
    got, ll = language_mix._em(like, n, at, doc, np.full((2, 3), 1 / 3), 6)
    for d in range(2):
        pi = np.full(3, 1 / 3)
        for _ in range(6):
            new = np.zeros(3)
            for w in np.flatnonzero(doc == d):
                r = pi * like[w]
                new += n[w] * r / r.sum()
            pi = new / n[doc == d].sum()
        assert np.allclose(got[d], pi)
        assert np.isclose(ll[d], sum(n[w] * np.log((pi * like[w]).sum()) for w in np.flatnonzero(doc == d)))


def test_trigrams():
    code, size = language_mix.trigrams(["ab", "é"])
    assert size.tolist() == [2, 1]
    assert [tuple(int(c) >> s & 0x1FFFFF for s in (42, 21, 0)) for c in code] == [(32, 97, 98), (97, 98, 32), (32, 233, 32)]


# --- main text ----------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>Not &amp; this</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head>
<body><header><h1>Site name</h1></header><nav><ul><li><a href="/a">one</a><li><a href="/b">two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better</div><!-- <p>hidden</p> -->
<article><h1>A&nbsp;title</h1><p>First <b>bold</b>er   paragraph with a fair number of words in it.<br>Next line &lt;ok&gt; &#233;
<aside class="sidebar"><p>Related stories you may also like to read today</p></aside>
<p>Second paragraph goes on and on with plenty of further words.</p><form><input name=q><button>Send</button></form>
<ul><li>point one<li>point two</ul></article>
<section id="comments"><p>reader comment that is not part of the article at all</p></section><footer>&copy; us</footer></body></html>"""
TEXT = ("A title First bolder paragraph with a fair number of words in it. Next line <ok> é "
        "Second paragraph goes on and on with plenty of further words. point one point two")


def test_main_text_of_a_page():
    weights = html_content.weigh({"w": (500, 40), "p": (30, 3), "/p": (30, 3), "article": (0, 9), "/article": (0, 9)})
    assert html_content.main_text(PAGE, weights) == TEXT
    assert html_content.main_text(PAGE, {}) == TEXT
    bare = PAGE.replace("<article>", "<div id=content>").replace("</article>", "</div>")
    assert html_content.main_text(bare, {}) == TEXT.removesuffix(" point one point two")
    for page in (None, "", "<p>", "<", "< b", "<script>never closed <p>x</p>", "<!-- open", "</p></div></html>"):
        assert html_content.main_text(page, weights) in ("", "<", "< b")


def test_region_equals_all_regions():
    rng = random.Random(2)
    weights = {"w": 1.0, "div": -2.5, "p": -0.5, "a": -1.5}
    for _ in range(200):
        toks = [(k, "x " * rng.randrange(4), rng.random() < 0.1, False) if (k := rng.choice(["w", "div", "p", "a", "nav*"])) == "w" else (k, "", False, False) for _ in range(rng.randrange(15))]
        gain = [html_content.region([t], weights) and (0 if t[2] else len(t[1].split())) if t[0] == "w" else max(weights.get(t[0], -3.0), -3.0) for t in toks]
        best = max((sum(gain[i:j]) for i in range(len(toks)) for j in range(i + 1, len(toks) + 1)), default=0)
        lo, hi = html_content.region(toks, weights)
        assert np.isclose(sum(gain[lo:hi]), max(best, 0))


def test_op2_equals_the_article_elements(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op2_main_text(spark, SF).collect()}
    assert len(got) == len(pages)
    for i, page in pages.items():
        inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        inner = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        assert got[i].text == " ".join(html.unescape(inner).split()) and got[i].n_chars == len(got[i].text)


def test_main_text_edges(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "long words " * 50_000)], "page_id long, url string, html string")
    weights = html_content.learn_weights(pages)
    got = html_content.extract(pages.withColumn("text", F.lit("clash")), weights).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(TEXT)), (1, len(TEXT)), (2, 0), (3, 11 * 50_000 - 1)]
    assert html_content.learn_weights(pages.limit(0)) == {}
    assert html_content.extract(pages.limit(0), {}).count() == 0
