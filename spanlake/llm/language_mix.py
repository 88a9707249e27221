"""Language identification by multilingual mixture inference (operator 8).

Character trigram counts per language (with word edges) are summed over every labelled
training document. A word's log likelihood under a language is the sum over its trigrams.
Each document is a mixture: expectation-maximisation over its words estimates the share of
each language, and the set of languages is the one with the best penalised likelihood
(BIC: half the logarithm of the number of words for each further language) among the sets of
its k most likely languages, k = 1, 2, ... The prediction is the language with the largest
share of the chosen set, the score its share times the posterior probability of that
language against the others as the only one (so doubtful short texts score low).

The model holds every trigram of every language (sparse: about ten bytes for each language a
trigram occurs in and sixteen for the trigram), normalised over all counts; only trigrams that a
language's training texts lack get the smoothed floor. Its size grows with the distinct trigrams,
not with the texts. Words a worker has seen are remembered (``CACHE`` words, then
cleared; likelihoods are a pure function).

Defined cases: null texts and texts without a letter are ``und`` with score 0; null languages
and null ids are not learned from; without any training row every text is ``und``; ties go to
the language first in code point order. Texts are used whole; words longer than ``MAX_WORD``
characters are cut into words of that length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import held_out

MAX_WORD = 32
SMOOTH = 0.5
EM_STEPS = 8
CACHE = 400_000
#: Words handled at once, which bounds the work arrays.
BLOCK = 1 << 18

_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in set(text))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; long ones in pieces."""
    if not text.isascii():  # numerals such as one half or superscript two are no letters
        odd = [c for c in set(text) if c.isnumeric() and not c.isalpha()]
        text = text.translate({ord(c): " " for c in odd}) if odd else text
    out = _OTHER.sub(" ", text.lower()).split()
    if max(map(len, out), default=0) > MAX_WORD:
        out = [w[i : i + MAX_WORD] for w in out for i in range(0, len(w), MAX_WORD)]
    return out


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all trigrams of `` word `` in order, and the number of trigrams of each word."""
    flat = np.array([" " + "  ".join(words) + " "]).view(np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return (flat[at] << 42) | (flat[at + 1] << 21) | flat[at + 2], size


class Model:
    """Log likelihood of trigrams by language."""

    def __init__(self, langs: list[str], codes: np.ndarray, first: np.ndarray, lang: np.ndarray, gain: np.ndarray, floor: np.ndarray):
        """``codes``: sorted trigrams; those of entry ``first[i]`` to ``first[i + 1]`` of ``lang`` and
        ``gain`` belong to the i-th: the languages that have it, and what it gains over ``floor``."""
        self.langs, self.codes, self.first, self.lang, self.gain, self.floor = langs, codes, first, lang, gain, floor
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(langs)))

    @classmethod
    def of_counts(cls, langs: list[str], code: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Model:
        """From counts of (trigram, language number), each pair once."""
        order = np.argsort(code, kind="stable")
        codes, first = np.unique(code[order], return_index=True)
        norm = np.log(np.bincount(lang, n, len(langs)) + SMOOTH * (len(codes) + 1))
        gain = np.log(n[order] + SMOOTH) - np.log(SMOOTH)
        return cls(langs, codes, np.append(first, len(code)), lang[order].astype(np.int16), gain, np.log(SMOOTH) - norm)

    def __getstate__(self):
        return {"langs": self.langs, "codes": self.codes, "first": self.first, "lang": self.lang, "gain": self.gain, "floor": self.floor}

    def __setstate__(self, state):
        self.__init__(**state)

    def word_likelihoods(self, words: list[str]) -> np.ndarray:
        code, size = trigrams(words)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        hit = self.codes[at] == code
        word, at = np.repeat(np.arange(len(words)), size)[hit], at[hit]
        many = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        k = len(self.langs)
        gain = np.bincount(np.repeat(word, many) * k + self.lang[entry], self.gain[entry], len(words) * k)
        return size[:, None] * self.floor + gain.reshape(len(words), k)

    def lookup(self, bags: list[Counter]) -> np.ndarray:
        """Row numbers (in ``rows``) of the bags' words, one after another."""
        if len(self.known) > CACHE:
            self.known, self.rows = {}, np.empty((0, len(self.langs)))
        new = list(set().union(*bags).difference(self.known))
        if new:
            parts = [self.word_likelihoods(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, *parts])
        return np.fromiter((self.known[w] for b in bags for w in b), np.int64, sum(map(len, bags)))


def _em(like: np.ndarray, n: np.ndarray, at: np.ndarray, doc: np.ndarray, shares: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after ``steps`` updates and the log likelihood of each document under them.
    ``like``: scaled word likelihoods; ``n``: word counts; ``at``: first word of each document;
    ``doc``: document of each word; ``shares``: start, zero for languages left out."""
    total = np.add.reduceat(n, at)
    for _ in range(steps):
        r = like * shares[doc]
        r *= (n / np.maximum(r.sum(axis=1), 1e-300))[:, None]
        shares = np.add.reduceat(r, at) / total[:, None]
    ll = np.add.reduceat(n * np.log(np.maximum((like * shares[doc]).sum(axis=1), 1e-300)), at)
    return shares, ll


def infer(model: Model, bags: list[Counter]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Prediction, score and shares of documents given as non-empty word counts."""
    k = len(model.langs)
    row = model.lookup(bags)
    n = np.fromiter((c for b in bags for c in b.values()), float, len(row))
    size = np.fromiter(map(len, bags), np.int64, len(bags))
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    doc = np.repeat(np.arange(len(bags)), size)
    logs = model.rows[row]
    top = logs.max(axis=1)
    like = np.exp(np.maximum(logs - top[:, None], -60.0))
    total = np.add.reduceat(n, at)
    # the sets of one language need no iteration
    single = np.add.reduceat((logs - top[:, None]) * n[:, None], at)
    shares, _ = _em(like, n, at, doc, np.full((len(bags), k), 1.0 / k), EM_STEPS)
    order = np.argsort(-shares, axis=1, kind="stable")
    best_ll = single.max(axis=1)
    best_one = single.argmax(axis=1)
    best = np.zeros((len(bags), k))
    best[np.arange(len(bags)), best_one] = 1.0
    best_bic = best_ll
    going = np.ones(len(bags), bool)
    for m in range(2, k + 1):
        mask = np.zeros((len(bags), k))
        np.put_along_axis(mask, order[:, :m], 1.0, axis=1)
        start = np.maximum(shares, 1e-3) * mask
        got, ll = _em(like, n, at, doc, start / start.sum(axis=1, keepdims=True), 3)
        bic = ll - 0.5 * (m - 1) * np.log(total + 1)
        # a document stops at its first set that is no better, whatever its batch holds
        better = (bic > best_bic) & going
        best = np.where(better[:, None], got, best)
        best_bic = np.where(better, bic, best_bic)
        going = better
        if not going.any():
            break
    pick = best.argmax(axis=1)
    post = np.exp(single - single.max(axis=1, keepdims=True))
    post /= post.sum(axis=1, keepdims=True)
    share = best[np.arange(len(bags)), pick]
    score = np.where(share >= 1, post[np.arange(len(bags)), pick], share)
    return [model.langs[i] for i in pick], np.clip(score, 0, 1), best


# --- training in Spark --------------------------------------------------------------


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial trigram counts of each language."""
    held: dict[str, Counter] = {}

    def out():
        for lang, words in held.items():
            names = [w for w in words if w]
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                code, size = trigrams(part)
                weight = np.repeat(np.fromiter((words[w] for w in part), np.int64, len(part)), size)
                u, inv = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(np.bincount(inv, weight).astype(np.int64))], ["lang", "code", "n"])
        held.clear()

    for b in batches:
        for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
            held.setdefault(lang, Counter()).update(words_of(t.as_py()))
        if sum(map(len, held.values())) > 200_000:
            yield from out()
    yield from out()


def train(docs: DataFrame) -> Model | None:
    """The model, from all labelled training documents."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    part = rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(_count_rows, "lang string, code long, n long")
    got = part.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    found = got["lang"].combine_chunks().dictionary_encode()
    names = found.dictionary.to_pylist()
    langs = sorted(names)
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in names], np.int64)[found.indices.to_numpy()]
    return Model.of_counts(langs, got["code"].to_numpy(), lang, got["n"].to_numpy())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score, langs (language:share of the
    chosen set, by share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags, preds, scores, sets = [], ["und"] * b.num_rows, np.zeros(b.num_rows), [""] * b.num_rows
            where: list[int] = []

            def flush():
                lang, score, shares = infer(model, bags)
                for i, j in enumerate(where):
                    preds[j], scores[j] = lang[i], score[i]
                    chosen = [(-s, name) for s, name in zip(shares[i].tolist(), model.langs) if s > 0.005]
                    sets[j] = ",".join(f"{name}:{-s:.2f}" for s, name in sorted(chosen))
                bags.clear()
                where.clear()

            held = 0
            for j, t in enumerate(b.column(1)):
                text = t.as_py()
                if model is None or not text or not has_letter(text):
                    continue
                bags.append(Counter(words_of(text)))
                where.append(j)
                held += len(bags[-1])
                if held > BLOCK:
                    flush()
                    held = 0
            if bags:
                flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(preds, pa.string()), pa.array(scores), pa.array(sets, pa.string())],
                ["doc_id", "lang_pred", "score", "langs"])

    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, langs string")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")
