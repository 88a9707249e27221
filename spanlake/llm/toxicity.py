"""Toxicity by a subsequence string-kernel SVM with Nystrom landmarks (operator 5).

A text is a bag of units: its distinct lower-cased words, and runs of spaced-out single
characters put together ("i d i o t"). The kernel of two units is the gap-weighted
subsequence kernel of order ``ORDER`` (every common subsequence counts with ``DECAY`` to the
power of the two spans it takes), normalised; so gaps and inserted characters only lower it.
Landmarks are chosen by pivoted Cholesky factorisation; the SVM (squared hinge) is linear in
the Nystrom features. Because kernel values against landmarks are sums over subsequences, the
trained decision collapses exactly to one weight per subsequence of three characters: a
unit's margin is a weighted sum over its own subsequences, at no cost per landmark.

A text's margin is that of its worst unit, and a logistic curve placed by the labelled
texts turns it into a score.

Labels belong to whole texts, so units get theirs from counts (multiple-instance learning): a
unit is counted once per document that has it in a context (the word before) of its own, so that copies of
a text count once and long texts no more than short ones;
positive units have significantly more toxic documents than chance over all units would give,
and hardly any clean one, or open like that (compounds of an insult); the evident ones also stand in
spelt variants (a character inserted, doubled or masked, marks or a gap between letters, digits for
letters). Negative units are drawn from clean texts, and the hardest of a larger draw are added for
two further fits. Labelled texts place the score, with variants of characters that the learned ones do not have. All counts are made by Spark over a bounded sample
(``MAX_LABELLED`` labelled texts by id hash); the driver receives at most ``MAX_POSITIVE`` +
``NEGATIVE_POOL`` units and ``MAX_LABELLED`` margins.

Defined cases: null, empty and blank texts have no unit and get the score of the least toxic
margin; a null label or id is not learned from; repeated label rows of an id count once
(the larger label wins); without both classes every score is 0. Long words are read in
overlapping windows of ``MAX_UNIT`` characters, so whole texts are scored.
"""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import held_out, written

ORDER = 3
DECAY = 0.4
MAX_UNIT = 24
#: Character classes, and the first of those that characters beyond ASCII share.
ALPHABET, OTHERS = 128, 64
MAX_LABELLED = 8_000
MAX_POSITIVE = 1_500
#: Length of the openings that stand for all compounds with them, and most openings kept.
PREFIX = 4
MAX_OPENINGS = 1_000
MAX_NEGATIVE = 6_000
LANDMARKS = 400
POOL = 1_200
#: Times as many toxic as clean contexts a positive unit must have.
TOXIC_TO_CLEAN = 20
#: Positive units taken (by evidence) where fewer pass the bounds.
LEAST_POSITIVE = 10
#: Negative units from which the hardest are added for a second fit, and how many.
NEGATIVE_POOL, HARD = 40_000, 1_500
#: Place of the score's middle in the gap between clean and toxic margins.
UPPER = 0.4
#: Units whose margins a worker remembers; cleared when full (margins are a pure function).
CACHE = 500_000

_SPACED = re.compile(r"(?:(?<=\s)|^)\S(?:[ \t]\S){2,}(?=\s|$)")
#: Letters of a spaced-out run, or of a unit with a masked letter, at least.
LEAST_RUN = 4
#: Variants of the positive units that are learned, and that place the score, at most; characters inserted in each.
MAX_VARIANTS = 4_000
LEARNED_INSERTS, PLACING_INSERTS = "xq.zj-", "kv'wy~"
_DIGITS = str.maketrans({"a": "4", "e": "3", "i": "1", "o": "0", "s": "5", "t": "7"})  # fixed values: digits that look like letters
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»¡¿“”‘’…"

# --- units --------------------------------------------------------------------------


def raw_units(text: str) -> set[str]:
    """Distinct lower-cased words, and spaced-out runs without their spaces (also without a first or last
    character, which may be a word of its own, as in ``a w o r d``)."""
    text = text.lower()
    out = set(text.split())
    for m in _SPACED.finditer(text):
        run = "".join(m.group().split())
        out |= {run, run[1:], run[:-1], run[1:-1]} if len(run) > LEAST_RUN else {run}
    return out


def variants(unit: str, inserts: str) -> list[str]:
    """A unit as it is spelt to slip through: a character inserted or doubled, marks between the letters, a
    letter masked, a gap, digits for letters. Inserted characters come from ``inserts``, in turn."""
    inner = range(1, len(unit))
    out = [unit[:k] + inserts[k % len(inserts)] + unit[k:] for k in inner] + [unit[:k] + unit[k - 1] + unit[k:] for k in inner]
    out += [unit[:k] + "**" + unit[k:] for k in inner if 1 < k < len(unit) - 1] + [unit[:k] + "*" + unit[k + 1 :] for k in inner if len(unit) > LEAST_RUN and k < len(unit) - 1]
    out += [mark.join(unit) for mark in ".-_*"] + [unit.translate(_DIGITS)]
    return [v for v in dict.fromkeys(out) if v != unit and len(v) <= MAX_UNIT]


def pieces(unit: str) -> list[str]:
    """A unit without outer punctuation, cut into overlapping windows if it is long."""
    unit = unit.strip(_EDGE)
    if len(unit) <= MAX_UNIT:
        return [unit] if unit else []
    half = MAX_UNIT // 2
    return [unit[i : i + MAX_UNIT] for i in range(0, len(unit) - half, half)]


def _codes(units: list[str]) -> np.ndarray:
    """Character classes of units of one length, with a mark at both ends (class 1): a-z are
    classes 2-27, digits 28, other ASCII characters from 29 on; all others share the remaining classes by code point."""
    n = len(units[0])
    c = np.array(["".join(units)]).view(np.uint32).astype(np.int64).reshape(len(units), n)
    low = (c >= 97) & (c <= 122)
    digit = (c >= 48) & (c <= 57)
    out = np.where(low, c - 95, np.where(digit, 28, np.where(c < 128, _MARK_CLASS[np.minimum(c, 127)], OTHERS + c % (ALPHABET - OTHERS))))
    return np.pad(out, ((0, 0), (1, 1)), constant_values=1)


#: Classes of ASCII characters that are neither small letters nor digits: printable marks apart, the rest alike.
_MARK_CLASS = np.full(128, 29, np.int64)
_MARK_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 30 + np.arange(32)


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _TRIPLES:
        i, j, k = np.meshgrid(np.arange(n), np.arange(n), np.arange(n), indexing="ij")
        ok = (i < j) & (j < k)
        ijk = np.stack([i[ok], j[ok], k[ok]])
        _TRIPLES[n] = ijk, DECAY ** (ijk[2] - ijk[0] + 1.0)
    return _TRIPLES[n]


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All subsequences of three characters of each row: their codes and their weights."""
    ijk, w = _triples(codes.shape[1])
    c = codes.astype(np.int32)
    out = np.take(c * ALPHABET**2, ijk[0], axis=1)
    out += np.take(c * ALPHABET, ijk[1], axis=1)
    out += np.take(c, ijk[2], axis=1)
    return out, w


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """K(x, x) of each row, by the recursion of the gap-weighted subsequence kernel."""
    rows, n = codes.shape
    i = np.arange(n)
    gap = np.where(i[:, None] > i[None, :], DECAY ** np.maximum(i[:, None] - i[None, :] - 1.0, 0), 0.0).T.astype(np.float32)
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32) * np.float32(DECAY**2)
    m = same
    for _ in range(ORDER - 1):
        # gap' m gap of symmetric matrices, as two products of one large matrix
        half = (m.reshape(-1, n) @ gap).reshape(rows, n, n).transpose(0, 2, 1)
        m = same * (np.ascontiguousarray(half).reshape(-1, n) @ gap).reshape(rows, n, n)
    return m.sum(axis=(1, 2), dtype=np.float64)


# --- model --------------------------------------------------------------------------


#: Unit margins of the model in use; lives as long as the worker, for all its tasks.
_KNOWN: dict[str, dict[str, float]] = {}


@dataclass
class Model:
    """Weight per subsequence, bias, and the logistic curve of the score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def unit_margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), np.inf * -1)
        by_len: dict[int, tuple[list[int], list[str]]] = {}
        for n, u in enumerate(units):
            for p in pieces(u):
                at, words = by_len.setdefault(len(p), ([], []))
                at.append(n)
                words.append(p)
        for n, (at, words) in by_len.items():
            step = max(1, 200_000 // len(_triples(n + 2)[1]))
            for i in range(0, len(words), step):
                codes = _codes(words[i : i + step])
                sub, w = subsequences(codes)
                f = (np.take(self.weights, sub) @ w.astype(np.float32)) / np.sqrt(self_kernel(codes)) + self.bias
                np.maximum.at(out, at[i : i + step], f)
        return out

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Margin of the worst unit of each text; -inf without units."""
        if len(_KNOWN.get(self.name, ())) > CACHE or self.name not in _KNOWN:
            _KNOWN.clear()
        known, bags, new = _KNOWN.setdefault(self.name, {}), [], set()
        for t in texts:
            bag = raw_units(t) if t else set()
            bags.append(bag)
            new |= bag.difference(known)  # a dict operand: cost of the bag, not of all known
        fresh = list(new)
        known.update(zip(fresh, self.unit_margins(fresh).tolist()))
        return np.array([max(map(known.__getitem__, b), default=-np.inf) for b in bags])

    def score(self, margins: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * np.maximum(margins, -20.0) + self.offset, -40, 40)
        return 1 / (1 + np.exp(-z))


def _features(units: list[str], vocab: np.ndarray) -> np.ndarray:
    """Normalised feature map of each unit, restricted to the subsequences in ``vocab``."""
    out = np.zeros((len(units), len(vocab)))
    for n in {len(u) for u in units}:
        at = np.array([i for i, u in enumerate(units) if len(u) == n])
        codes = _codes([units[i] for i in at])
        sub, w = subsequences(codes)
        col = np.searchsorted(vocab, sub)
        col[col == len(vocab)] = 0
        hit = vocab[col] == sub
        val = (w[None, :] / np.sqrt(self_kernel(codes))[:, None])[hit]
        np.add.at(out, (np.broadcast_to(at[:, None], sub.shape)[hit], col[hit]), val)
    return out


def _all_subsequences(units: list[str]) -> np.ndarray:
    found = [np.unique(subsequences(_codes([u for u in units if len(u) == n]))[0]) for n in {len(u) for u in units}]
    return np.unique(np.concatenate(found))


def _landmarks(gram: np.ndarray, count: int) -> list[int]:
    """Pivots of an incomplete Cholesky factorisation: each time the unit explained least."""
    rest, rows, picked = gram.diagonal().copy(), np.zeros((count, len(gram))), []
    for k in range(min(count, len(gram))):
        p = int(np.argmax(rest))
        if rest[p] < 1e-6:
            break
        rows[k] = (gram[p] - rows[:k, p] @ rows[:k]) / np.sqrt(rest[p])
        rest = np.maximum(rest - rows[k] ** 2, 0)
        rest[p] = -1
        picked.append(p)
    return picked


def fit_svm(positive: list[str], negative: list[str], rounds: int = 25, ridge: float = 1e-4, hard: int = 0) -> Model:
    """Nystrom features on landmarks, then a linear squared-hinge SVM by Newton steps. The first ``hard``
    negatives have half of the weight of all."""
    pool = positive[: POOL // 2] + negative[: POOL // 2]
    vocab = _all_subsequences(pool)
    phi = _features(pool, vocab)
    picked = _landmarks(phi @ phi.T, LANDMARKS)
    marks = phi[picked]
    val, vec = np.linalg.eigh(marks @ marks.T)
    root = vec[:, val > 1e-8] / np.sqrt(val[val > 1e-8])
    units = positive + negative
    x = np.concatenate([_features(units[i : i + 500], vocab) @ marks.T @ root for i in range(0, len(units), 500)])
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.where(y > 0, 0.5 / max(1, len(positive)), 0.5 / max(1, len(negative)))
    if 0 < hard < len(negative):
        cost[len(positive) :] = np.where(np.arange(len(negative)) < hard, 0.25 / hard, 0.25 / (len(negative) - hard))
    w = np.zeros(x.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-8
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(reg), (xa * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = 0.5 * (w + new) if _ > 8 else new
    table = np.zeros(ALPHABET**ORDER, np.float32)
    table[vocab] = (root @ w[:-1]) @ marks
    return Model(table, float(w[-1]))


def fit_score(margin: np.ndarray, label: np.ndarray, spelt: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic score. A score of 0.5 lies where texts are separated with the
    fewest errors, in the widest such gap between margins; if nine in ten of ``spelt``, the margins of
    spelt insults, lie over the gap's lower end, they end the gap. Its place is ``UPPER`` of the gap; the
    slope gives the median of the texts above 0.95."""
    cuts, at = np.unique(margin, return_inverse=True)
    toxic = np.bincount(at, label, len(cuts))
    clean = np.bincount(at, 1 - label, len(cuts))
    # a cut below value k takes values k and up as toxic
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    edge = np.concatenate([[cuts[0] - 1], cuts, [cuts[-1] + 1]])
    width = np.diff(edge)
    k = max(np.flatnonzero(errors == errors.min()), key=lambda i: width[i])
    low, high = edge[k], edge[k + 1]
    if spelt is not None and len(spelt) and (tenth := float(np.quantile(spelt, 0.1))) > low:
        high = min(high, tenth)
    cut = low + UPPER * (high - low)
    above = margin[margin > cut]
    slope = np.log(19.0) / max(1e-6, np.median(above) - cut) if len(above) else 1.0
    return float(slope), float(-slope * cut)


# --- training in Spark --------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, toxic) of about ``limit`` labelled training rows (all, if fewer), by id hash."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    lab = lab.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    lab = written(lab, "toxic-labels")
    lab = lab.where(F.pmod(F.xxhash64("_id"), F.lit(max(1, lab.count()))) < limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the label side has about ``limit`` rows of two numbers
    return rows.join(F.broadcast(lab), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, context, doc_id, toxic) of every word and of its opening ``PREFIX`` characters (marked by a
    space). The context is the word before, for an opening also the rest of the word."""
    for b in batches:
        for d, t, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            words = [w for u in (t.as_py() or "").lower().split() for w in pieces(u)]
            pairs = set(zip(words, ["", *words]))
            units = [w for w, _ in pairs]
            context = [crc32(c.encode("utf-8", "replace")) for _, c in pairs]
            for w, c in pairs:
                if len(w) > PREFIX:
                    units.append(" " + w[:PREFIX])
                    context.append(crc32(f"{w[PREFIX:]} {c}".encode("utf-8", "replace")))
            if units:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(units, pa.string()), pa.array(context, pa.int64()), pa.array([d] * len(units), pa.int64()), pa.array([y] * len(units), pa.int32())],
                    ["unit", "context", "doc_id", "toxic"])


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model | None:
    """The fitted model, or None if the labelled rows do not hold both classes."""
    sample = written(labelled(docs, labels, limit), "toxic-sample")
    n = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_toxic, n_clean = int(n[0] or 0), int(n[1] or 0)
    if not n_toxic or not n_clean:
        return None
    seen = sample.select("doc_id", "text", "toxic").mapInArrow(_unit_rows, "unit string, context long, doc_id long, toxic int")
    # a context counts for one document, so copies of a text do not count; and a document counts once, however long
    seen = seen.groupBy("unit", "context").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"), F.min("doc_id").alias("doc_id"))
    seen = seen.groupBy("unit", "doc_id").agg(F.max("t").alias("t"), F.max("c").alias("c"))
    stats = written(seen.groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxic-units")
    words = stats.where(~F.col("unit").startswith(" "))
    total = words.agg(F.sum("t"), F.sum("c")).first()
    if not total or not total[0] or not total[1]:
        return None
    # log likelihood ratio of the toxic share of a unit's contexts against that of all words; a unit
    # is a sign if its excess is larger than the best of as many chance units would show
    base, t, c = total[0] / (total[0] + total[1]), F.col("t"), F.col("c")
    term = lambda k, p: F.when(k > 0, k * F.log(k / (t + c) / F.lit(p))).otherwise(0.0)
    evidence = F.when(t / (t + c) > base, term(t, base) + term(c, 1 - base)).otherwise(0.0)
    stats = stats.withColumn("evidence", evidence)
    bound = math.log(max(2, stats.count()))
    sign = (F.col("evidence") >= bound) & (t >= TOXIC_TO_CLEAN * c)
    best = lambda df, n: df.orderBy(F.desc("evidence"), "unit").limit(n)
    words = stats.where(~F.col("unit").startswith(" "))
    openings = best(stats.where(F.col("unit").startswith(" ") & sign), MAX_OPENINGS).select(F.col("unit").alias("opening"))
    opened = words.where(c == 0).join(F.broadcast(openings), F.concat(F.lit(" "), F.substring("unit", 1, PREFIX)) == F.col("opening"))
    evident = {r[0] for r in best(words.where(sign), MAX_POSITIVE).select("unit").collect()}
    positive = [r[0] for r in best(words.where(sign).unionByName(opened.drop("opening")).distinct(), MAX_POSITIVE).select("unit").collect()]
    if len(positive) < LEAST_POSITIVE:
        more = best(words.where((t > 1) & (F.col("evidence") > 0)), LEAST_POSITIVE).select("unit").collect()
        positive = list(dict.fromkeys([*positive, *(r[0] for r in more)]))[:LEAST_POSITIVE]
    known = set(positive)
    # half of the negatives are the words of most clean documents, which texts consist of, half any words
    neg = words.where((c > 0) & ((F.col("evidence") < 1.0) | (c >= t)))
    often, anyone = ([r[0] for r in neg.orderBy(*by).limit(NEGATIVE_POOL // 2).select("unit").collect()] for by in ([c.desc(), "unit"], [F.xxhash64("unit"), "unit"]))
    pool = [u for pair in itertools.zip_longest(often, anyone) for u in pair if u is not None and u not in known]
    pool = list(dict.fromkeys(pool))
    negative = pool[:MAX_NEGATIVE]
    if not positive or not negative:
        return None
    spelt = lambda inserts: [v for u in positive if u in evident and len(u) >= LEAST_RUN for v in variants(u, inserts) if v not in seen_clean]
    seen_clean = set(pool)
    some = lambda units: [u for u in units if crc32(u.encode()) % max(1, -(-len(units) // MAX_VARIANTS)) == 0]
    learned = positive + some(spelt(LEARNED_INSERTS))
    model = fit_svm(learned, negative)
    hard: dict[str, None] = {}
    for _ in range(2):
        hardest = np.argsort(-model.unit_margins(pool), kind="stable")[:HARD]
        hard |= dict.fromkeys(pool[i] for i in hardest)
        model = fit_svm(learned, list(dict.fromkeys([*hard, *negative])), hard=len(hard))
    got = _scored(sample.select("doc_id", "text"), model, raw=True).join(sample.select("doc_id", "toxic"), "doc_id").select("score", "toxic").collect()
    m = np.maximum(np.array([r[0] for r in got]), -20.0)
    model.slope, model.offset = fit_score(m, np.array([r[1] for r in got], float), model.unit_margins(some(spelt(PLACING_INSERTS))))
    return model


def _scored(docs: DataFrame, model: Model | None, raw: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                if model is None:
                    s = np.zeros(part.num_rows)
                else:
                    m = model.margins(part.column(1).to_pylist())
                    s = np.maximum(m, -20.0) if raw else model.score(m)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(s)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    out = _scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows whose text is not predicted toxic, all columns unchanged (a filter: no join)."""
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts), bool)
        for i in range(0, len(texts), 256):
            part = [t if isinstance(t, str) else None for t in texts.iloc[i : i + 256]]
            out[i : i + 256] = model.score(model.margins(part)) < 0.5
        return pd.Series(out)

    return docs.where(clean(F.col("text").cast("string")))
