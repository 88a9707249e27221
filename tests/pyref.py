"""Small independent Python implementations written from the documented semantics
(SURVEY §2.10); the Spark operators are compared against them."""

from __future__ import annotations

import math
import re
import string
from collections import Counter


def squad_normalize(s: str) -> str:
    s = s.lower()
    s = "".join(ch for ch in s if ch not in set(string.punctuation))
    s = re.sub(r"\b(a|an|the)\b", " ", s)
    return " ".join(s.split())


def squad_em(pred: str, gold: str) -> float:
    return float(squad_normalize(pred) == squad_normalize(gold))


def squad_f1(pred: str, gold: str) -> float:
    p, g = squad_normalize(pred).split(), squad_normalize(gold).split()
    same = sum((Counter(p) & Counter(g)).values())
    if same == 0:
        return 0.0
    pr, rc = same / len(p), same / len(g)
    return 2 * pr * rc / (pr + rc)


def _ngrams(toks, n):
    return Counter(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))


def bleu_stats(pred_toks, refs_toks, max_n=4):
    num, den = [0] * max_n, [0] * max_n
    diffs = [abs(len(r) - len(pred_toks)) for r in refs_toks]
    ref_len = len(refs_toks[diffs.index(min(diffs))])
    for n in range(1, max_n + 1):
        pc = _ngrams(pred_toks, n)
        rc = Counter()
        for r in refs_toks:
            rc |= _ngrams(r, n)
        num[n - 1] = sum((pc & rc).values())
        den[n - 1] = sum(pc.values())
    return num, den, len(pred_toks), ref_len


def bleu_from(num, den, pl, rl, max_n=4):
    if min(num) == 0:
        return 0.0
    geo = math.exp(sum(math.log(a / b) for a, b in zip(num, den)) / max_n)
    bp = 1.0 if pl > rl else math.exp(1 - rl / pl)
    return bp * geo


def sentence_bleu(pred: str, refs: list[str]) -> float:
    return bleu_from(*bleu_stats(pred.split(), [r.split() for r in refs]))


_13A = [
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def tok13a(line: str) -> list[str]:
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = f" {line} "
    for rx, rep in _13A:
        line = rx.sub(rep, line)
    return line.split()


def sacre_bleu(pred: str, refs: list[str]) -> float:
    return bleu_from(*bleu_stats(tok13a(pred), [tok13a(r) for r in refs]))


def rouge_tokens(s: str) -> list[str]:
    return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", s.lower())) if t]


def _prf(hits, np_, nr):
    if np_ == 0 or nr == 0 or hits == 0:
        return (0.0, 0.0, 0.0)
    p, r = hits / np_, hits / nr
    return (p, r, 2 * p * r / (p + r))


def rouge_n(pred: str, ref: str, n: int):
    p, r = _ngrams(rouge_tokens(pred), n), _ngrams(rouge_tokens(ref), n)
    return _prf(sum((p & r).values()), sum(p.values()), sum(r.values()))


def lcs_dp(a, b) -> int:
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def rouge_l(pred: str, ref: str):
    p, r = rouge_tokens(pred), rouge_tokens(ref)
    return _prf(lcs_dp(p, r), len(p), len(r))


TOKEN_RX = re.compile(r"[^\W]+|[^\w\s]", re.UNICODE)


def windows(n: int, cap: int, stride: int):
    step = cap - stride
    if n <= cap:
        return [(0, n)]
    k = math.ceil((n - cap) / step) + 1
    return [(i * step, min(i * step + cap, n)) for i in range(k)]


def best_span_loop(windows_, n_best, max_len, context):
    """Best answer text over windows given as (start logits, end logits, offsets): every admissible
    (window, start, end) is listed and the best one picked by an explicit order: score, then
    earlier window, then rank of the start and of the end among its window's n best."""
    import itertools

    import numpy as np

    found = []
    for w, (starts, ends, offsets) in enumerate(windows_):
        ranked = [sorted(range(len(x)), key=lambda i, x=x: (-np.float32(x[i]), -i))[:n_best] for x in (starts, ends)]
        inside = lambda i, offsets=offsets: i < len(offsets) and offsets[i] is not None
        for (rs, s), (re_, e) in itertools.product(*map(enumerate, ranked)):
            if inside(s) and inside(e) and 0 <= e - s < max_len:
                score = float(np.float32(starts[s]) + np.float32(ends[e]))
                found.append(((-score, w, rs, re_), context[offsets[s][0] : offsets[e][1]]))
    return min(found)[1] if found else ""
