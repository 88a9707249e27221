"""Plain-Python versions of the operators, written from their contracts."""

from __future__ import annotations

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_components(docs, k, per_cent=80):
    """{doc_id: (set size, component)} over (doc_id, text), all pairs compared."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both * 100 >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def removed_lines(docs):
    """{doc_id: (lines, removed line numbers, kept text)} over (doc_id, text) of distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        if t is None:
            out[d] = (0, set(), None)
            continue
        lines, gone = t.split("\n"), set()
        size = min(3, len(lines))  # a text of fewer lines is one window
        for i in range(len(lines) - size + 1):
            w = tuple(lines[i : i + size])
            if any(x.strip(" ") for x in w):
                if (len(w), w) in seen:
                    gone |= set(range(i, i + size))
                seen.add((len(w), w))
        out[d] = (len(lines), gone, "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, bench, n=10):
    wins = collections.defaultdict(set)
    for i, t in bench:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[k : k + n])] |= set() if i is None else {str(i)}
    out = {}
    for d, t in docs:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    items |= wins[tuple(w[k : k + size])]
        out[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


def targets(sizes, share=1.5, most=2):
    """{source: target} by resharing the excess until no target is above its bound."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(full.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return full | {s: level * weight[s] for s in free}
        full |= {s: most * sizes[s] for s in over}
        free -= over
    return full
