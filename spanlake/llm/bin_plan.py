"""Plan of a packing from the number of pieces of each length (part of operator 12).

A length is at most the capacity, so the plan's input is a table of at most ``capacity`` counts,
whatever the number of documents. Everything here works on such counts:

- ``group``: linear grouping. The large lengths, longest first, are cut into groups of equal
  cardinality, and every member counts as long as the group's longest.
- ``configurations``: the few sizes that are left are packed by the linear programme over
  configurations (multisets of sizes that fit), solved by column generation; its solution is
  rounded down, and what remains is packed best-fit.
- ``best_fit``: the small lengths, longest first, go into the tightest bins that hold them. Bins
  of equal slack are one class, so a step moves whole runs of bins and pieces.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

#: Lengths above this share of the capacity are large.
LARGE = 1 / 8
#: Groups of the large lengths.
GROUPS = 256
#: Rounds of column generation at most; the programme is feasible after each.
ROUNDS = 120


def group(counts: dict[int, int], large: int, capacity: int, groups: int = GROUPS) -> list[tuple[int, int, int]]:
    """(size, first length, count) of each group of the lengths over ``large``, longest first; a group
    holds the lengths from its first one up to its size. A length stays whole, so a group may hold
    more than its share of pieces. Pieces that fill a bin are a group of their own beside the shares."""
    lengths = sorted((x for x in counts if x > large and counts[x]), reverse=True)
    share = sum(counts[x] for x in lengths if x < capacity) / groups
    out: list[tuple[int, int, int]] = []
    for x in lengths:
        if out and out[-1][0] < capacity and out[-1][2] + counts[x] <= max(share, 1):
            size, _, n = out[-1]
            out[-1] = size, x, n + counts[x]
        else:
            out.append((x, x, counts[x]))
    return out


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of greatest price (a knapsack, layer by layer: one more piece each)."""
    best, layers = np.zeros(capacity + 1), []
    back = np.maximum(np.arange(capacity + 1)[:, None] - sizes[None, :], -1)
    for _ in range(capacity // int(sizes.min())):
        value = np.where(back >= 0, best[back] + prices[None, :], -1.0)
        pick = value.argmax(axis=1)
        now = value[np.arange(capacity + 1), pick]
        pick = np.where(now > best + 1e-12, pick, -1)
        layers.append(pick)
        best = np.maximum(now, best)
        if (pick < 0).all():
            break
    used, c = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(layers):
        if pick[c] >= 0:
            used[pick[c]] += 1
            c -= sizes[pick[c]]
    return used


def _packed(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit packing of counts of sizes (longest first): (pieces of each size, bins)."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for k, (size, left) in enumerate(zip(sizes, demand)):
        for slack in range(size, capacity + 1):
            if not left:
                break
            fresh = slack == capacity
            kept, fit = [], slack // size
            for used, n in bins.pop(slack, []) + ([((0,) * len(sizes), -(-left // fit))] if fresh else []):
                whole = min(n, left // fit)
                parts = [(whole, fit), (1, left - whole * fit)] if whole < n and left - whole * fit else [(whole, fit)]
                for many, pieces in parts:
                    if many and pieces:
                        bins[slack - pieces * size].append((used[:k] + (pieces,) + used[k + 1 :], many))
                        left -= many * pieces
                        n -= many
                if n and not fresh:
                    kept.append((used, n))
            if kept:
                bins[slack] += kept
    found: dict[tuple[int, ...], int] = defaultdict(int)
    for held in bins.values():
        for used, n in held:
            found[used] += n
    return list(found.items())


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(pieces of each size, bins): configurations that hold exactly ``demand``. ``sizes`` fall."""
    if not sizes:
        return []
    s, d, k = np.array(sizes), np.array(demand, float), len(sizes)
    start = _packed(sizes, demand, capacity)
    # revised simplex from the basis in which each size has bins of its own
    basis = [np.where(np.arange(k) == i, capacity // s[i], 0) for i in range(k)]
    inverse = np.diag(1 / (capacity // s))
    amount = inverse @ d
    columns = [np.array(c) for c, _ in start]  # a good packing to begin with
    for turn in range(len(columns) + rounds):
        prices = inverse.sum(axis=0)
        column = columns[turn] if turn < len(columns) else _best_configuration(s, prices, capacity)
        if prices @ column <= 1 + 1e-9:
            if turn >= len(columns):
                break  # no configuration is worth more than its bin
            continue
        direction = inverse @ column
        steps = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(steps.argmin())
        amount = amount - steps[leave] * direction
        amount[leave] = steps[leave]
        amount = np.maximum(amount, 0)
        basis[leave] = column
        inverse[leave] /= direction[leave]
        rest = np.arange(k) != leave
        inverse[rest] -= direction[rest, None] * inverse[leave][None, :]
    whole = np.floor(amount + 1e-9).astype(np.int64)
    left, out = np.array(demand, np.int64), []
    for column, n in sorted(((tuple(map(int, c)), int(n)) for c, n in zip(basis, whole)), reverse=True):
        if n:  # an exact programme covers the demand; rounding errors must not pass it
            n = min(n, *(int(left[i]) // m for i, m in enumerate(column) if m))
        if n:
            out.append((column, n))
            left -= n * np.array(column)
    out += _packed(sizes, left.tolist(), capacity)
    return out if sum(n for _, n in out) <= sum(n for _, n in start) else start


def best_fit(slacks: dict[int, int], counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Where the small pieces go: (length, first piece, pieces, slack, first bin, pieces a bin, offset).

    ``slacks`` has the number of bins of each slack. Of the bins that had that slack at the start, in
    their order, the ones from ``first bin`` on take ``pieces a bin`` of the pieces of that length (the
    last one may take fewer), in their order, from ``offset`` in the bin on. Slack ``capacity`` stands for new bins."""
    held: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # slack now: (slack at the start, first bin, bins)
    for s, n in slacks.items():
        if 0 < s < capacity and n:
            held[s].append((s, 0, n))
    opened, out = 0, []
    for size in sorted((x for x in counts if counts[x]), reverse=True):
        at, left = 0, counts[size]
        for slack in range(size, capacity + 1):
            if not left:
                break
            fit, kept = slack // size, []
            runs = held.pop(slack, [])
            if slack == capacity:
                runs = [(capacity, opened, -(-left // fit))]
                opened += runs[0][2]
            for origin, lo, n in runs:
                for many, pieces in ((min(n, left // fit), fit), (1, left % fit if left < n * fit else 0)):
                    if many and pieces:
                        out.append((size, at, many * pieces, origin, lo, pieces, capacity - slack))
                        held[slack - pieces * size].append((origin, lo, many))
                        at, left, lo, n = at + many * pieces, left - many * pieces, lo + many, n - many
                if n:
                    kept.append((origin, lo, n))
            held[slack] += kept
    return out
