"""Conversation structure repair by bidirectional Dijkstra over the edit lattice (operator 11).

A conversation's turns are edited until its roles read ``(s?(ua)+)?`` by their initials. Edits in
turn order: Keep (0), Rerole to user or assistant (2), Delete (3, required for blank and
repeated turns), Insert an empty user or assistant turn (2); an undeleted truncated turn adds 1.
The audit is the initials of the edits; of the cheapest audits the ASCII-least is taken.

The lattice's nodes are (turns consumed, state), with four states: nothing yet, after the system turn,
after a user turn, after an assistant turn. An audit fixes the roles that its edits give, so no two
paths share one. A forward and a reverse heap settle nodes in order of cost (and of place, as a
free Keep moves on by one turn); when the sum of their fronts passes the best
crossing, every crossing of that cost has been finished, and the least concatenation of a node's
forward and reverse audit is the result. Each node needs only its least audit of least cost,
since equal-cost audits of one node never extend each other.

Scale: equal turns are first counted (a pre-aggregation), so copies are one lattice step however many;
the turns are put in order by range over (conversation, turn, role, text) and written with their place; blocks of
``SEGMENT`` places cut conversations into segments. A conversation inside one segment is
solved at once. A longer one has its segments solved for each pair of entry and exit state, and
the segments are joined in order by a stream that keeps one audit per state. No task ever holds
the texts of a conversation; what grows with one conversation is its audit, one character a turn, as the
contract has it.

Defined cases: null role and text count as one space, a null conv_id is a conversation of its own, null
turns come first; turns of equal number are put in order by role, then text; a turn that repeats is
a duplicate after its first copy; an empty role has no initial and can only be reroled or deleted; an empty
table gives an empty result; extra columns are ignored; very long texts move once with their turn.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written

#: Places of a block; a segment is a conversation's turns inside one block.
SEGMENT = 2_048
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Next state by state and role initial.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that an inserted or reroled turn leads to.
GIVEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
GIVEN_BY = {to: [s for s in range(4) if GIVEN[s] == to] for to in range(4)}
ACCEPTED = (START, ASSISTANT)
SPACE = r"[\x20\x09-\x0D]"

# a turn of the lattice: (initial, free copies (0 or 1), forced deletions, truncated)
Step = tuple[str, int, int, bool]
Label = tuple[int, str]


def _edges(steps: list[Step], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(turns consumed, state, cost, edits) from a node."""
    yield i, GIVEN[state], INSERT, "I"
    if i < len(steps):
        initial, free, forced, cut = steps[i]
        rest, less = "D" * forced, DELETE * forced
        yield i + 1, state, DELETE * free + less, "D" * free + rest
        if free:
            if (state, initial) in NEXT:
                yield i + 1, NEXT[state, initial], KEEP + cut * TRUNCATED + less, "K" + rest
            yield i + 1, GIVEN[state], REROLE + cut * TRUNCATED + less, "R" + rest


def _back_edges(steps: list[Step], i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """The edges that lead to a node, as (turns consumed, state, cost, edits) of where they start."""
    for s in GIVEN_BY[state]:
        yield i, s, INSERT, "I"
    if i:
        initial, free, forced, cut = steps[i - 1]
        rest, less = "D" * forced, DELETE * forced
        yield i - 1, state, DELETE * free + less, "D" * free + rest
        if free:
            for s in range(4):
                if NEXT.get((s, initial)) == state:
                    yield i - 1, s, KEEP + cut * TRUNCATED + less, "K" + rest
            for s in GIVEN_BY[state]:
                yield i - 1, s, REROLE + cut * TRUNCATED + less, "R" + rest


def cheapest(steps: list[Step], start: int, ends: tuple[int, ...]) -> Label | None:
    """(cost, audit) of the least cheapest path from ``start`` before the steps to one of ``ends`` after them."""
    n = len(steps)
    label: tuple[dict, dict] = ({(0, start): (0, "")}, {(n, e): (0, "") for e in ends})
    heaps: tuple[list, list] = ([(0, 0, start)], [(0, 0, e) for e in ends])
    settled: tuple[set, set] = (set(), set())
    best: Label | None = None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break  # every crossing of the best cost is finished
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, state = heapq.heappop(heaps[side])
        node = (at if side == 0 else n - at, state)
        if node in settled[side]:
            continue
        settled[side].add(node)
        cost, audit = label[side][node]
        for i, s, price, edits in (_edges if side == 0 else _back_edges)(steps, *node):
            found = cost + price, audit + edits if side == 0 else edits + audit
            to = i, s
            if to not in label[side] or found < label[side][to]:
                if to not in label[side] or found[0] < label[side][to][0]:
                    heapq.heappush(heaps[side], (found[0], i if side == 0 else n - i, s))
                label[side][to] = found
            met = label[1 - side].get(to)
            if met is not None:
                ahead, behind = (label[side][to], met) if side == 0 else (met, label[side][to])
                whole = ahead[0] + behind[0], ahead[1] + behind[1]
                best = whole if best is None else min(best, whole)
        met = label[1 - side].get(node)
        if met is not None:
            ahead, behind = ((cost, audit), met) if side == 0 else (met, (cost, audit))
            whole = ahead[0] + behind[0], ahead[1] + behind[1]
            best = whole if best is None else min(best, whole)
    return best


def states_after(steps: list[Step], start: int, audit: str) -> tuple[list[tuple[int, int, str]], int]:
    """What an audit does from a state: (turn, state after, edit) for each edit that leaves a turn, where
    an inserted one has turn -1; and the state at the end."""
    out, state, i, done = [], start, 0, 0
    for e in audit:
        if e == "I":
            state = GIVEN[state]
            out.append((-1, state, "I"))
            continue
        initial, free, forced, _ = steps[i]
        if e in "KR":
            state = NEXT[state, initial] if e == "K" else GIVEN[state]
            out.append((i, state, e))
        done += 1
        if done == free + forced:
            i, done = i + 1, 0
    return out, state


# --- turns in order ---------------------------------------------------------------------


def _key(conv_id: Column) -> Column:
    """A conversation's key, never null."""
    return F.coalesce(conv_id.cast("string"), F.lit(" "))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """One row per different turn, written: conv (key), conv_id, turn, role, text, place (its order), block,
    initial, n (copies), blank, first (no earlier turn has its role and text), truncated."""
    base = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    base = base.withColumn("conv", _key(F.col("conv_id")))
    # the texts of equal turns meet once; the digest tells turns of equal role and text apart from others
    seen = F.sha2(F.concat_ws("|", F.length("conv"), "conv", F.length("role"), "role", "text").cast("binary"), 256)
    some = base.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"), F.first("conv_id").alias("conv_id")).withColumn("seen", seen)
    narrow = base.select(seen.alias("_seen"), F.struct("turn").alias("t")).groupBy("_seen").agg(F.min("t").alias("_t"))  # null turns are the least
    some = some.join(narrow, F.col("seen") == F.col("_seen"))
    rows = some.select(
        "conv", "conv_id", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.col("turn").eqNullSafe(F.col("_t.turn")).alias("first"),
        (~F.col("text").rlike(rf"[.!?]{SPACE}*\z")).alias("truncated"))
    rows = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    rows = rows.withColumn("place", F.monotonically_increasing_id())  # kept by the write
    return written(rows.withColumn("block", F.floor(F.col("place") / SEGMENT)), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, and its first and last block."""
    n, blank, first = F.col("n"), F.col("blank"), F.col("first")
    whole = rows.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(blank, n).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(n - first.cast("long"))).alias("duplicate"),
        F.sum((~blank & first & F.col("truncated")).cast("long")).alias("truncated"),
        F.min("block").alias("b0"), F.max("block").alias("b1"))
    return whole


def _fields(ddl: str) -> pa.Schema:
    """Arrow fields of a flat list of columns."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


_PATH = "a int, b int, cost long, audit string"
_SEGMENT = "conv string, block long, b0 long, b1 long, first string, last string, illegal long"


def _illegal(initials: list[tuple[str, int]]) -> int:
    """Adjacent pairs of initials, each with its copies, that are not su, ua or au."""
    bad, before = 0, None
    for x, n in initials:
        bad += (before is not None and before + x not in ("su", "ua", "au")) + (n - 1)
        before = x
    return bad


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the paths from each entry state to each exit state that can be needed."""
    schema = _fields(_SEGMENT).append(pa.field("paths", pa.list_(pa.struct(list(_fields(_PATH))))))
    for b in batches:
        out = []
        for r in b.to_pylist():
            steps = [(t["initial"], t["free"], t["n"] - t["free"], t["truncated"]) for t in r["turns"]]
            entries = (START,) if r["block"] == r["b0"] else range(4)
            if r["b0"] == r["b1"]:
                paths = [(START, -1, *cheapest(steps, START, ACCEPTED))]
            else:
                exits = ACCEPTED if r["block"] == r["b1"] else range(4)
                paths = [(x, y, *got) for x in entries for y in exits if (got := cheapest(steps, x, (y,))) is not None]
            seen = [(t["initial"], t["n"]) for t in r["turns"]]
            out.append({
                "conv": r["conv"], "block": r["block"], "b0": r["b0"], "b1": r["b1"], "first": seen[0][0], "last": seen[-1][0], "illegal": _illegal(seen),
                "paths": [dict(zip(("a", "b", "cost", "audit"), p)) for p in paths]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_CHOSEN = "conv string, block long, entry int, audit string, at long, cost long, illegal long, whole boolean"


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of long conversations, in order, to the slices of each one's least cheapest audit."""
    schema = _fields(_CHOSEN)
    conv, state, illegal, last, blocks = None, {}, 0, None, []

    def close() -> list[dict]:
        cost, audit, path = min(state[s] for s in ACCEPTED if s in state)
        slices, at, out = [], 0, []
        while path is not None:
            path, entry, piece = path
            slices.append((entry, piece))
        for block, (entry, piece) in zip(blocks, reversed(slices)):
            out.append({"conv": conv, "block": block, "entry": entry, "audit": piece, "at": at, "cost": 0, "illegal": 0, "whole": False})
            at += len(piece) - piece.count("D")
        out.append({"conv": conv, "block": None, "entry": None, "audit": audit, "at": None, "cost": cost, "illegal": illegal, "whole": True})
        return out

    for b in batches:
        done = []
        for r in b.to_pylist():
            if r["conv"] != conv:
                if conv is not None:
                    done += close()
                conv, state, illegal, last, blocks = r["conv"], {START: (0, "", None)}, 0, None, []
            illegal += r["illegal"] + (last is not None and last + r["first"] not in ("su", "ua", "au"))
            last, now = r["last"], {}
            blocks.append(r["block"])
            for p in r["paths"]:
                if p["a"] in state:
                    cost, audit, path = state[p["a"]]
                    found = cost + p["cost"], audit + p["audit"], (path, p["a"], p["audit"])
                    if p["b"] not in now or found[:2] < now[p["b"]][:2]:
                        now[p["b"]] = found
            state = now
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if conv is not None:
        yield pa.RecordBatch.from_pylist(close(), schema=schema)


def audits(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of written ``rows`` and their faults: (conv, cost, audit, illegal) per conversation, and the slices
    (conv, block, entry, audit, at) of each segment, ``at`` counting the turns that the ones before leave."""
    turn = F.struct("place", "initial", "n", ((~F.col("blank")) & F.col("first")).cast("int").alias("free"), "truncated")
    # at most SEGMENT narrow turns
    parts = rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    parts = parts.join(found.select(F.col("conv").alias("_c"), "b0", "b1"), F.col("conv") == F.col("_c")).drop("_c")
    solved = written(parts.select("conv", "block", "b0", "b1", "turns").mapInArrow(_solve, f"{_SEGMENT}, paths array<struct<{_PATH.replace(' ', ':').replace(',:', ',')}>>"), "segments")
    one = solved.where("b0 = b1").select("conv", "block", F.lit(START).alias("entry"), F.col("paths")[0]["audit"].alias("audit"), F.lit(0).cast("long").alias("at"), F.col("paths")[0]["cost"].alias("cost"), "illegal")
    long = solved.where("b0 < b1").repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_join_segments, _CHOSEN)
    long = written(long, "chosen")
    whole = one.select("conv", "cost", "audit", "illegal").unionByName(long.where("whole").select("conv", "cost", "audit", "illegal"))
    slices = one.select("conv", "block", "entry", "audit", "at").unionByName(long.where("not whole").select("conv", "block", "entry", "audit", "at"))
    return whole, slices


_EDITS = "conv string, position long, place long, role string, edit string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _fields(_EDITS)
    for b in batches:
        out = []
        for r in b.to_pylist():
            steps = [(t["initial"], t["free"], t["n"] - t["free"], t["truncated"]) for t in r["turns"]]
            for k, (turn, state, edit) in enumerate(states_after(steps, r["entry"], r["audit"])[0]):
                out.append({"conv": r["conv"], "position": r["at"] + k, "place": r["turns"][turn]["place"] if turn >= 0 else None,
                            "role": None if edit == "K" else ROLE[state], "edit": edit})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def repaired_turns(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """The repaired conversations, a row per turn: conv, position (from 0), role, text, edit (K, R or I)."""
    turn = F.struct("place", "initial", "n", ((~F.col("blank")) & F.col("first")).cast("int").alias("free"), "truncated")
    parts = rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    s = slices.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), "entry", "audit", "at")
    parts = parts.join(s, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b"))).select("conv", "turns", "entry", "audit", "at")
    edits = parts.mapInArrow(_edits, _EDITS)
    texts = rows.select(F.col("place").alias("_p"), F.col("role").alias("_role"), "text")
    return edits.join(texts, F.col("place") == F.col("_p"), "left").select(
        "conv", "position", F.coalesce("role", "_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` (conv_id, turn, role, text) to the report, one row per conversation that has turns (conv,
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired turns."""
    rows = ordered_turns(turns)
    found = written(faults(rows), "faults")
    whole, slices = audits(rows, found)
    report = found.join(whole.withColumnRenamed("conv", "_c"), F.col("conv") == F.col("_c")).select(
        "conv", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return report, repaired_turns(rows, slices)


# --- what the query adds ------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """The turns damaged by crc32(``conv_id:turn``) % 20: 0 drops a turn, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"),
                        (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("_d")).where("_d <> 0")
    d = F.col("_d")
    text = F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(d == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


_DIGEST = "conv string, sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to one SHA-256 per conversation, carried from turn to turn."""
    conv, h = None, None
    schema = _fields(_DIGEST)
    for b in batches:
        out = []
        for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if c != conv:
                if h is not None:
                    out.append({"conv": conv, "sha256": h.hexdigest()})
                conv, h = c, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if h is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "sha256": h.hexdigest()}], schema=schema)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) over a conversation's ``role:text``, joined by newlines. A digest reads its conversation
    in order; the turns stream through, none is held."""
    rows = repaired.select("conv", "role", "text", "position").repartition("conv").sortWithinPartitions("conv", "position")
    return rows.select("conv", "role", "text").mapInArrow(_digest, _DIGEST)


def report_all(turns: DataFrame) -> DataFrame:
    """Damage, repair and digest of every conversation of ``turns``, those left without turns included."""
    report, repaired = repair(damage(turns))
    every = turns.select("conv_id").distinct().withColumn("_conv", _key(F.col("conv_id")))
    both = every.join(report.drop("conv_id"), F.col("_conv") == F.col("conv"), "left").join(
        digests(repaired).withColumnRenamed("conv", "_c"), F.col("_conv") == F.col("_c"), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256().hexdigest()
    return both.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(none)).alias("repaired_sha256"))
