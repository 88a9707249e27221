"""Conversation repair: the search against a plain table of least audits and against every audit of
short conversations; the whole query against the contract in plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from spanlake.llm import conversation_repair as cr
from spanlake.llm import queries

SF = "/root/testdata/sf0.001"
ROW = "conv_id long, turn long, role string, text string"


def least(rows):
    """(cost, audit, repaired) of rows (role, text, must go, truncated), by states of the role pattern:
    rounds of relaxation over (rows done, roles so far as a state), least (cost, audit) each."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(0, ""): (0, "", ())}
    todo = [(0, "")]
    while todo:
        i, state = todo.pop()
        cost, audit, out = best[i, state]
        nexts = [(i, step[state, r[0]], cost + 2, audit + "I", out + ((r, ""),)) for r in ("user", "assistant") if (state, r[0]) in step]
        if i < len(rows):
            role, text, gone, cut = rows[i]
            nexts.append((i + 1, state, cost + 3, audit + "D", out))
            if not gone:
                if (state, role[:1]) in step:
                    nexts.append((i + 1, step[state, role[:1]], cost + cut, audit + "K", out + ((role, text),)))
                nexts += [(i + 1, step[state, r[0]], cost + 2 + cut, audit + "R", out + ((r, text),)) for r in ("user", "assistant") if (state, r[0]) in step]
        for j, s, c, a, o in nexts:
            if (j, s) not in best or (c, a) < best[j, s][:2]:
                best[j, s] = c, a, o
                todo.append((j, s))
    return min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)


def contract(turns):
    """{conv_id: the query's columns} over (conv_id, turn, role, text)."""
    out = {}
    space = lambda x: " " if x is None else x
    for conv in {t[0] for t in turns}:
        rows = []
        for c, turn, role, text in turns:
            if c == conv:
                d = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20
                role, text = "user" if d == 4 else space(role), space(text)
                text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
                rows += [(turn is not None, turn or 0, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        rows.sort()
        numbers = [r[1] for r in rows if r[0]]
        blank = duplicate = truncated = 0
        seen, lattice = set(), []
        for _, _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            is_blank, is_twice = not body, (role, text) in seen
            is_cut = not is_blank and not is_twice and body[-1] not in ".!?"
            blank, duplicate, truncated = blank + is_blank, duplicate + (is_twice and not is_blank), truncated + is_cut
            seen.add((role, text))
            lattice.append((role, text, is_blank or is_twice, is_cut))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, fixed = least(lattice)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha)
    return out


def steps_of(rows):
    return [(role[:1], int(not gone), int(gone), cut) for role, _, gone, cut in rows]


def test_search_gives_the_least_cheapest_audit():
    rng = random.Random(7)
    for _ in range(600):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "user"]), "x", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 12))]
        rows = [(r, t, g, c and not g) for r, t, g, c in rows]
        assert cr.cheapest(steps_of(rows), cr.START, cr.ACCEPTED) == least(rows)[:2], rows


def test_against_every_audit_of_short_conversations():
    """All strings of edits up to a length, kept if they are legal, priced one by one."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for roles in itertools.chain.from_iterable(itertools.product("suat", repeat=n) for n in range(4)):
        for cuts in itertools.product((False, True), repeat=len(roles)):
            best = None
            for size in range(len(roles), len(roles) + 4):
                for audit in itertools.product("DIKR", repeat=size):
                    state, i, cost = "", 0, 0
                    for e in audit:
                        given = next((x for x in "ua" if (state, x) in step), None)
                        if e == "I":
                            state, cost = step[state, given], cost + 2
                            continue
                        if i == len(roles):
                            break
                        to = state if e == "D" else step.get((state, roles[i])) if e == "K" else step[state, given]
                        if to is None:
                            break
                        cost += {"D": 3, "K": cuts[i], "R": 2 + cuts[i]}[e]
                        state, i = to, i + 1
                    else:
                        if i == len(roles) and state in ("", "a") and (best is None or (cost, "".join(audit)) < best):
                            best = cost, "".join(audit)
            assert cr.cheapest([(r, 1, 0, c) for r, c in zip(roles, cuts)], cr.START, cr.ACCEPTED) == best


def got_rows(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r for r in rows}


def test_query_equals_the_contract(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = contract(turns)
    assert got_rows(queries.op11_conversation_repair(spark, SF)) == want and any(w[6] for w in want.values())


@pytest.mark.parametrize("segment", [2048, 3])
def test_odd_conversations(spark, segment, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "no", "", " \n\t", None, "Why? ", "wait!\r\n", "long " * 3000 + ".", "é。"]
    turns = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(40) for _ in range(rng.randint(1, 9))]
    turns += [(None, i, "user", "Hi.") for i in range(3)] + [(77, 1, "user", "same.")] * 400 + [(78, i, ["user", "assistant"][i % 2], f"t{i}.") for i in range(300)]
    turns += [(79, None, "user", "all null.")] * 2 + [(c, 0, "user", "Alone.") for c in range(100, 160)]  # some lose their only turn
    df = spark.createDataFrame(turns, ROW).withColumn("conv", F.lit("clash")).withColumn("place", F.lit(1)).withColumn("n", F.lit(5))
    want = contract(turns)
    assert any(w[7] == "" and w[6] == 0 for w in want.values())
    assert got_rows(cr.report_all(df)) == want


def test_empty_table(spark):
    assert cr.report_all(spark.createDataFrame([], ROW)).count() == 0


def test_repaired_turns_are_real(spark):
    turns = [(1, 0, "assistant", "Late."), (1, 1, "user", "Why?"), (1, 2, "user", "So"), (2, 0, "system", "Be kind."), (2, 1, "user", "Hi."), (2, 2, "assistant", "Hello.")]
    report, fixed = cr.repair(spark.createDataFrame(turns, ROW))
    got = {r.conv_id: (r.cost, r.audit) for r in report.collect()}
    rows = {c: [(r.role, r.text, r.edit) for r in sorted(fixed.collect(), key=lambda r: r.position) if r.conv == str(c)] for c in (1, 2)}
    assert got[2] == (0, "KKK") and rows[2] == [("system", "Be kind.", "K"), ("user", "Hi.", "K"), ("assistant", "Hello.", "K")]
    want = least([("assistant", "Late.", False, False), ("user", "Why?", False, False), ("user", "So", False, True)])
    assert got[1] == want[:2] and [(r, t) for r, t, _ in rows[1]] == list(want[2])
