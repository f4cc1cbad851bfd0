"""Conversation repair against a plain search over all edits."""

import hashlib
import re
import zlib
from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.llm import repair

ROWS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) by a shortest path over (row, role sequence's state), with the audit as the tie-break."""
    best = {}

    def go(i, state):
        if (i, state) in best:
            return best[i, state]
        best[i, state] = (10**9, "~", ())
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            role, text, must, cut = rows[i]
            c, a, x = go(i + 1, state)
            found.append((c + 2, "D" + a, x))
            forced = "a" if state == "u" else "u"
            if not must:
                late = 5 * cut
                initial = role[:1]
                if initial == forced or (initial == "s" and state == ""):
                    c, a, x = go(i + 1, initial)
                    found.append((c + late, "K" + a, ((role, text), *x)))
                c, a, x = go(i + 1, forced)
                found.append((c + 1 + late, "R" + a, (({"a": "assistant", "u": "user"}[forced], text), *x)))
        # at most two turns are ever put in a row
        for n in (1, 2):
            to, put = state, []
            for _ in range(n):
                to = "a" if to == "u" else "u"
                put.append(({"a": "assistant", "u": "user"}[to], ""))
            for c, a, x in steps(i, to):
                found.append((c + 5 * n, "I" * n + a, (*put, *x)))
        best[i, state] = min(found)
        return best[i, state]

    def steps(i, state):
        """The ways on that begin with a row, or end."""
        if i == len(rows):
            return [(0, "", ())] if state in ("", "a") else []
        role, text, must, cut = rows[i]
        c, a, x = go(i + 1, state)
        out = [(c + 2, "D" + a, x)]
        forced = "a" if state == "u" else "u"
        if not must:
            if role[:1] == forced or (role[:1] == "s" and state == ""):
                c, a, x = go(i + 1, role[:1])
                out.append((c + 5 * cut, "K" + a, ((role, text), *x)))
            c, a, x = go(i + 1, forced)
            out.append((c + 1 + 5 * cut, "R" + a, (({"a": "assistant", "u": "user"}[forced], text), *x)))
        return out

    return go(0, "")


def plain(rows):
    """The contract, row by row, for (conv_id, turn, role, text) rows."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        s = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            mine += [(turn is not None, turn or 0, "user" if kind == 4 else role, text, turn)] * (2 if kind == 3 else 1)
    result = set()
    for conv, mine in out.items():
        mine.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text, _ in mine:
            bare = text.strip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[4] for r in mine if r[4] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[0][:1] for r in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
        result.add((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return result


def test_the_whole_table_equals_the_plain_form(spark, data):
    conversations = spark.read.parquet(f"{data}/conversations.parquet")
    got = {tuple(r) for r in repair.repair(conversations).collect()}
    assert got == plain([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])


def awkward():
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    said = ["Yes.", "No", "", " \t", None, "Well?  ", "Yes.", "Ünd!\n", "x" * 50_000 + "."]
    rows = []
    for conv in [*range(12), None, -3, 2**62]:
        for k in range(9 if conv != 5 else 60):
            h = zlib.crc32(f"{conv}/{k}".encode())
            turn = None if h % 11 == 0 else k // 2 if h % 3 == 0 else k * (1 if h % 7 else 3)
            rows.append((conv, turn, roles[h // 13 % len(roles)], said[h // 101 % len(said)]))
    return [*rows, *rows[:20]]


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = awkward()
    frame = spark.createDataFrame(rows, ROWS).withColumns({"key": F.lit("x"), "at": F.lit(None).cast("long"), "cost": F.lit(1)})
    got = [tuple(r) for r in repair.repair(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_segments_of_a_long_conversation_chain(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    roles = ["user", "assistant", "user", "user", "assistant", "system"]
    rows = [(7, t, roles[zlib.crc32(b"%d" % t) % 6], f"Turn {t % 31}" + ("." if t % 5 else "")) for t in range(300)] + [(8, 1, "user", "Hi.")]
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    assert {tuple(r) for r in repair.repair(frame).collect()} == plain(rows)


def test_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], ROWS)).collect() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=14))
def test_runs_by_powers_equal_the_search(symbols):
    rows = [("xsuao"[(s - 1) % 4 + 1] if s else "x", "t", s == 0, s > 4) for s in symbols]
    runs = [(s, len(list(g))) for s, g in groupby(symbols)]
    cost, audit, _ = cheapest(rows)
    assert repair.applied(repair.transition(runs), repair.END)[repair.NOTHING] == cost
    assert repair.unrolled(runs, repair.NOTHING, repair.END, True)[0] == audit


def test_a_million_equal_rows_are_one_run():
    audit, _ = repair.unrolled([(2, 1_000_000)], repair.NOTHING, repair.END, True)
    assert len(audit) == 1_000_000 and audit.count("D") == 0 and audit.count("R") == 500_000
