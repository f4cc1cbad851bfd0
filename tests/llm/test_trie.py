"""The prefix trie against a plain dictionary of all prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import trie

ROWS = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r[2], r[3]) for r in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, mine in said.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        remainder = c % 5 if c >= 0 else -(-c % 5)
        whole[c] = [*said.get(c - remainder, [])[:h], *mine[h:]]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, m in members.items():
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(p))
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], digest))
    return out


def made(spark, rows, **more):
    got = [tuple(r) for r in trie.trie(spark.createDataFrame(rows, ROWS), **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_the_whole_table_equals_the_plain_form(spark, data):
    conversations = spark.read.parquet(f"{data}/conversations.parquet")
    got = {tuple(r) for r in trie.trie(conversations).collect()}
    assert got == plain([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])


def branching():
    """Copies, prefixes of others, and branches at, before and behind block borders."""
    rows = []
    for c in range(40):
        for t in range((c * 7) % 23 + (1 if c % 9 else 0)):
            branch = c // 8 if t >= 16 else c % 3 if t >= 9 else c // 20 if t >= 8 else 0
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"{'é' * (t % 4)}{t}.{branch}"))
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_branches_at_all_places(spark, rebuild):
    assert made(spark, branching(), rebuild=rebuild) == plain(branching(), rebuild)


def test_a_ladder_of_prefixes_and_a_hub(spark):
    ladder = [(c, t, "user", f"t{t}") for c in range(30) for t in range(30 - c)]
    comb = [(100 + c, t, "user", f"t{t}" if t < c else f"own {c}") for c in range(20) for t in range(c + 2)]
    hub = [(1000 + c, t, "user", "hello" if t == 0 else f"{c}") for c in range(60) for t in range(2)]
    rows = ladder + comb + hub
    assert made(spark, rows, rebuild=False) == plain(rows, False)


def test_small_stretches_give_the_same(spark, monkeypatch):
    for name in ("BLOCK_BITS", "STRETCH_BITS", "NODE_BITS"):
        monkeypatch.setattr(trie, name, 1)
    monkeypatch.setattr(trie, "PIECE_IDS", 2)
    rows = branching() + [(200 + k, 0, "user", "same") for k in range(25)]
    assert made(spark, rows, rebuild=False) == plain(rows, False)


def test_nulls_ties_repeats_negative_ids_and_other_columns(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "assistant", "b"), (6, 1, "user", "a" * 70_000)]
    rows += [(-7, 1, "user", "a"), (-5, 0, "u", "b"), (-5, 1, "", ""), (2**62, 3, "user", None), (0, 0, "user", "x"), (-4, 0, "user", "x"), (4, 0, "user", "x")]
    rows += [(c, t, "ab" if t else "a", "c" if t else "bc") for c in (10, 11, 12, 13, 14) for t in range(3)]
    frame = spark.createDataFrame(rows, ROWS).withColumns({"c": F.lit("x"), "d": F.lit(None).cast("long"), "n": F.lit(1), "place": F.lit(2)})
    assert {tuple(r) for r in trie.trie(frame).collect()} == plain(rows)


def test_empty_table(spark):
    assert trie.trie(spark.createDataFrame([], ROWS)).collect() == []


def test_only_parted_blocks_are_refined(spark, monkeypatch):
    """Copies never meet turn by turn."""
    rows = [(c, t, "user", f"t{t}") for c in range(20) for t in range(24)]
    seen = {}
    wrapped = trie.stage
    monkeypatch.setattr(trie, "stage", lambda df, tag="stage": seen.setdefault(tag, wrapped(df, tag)))
    assert made(spark, rows, rebuild=False) == plain(rows, False)
    assert seen["refined"].count() == 0
