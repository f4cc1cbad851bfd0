"""Repair of conversation structure at the least cost, by a dynamic program over runs of equal symbols.

A row's symbol says what may be done with it: its role's initial (s, u, a, other) and whether its text is truncated, or
that it must go (blank, duplicate). What may happen at a symbol is a min-plus matrix over the four states of
`(s?(ua)+)?`: nothing yet, after s, after u, after a. Equal consecutive symbols are collapsed into runs, and a run of n
rows is advanced by the cached binary powers of its symbol's matrix. The costs that remain after every run are carried
backwards; then the choices are unrolled forwards, the ASCII-least letter that keeps the least cost first, again by
halves of binary powers whose letters are cached.

Matrices compose, so a conversation of any length is cut into segments that work apart: rows are put in order by
range partitions and cut into blocks of BLOCK rows; a segment is a conversation's part of a block. Only one matrix a
segment meets in one place, where the remaining costs are carried. The audit of a segment is then found for each of the
four states it may begin in, and the true ones are chained. Equal rows of one turn are one record with a count from
the start. The digest of a repaired conversation is sequential by nature: its rows stream through one task in order,
which keeps no text.

Defined cases: a null conv_id, turn, role or text counts as one space (a null conv_id is a conversation of its own and
is returned as null); null turns come first; rows of one turn are in the order of role and text; a row that is both
blank and a duplicate is blank; a conversation without rows after the damage has zeros, an empty audit and the digest of
the empty string; an empty table gives an empty result; other columns, whatever their names, are left out of the
analysis.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import join_spread
from tallyglass.plans.staging import stage

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block.
BLOCK_BITS = 16

BLANK_PATTERN = r"[^\x20\x09-\x0D]"
ENDED_PATTERN = r"[.!?][\x20\x09-\x0D]*\z"

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn put behind a state, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: 0 must go; 1 to 4 are s, u, a, other; 5 to 8 the same with a truncated text.
KEEPS = {1: {NOTHING: SYSTEM}, 2: dict.fromkeys((NOTHING, SYSTEM, ASSISTANT), USER), 3: {USER: ASSISTANT}, 4: {}}
NEVER = 1 << 60

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def times(left: Matrix, right: Matrix) -> Matrix:
    columns = tuple(zip(*right, strict=True))
    return tuple(tuple(min(NEVER, *(a + b for a, b in zip(row, col, strict=True))) for col in columns) for row in left)


def applied(matrix: Matrix, vector: Vector) -> Vector:
    return tuple(min(a + b for a, b in zip(row, vector, strict=True)) for row in matrix)


def _inserting() -> Matrix:
    rows = []
    for state in range(4):
        costs, at = [NEVER] * 4, state
        for inserted in range(3):
            costs[at] = min(costs[at], inserted * INSERT)
            at = NEXT[at]
        rows.append(tuple(costs))
    return tuple(rows)


IDENTITY: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
INSERTING = _inserting()
#: Costs that remain behind the last row.
END: Vector = applied(INSERTING, (0, NEVER, NEVER, 0))


def moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of the edits of one row, in the order of their letters."""
    out = [("D", state, DELETE)]
    if symbol:
        late = TRUNCATED if symbol > 4 else 0
        kept = KEEPS[(symbol - 1) % 4 + 1].get(state)
        if kept is not None:
            out.append(("K", kept, late))
        out.append(("R", NEXT[state], REROLE + late))
    return out


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The transition of 2^k rows of a symbol; insertions come before each row."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    row = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, after, cost in moves(symbol, state):
            row[state][after] = min(row[state][after], cost)
    return times(INSERTING, tuple(map(tuple, row)))


def _bits(length: int) -> list[int]:
    return [k for k in range(length.bit_length()) if length >> k & 1]


def transition(runs: Iterable[tuple[int, int]]) -> Matrix:
    """The matrix of all runs (symbol, length) in order."""
    whole = None
    for symbol, length in runs:
        for k in _bits(length):
            whole = power(symbol, k) if whole is None else times(whole, power(symbol, k))
    return IDENTITY if whole is None else whole


def _relative(costs: Vector) -> Vector:
    least = min(costs)
    return tuple(c - least for c in costs)


@lru_cache(maxsize=4096)
def _letters(symbol: int, k: int, state: int, after: Vector) -> tuple[str, int]:
    """The edits of 2^k rows of a symbol from a state, given the costs that remain behind them; and the last state."""
    if k:
        between = _relative(applied(power(symbol, k - 1), after))
        first, middle = _letters(symbol, k - 1, state, between)
        second, last = _letters(symbol, k - 1, middle, after)
        return first + second, last
    before, inserted = applied(power(symbol, 0), after), ""
    while True:
        options = {letter: (to, cost + after[to]) for letter, to, cost in moves(symbol, state)}
        options["I"] = (NEXT[state], INSERT + before[NEXT[state]])
        letter = next(x for x in "DIKR" if x in options and options[x][1] == before[state])
        state = options[letter][0]
        if letter != "I":
            return inserted + letter, state
        inserted += letter


def unrolled(runs: list[tuple[int, int]], state: int, after: Vector, last: bool) -> tuple[str, int]:
    """The ASCII-least cheapest edits of the runs from a state, and the state behind them."""
    pieces, costs = [], _relative(after)
    for symbol, length in reversed(runs):
        for k in reversed(_bits(length)):
            pieces.append((symbol, k, costs))
            costs = _relative(applied(power(symbol, k), costs))
    out = []
    for symbol, k, behind in reversed(pieces):
        letters, state = _letters(symbol, k, state, behind)
        out.append(letters)
    while last and state not in (NOTHING, ASSISTANT):
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


# ---------------------------------------------------------------- rows and segments


def _key(column: str):
    """A conversation's id as text that tells null apart."""
    return F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def damage(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text, copies): the rows after the damage that a row's id and turn decide."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(
        _key("conv_id").alias("key"),
        F.col("turn").cast("long").alias("turn"),
        space("role").alias("role"),
        space("text").alias("text"),
        kind.alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter("kind <> 0").select(
        "key",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def intact(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of `damage`, to repair what is broken already."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    turn = F.col("turn").cast("long").alias("turn")
    return conversations.select(_key("conv_id").alias("key"), turn, space("role").alias("role"), space("text").alias("text"), F.lit(1).cast("long").alias("copies"))


def in_order(rows: DataFrame) -> DataFrame:
    """Records of equal rows with their place `at` in the order of the whole table, written once."""
    records = rows.groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    lead = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = records.repartitionByRange(*lead, F.substring("text", 1, 32)).sortWithinPartitions(*lead, "text")
    return stage(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")


def judged(ordered: DataFrame) -> DataFrame:
    """Every record's faults: blank, later (its role and text came before), truncated; and its symbol and initial."""
    narrow = ordered.select(
        "key",
        "turn",
        "role",
        "at",
        "copies",
        F.sha2("text", 256).alias("digest"),
        (~F.col("text").rlike(BLANK_PATTERN)).alias("blank"),
        (~F.col("text").rlike(ENDED_PATTERN)).alias("open"),
    )
    first = narrow.groupBy("key", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    seen = join_spread(narrow, stage(first, "first"), ["key", "role", "digest"], "n", "left")
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 1, "u", 2, "a", 3)]), F.substring("role", 1, 1)), F.lit(4))
    return seen.select(
        "key",
        "turn",
        "at",
        "copies",
        "blank",
        (~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))).alias("later"),
        "open",
        initial.alias("initial"),
    ).withColumn("symbol", F.when(F.col("blank") | F.col("later"), 0).otherwise(F.col("initial") + F.when(F.col("open"), 4).otherwise(0)))


LEGAL = {(1, 2), (2, 3), (3, 2)}
SEGMENTS = "key string, at long, runs array<long>, matrix array<long>, illegal long, first int, last int"


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs, matrix and inner illegal pairs of every segment; rows come in order, a block in one task."""
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    here, out = None, []

    def close():
        runs = [(r[0], r[1]) for r in here["runs"]]
        matrix = [c for row in transition(runs) for c in row]
        out.append((here["key"], here["at"], [n << 4 | s for s, n in runs], matrix, here["illegal"], here["first"], here["last"]))

    def add(symbol, n):
        if here["runs"] and here["runs"][-1][0] == symbol:
            here["runs"][-1][1] += n
        elif n:
            here["runs"].append([symbol, n])

    for batch in batches:
        for key, at, copies, symbol, initial in zip(*(batch[c] for c in ("key", "at", "copies", "symbol", "initial")), strict=True):
            if here is None or here["key"] != key or here["at"] >> BLOCK_BITS != at >> BLOCK_BITS:
                if here:
                    close()
                here = {"key": key, "at": int(at), "runs": [], "illegal": 0, "first": int(initial), "last": None}
            if here["last"] is not None and (here["last"], initial) not in LEGAL:
                here["illegal"] += 1
            here["last"] = int(initial)
            here["illegal"] += int(copies) - 1
            add(int(symbol), 1)
            add(0, int(copies) - 1)
        yield pd.DataFrame(out, columns=names)
        out = []
    if here:
        close()
    yield pd.DataFrame(out, columns=names)


CARRIED = "at long, behind array<long>, cost long, crossing long, last boolean"


def _carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The costs that remain behind every segment, and those of the whole from it on; segments come last first."""
    key, costs, follower = None, END, None
    for batch in batches:
        out = []
        for this, at, flat, first, last in zip(*(batch[c] for c in ("key", "at", "matrix", "first", "last")), strict=True):
            ending = this != key
            if ending:
                key, costs, follower = this, END, None
            flat = [int(c) for c in flat]
            before = applied(tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4)), costs)
            crossing = int(follower is not None and (last, follower) not in LEGAL)
            out.append((at, list(costs), before[NOTHING], crossing, ending))
            costs, follower = before, first
        yield pd.DataFrame(out, columns=["at", "behind", "cost", "crossing", "last"])


AUDITED = "key string, at long, audits array<string>, ends array<int>, cost long, illegal long"


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of every segment from each of the four states."""
    for batch in batches:
        out = []
        columns = ("key", "at", "runs", "behind", "last_one", "cost", "illegal", "crossing")
        for key, at, runs, behind, last, cost, illegal, crossing in zip(*(batch[c] for c in columns), strict=True):
            pairs = [(int(r) & 15, int(r) >> 4) for r in runs]
            found = [unrolled(pairs, state, tuple(int(c) for c in behind), bool(last)) for state in range(4)]
            out.append((key, at, [f[0] for f in found], [f[1] for f in found], cost, illegal + crossing))
        yield pd.DataFrame(out, columns=["key", "at", "audits", "ends", "cost", "illegal"])


REPAIRED = "key string, cost long, illegal long, audit string, repaired_sha256 string"


class _Conversation:
    """One conversation while its rows pass."""

    def __init__(self, key: str, cost: int):
        self.key, self.cost, self.illegal = key, int(cost), 0
        self.state, self.at, self.entry = NOTHING, 0, NOTHING
        self.audit: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def segment(self, audits, ends, illegal) -> None:
        self.flush()
        self.audit.append(audits[self.entry])
        self.at, self.entry = 0, int(ends[self.entry])
        self.illegal += int(illegal)

    def line(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def inserted(self) -> None:
        piece = self.audit[-1]
        while self.at < len(piece) and piece[self.at] == "I":
            self.state = NEXT[self.state]
            self.line(ROLES[self.state], "")
            self.at += 1

    def flush(self) -> None:
        """What is inserted behind the last row."""
        if self.audit:
            self.inserted()

    def record(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.inserted()
            letter = self.audit[-1][self.at]
            self.at += 1
            if letter == "K":
                self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                self.line(role, text)
            elif letter == "R":
                self.state = NEXT[self.state]
                self.line(ROLES[self.state], text)

    def result(self) -> tuple:
        self.flush()
        return self.key, self.cost, self.illegal, "".join(self.audit), self.hash.hexdigest()


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chains the segments' edits and hashes the repaired rows as they pass; a segment comes before its rows."""
    names, here = [c.split()[0] for c in REPAIRED.split(", ")], None
    for batch in batches:
        out = []
        columns = ("key", "audits", "ends", "cost", "illegal", "role", "text", "copies")
        for key, audits, ends, cost, illegal, role, text, copies in zip(*(batch[c] for c in columns), strict=True):
            if audits is not None:
                if here is None or here.key != key:
                    if here:
                        out.append(here.result())
                    here = _Conversation(key, cost)
                here.segment(audits, ends, illegal)
            else:
                here.record(role, text, int(copies))
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame([here.result()] if here else [], columns=names)


def repair(conversations: DataFrame, prepare=damage) -> DataFrame:
    """One row for every conv_id: its faults, the least cost of repair, the edits and the digest of what they give."""
    ordered = in_order(prepare(conversations))
    records = stage(judged(ordered), "symbols")
    block = F.shiftright("at", BLOCK_BITS)
    placed = records.select("key", "at", "copies", "symbol", "initial").repartition(block).sortWithinPartitions("at")
    segments = stage(placed.mapInPandas(_segments, SEGMENTS), "segments")
    ends = segments.select("key", "at", "matrix", "first", "last").repartition("key").sortWithinPartitions("key", F.desc("at"))
    carried = ends.mapInPandas(_carried, CARRIED).withColumnRenamed("last", "last_one")
    audited = segments.join(carried, "at").mapInPandas(_audited, AUDITED)
    none = lambda kind: F.lit(None).cast(kind)
    heads = audited.select("key", "at", F.lit(0).alias("row"), "audits", "ends", "cost", "illegal", none("string").alias("role"), none("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    rows = ordered.select("key", "at", F.lit(1).alias("row"), none("array<string>").alias("audits"), none("array<int>").alias("ends"), F.lit(0).cast("long").alias("cost"), F.lit(0).cast("long").alias("illegal"), "role", "text", "copies")
    streamed = heads.unionByName(rows).repartition("key").sortWithinPartitions("key", "at", "row").drop("at", "row")
    repaired = streamed.mapInPandas(_repaired, REPAIRED)
    later = F.when(F.col("later"), F.col("copies")).otherwise(F.col("copies") - 1)
    cut = (~F.col("blank") & ~F.col("later") & F.col("open")).cast("long")
    a_turn = records.groupBy("key", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(later)).alias("duplicate"),
        F.sum(cut).alias("truncated"),
    )
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    faults = a_turn.groupBy("key").agg(
        (F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count("turn")).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    kind = conversations.schema["conv_id"].dataType
    original = conversations.select(_key("conv_id").alias("key")).distinct()
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        original.join(faults, "key", "left")
        .join(repaired, "key", "left")
        .select(
            F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias("conv_id"),
            *counts,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
        )
    )
