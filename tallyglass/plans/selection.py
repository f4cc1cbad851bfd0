"""Exact order statistics without sorting the table or holding it in one task.

`select_ranks` narrows a value bracket around each wanted rank. A first pass takes an equi-depth
sketch of each column, which gives the first brackets; every further pass counts the rows below, at
and inside the brackets, so it checks the one before, and sketches the rows inside where they are
still many. State is bounded by the sketch, never by the data. A value that holds a third of all
rows ends up on a bracket edge, where its count settles the rank. Only the last few rows inside a
bracket are ranked directly.

On top of it sit exact quantiles of columns; those of groups have brackets that are tables.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import clean
from tallyglass.plans.ordered import running_sums
from tallyglass.plans.staging import stage

# Size of a group's sketch, and how far from a wanted rank its bracket reaches, as a part of the group.
SKETCH, MARGIN = 512, 0.015
# Rows left inside a bracket before they are ranked directly.
FINAL_ROWS = 100_000
GRID = 200
# Size of a column's sketch: its ranks err by an eighth of a percent at most (99 % sure), a quarter of a grid step.
GRID_SKETCH = 4096
# Rounds of narrowing; a sound sketch needs a dozen for 10**12 rows.
MOST_ROUNDS = 100
ACCURACY = 2000
# Aggregates per pass that still compile into one stage.
FIELDS_PER_PASS = 96

_STEPS = [i / GRID for i in range(GRID + 1)]


@dataclass
class Target:
    """Ranks wanted from one column (or one group of it) of n values, and what is known so far."""

    n: int
    ranks: tuple[int, ...]
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    inside: int | None = None

    def __post_init__(self):
        self.inside = self.n if self.inside is None else self.inside
        self.found: dict[int, tuple[float, int, int]] = {}
        self.outer = (None, None, 0, self.n)
        # Grid steps taken on either side of a rank; more after a sketch that missed.
        self.slack = 1

    @property
    def want(self) -> list[int]:
        """Open ranks counted from the start of the bracket."""
        return [r - self.below for r in self.open]

    @property
    def open(self) -> list[int]:
        return [r for r in self.ranks if r not in self.found]

    def narrow(self, grid: Sequence[float]) -> None:
        """The grid steps around the open ranks become the bracket; `inside` is then an estimate."""
        self.outer = (self.lo, self.hi, self.below, self.inside)
        first = int((self.open[0] - self.below + 0.5) / self.inside * GRID) - self.slack
        last = int((self.open[-1] - self.below + 0.5) / self.inside * GRID) + 1 + self.slack
        self.lo = grid[first] if first >= 0 else self.lo
        self.hi = grid[last] if last <= GRID else self.hi
        self.inside = int(self.inside * min(1, (last - first + 1) / GRID))

    def check(self, lt_lo: int, le_lo: int, lt_hi: int, le_hi: int) -> bool:
        """Takes the counts at the bracket edges; false where an open rank lies outside."""
        for r in self.open:
            if self.lo is not None and lt_lo <= r < le_lo:
                self.found[r] = (self.lo, lt_lo, le_lo - lt_lo)
            elif self.hi is not None and lt_hi <= r < le_hi:
                self.found[r] = (self.hi, lt_hi, le_hi - lt_hi)
        rest = self.open
        self.below, self.inside = le_lo, max(lt_hi - le_lo, 0)
        if all(le_lo <= r < lt_hi for r in rest):
            return True
        self.slack = min(2 * self.slack, GRID // 3)
        # The sketch missed. The counts still cut the bracket it was taken in, on the side where the ranks lie, so
        # every round leaves fewer rows.
        lo, hi, below, inside = self.outer
        upper = below + inside
        if max(rest) < le_lo:
            hi, upper = self.lo, lt_lo
        elif min(rest) >= lt_hi:
            lo, below = self.hi, le_hi
        elif min(rest) >= le_lo:
            lo, below = self.lo, le_lo
        elif max(rest) < lt_hi:
            hi, upper = self.hi, lt_hi
        self.lo, self.hi, self.below, self.inside = lo, hi, below, upper - below
        return False


class _Columns:
    """Targets on columns of one table; brackets are literals, and counts compile to plain code."""

    def __init__(self, df: DataFrame, values: dict[Hashable, Column]):
        self.df, self.values = df, {t: v.cast("double") for t, v in values.items()}

    def _inside(self, t: Hashable, target: Target) -> Column:
        x, test = self.values[t], F.lit(True)
        if target.lo is not None:
            test = test & (x > target.lo)
        if target.hi is not None:
            test = test & (x < target.hi)
        return test & x.isNotNull()

    def sketch(self, targets: dict[Hashable, Target]) -> dict[Hashable, Sequence[float]]:
        inside = {t: self._inside(t, g) for t, g in targets.items()}
        steps = F.array(*[F.lit(s) for s in _STEPS])
        # Rows outside of all brackets need not reach the sketches.
        row = self.df.filter(reduce(Column.__or__, inside.values())).agg(
            *[
                F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.when(inside[t], self.values[t]), GRID_SKETCH), steps).alias(f"g{i}")
                for i, t in enumerate(targets)
            ]
        ).first()
        return {t: row[f"g{i}"] for i, t in enumerate(targets)}

    def count(self, targets: dict[Hashable, Target]) -> dict[Hashable, tuple[int, int, int, int]]:
        names, out = list(targets), {}
        for at in range(0, len(names), FIELDS_PER_PASS // 4):
            batch, cells = names[at : at + FIELDS_PER_PASS // 4], []
            for t in batch:
                x, g = self.values[t], targets[t]
                none, every = F.lit(0).cast("long"), F.lit(g.n).cast("long")
                cells += [
                    none if g.lo is None else F.count_if(x < g.lo),
                    none if g.lo is None else F.count_if(x <= g.lo),
                    every if g.hi is None else F.count_if(x < g.hi),
                    every if g.hi is None else F.count_if(x <= g.hi),
                ]
            row = self.df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
            out.update({t: tuple(row[4 * i : 4 * i + 4]) for i, t in enumerate(batch)})
        return out

    def rows_inside(self, targets: dict[Hashable, Target]) -> DataFrame:
        cells, kept = [], F.lit(False)
        for t, g in targets.items():
            test = self._inside(t, g)
            kept = kept | test
            want = F.array(*[F.lit(w).cast("long") for w in g.want])
            cells.append(F.when(test, F.struct(F.lit(t).alias("tid"), self.values[t].alias("x"), want.alias("want"))))
        return self.df.filter(kept).select(F.inline(F.array(*cells))).filter(F.col("tid").isNotNull())


def select_ranks(source: _Columns, targets: dict[Hashable, Target]) -> None:
    """Fills `found` of every target: rank -> (value, rows below it, rows at it)."""
    busy = dict(targets)
    for _ in range(MOST_ROUNDS):
        large = {t: g for t, g in busy.items() if g.open and g.inside > FINAL_ROWS}
        if not large:
            break
        grids = source.sketch(large)
        for t, g in large.items():
            g.narrow(grids[t])
        counts = source.count(large)
        for t, g in large.items():
            g.check(*counts[t])
    else:
        raise RuntimeError(f"no bracket of at most {FINAL_ROWS} rows after {MOST_ROUNDS} rounds: the sketches contradict the counts")

    last = {t: g for t, g in busy.items() if g.open}
    if not last:
        return
    # The bracket of a target holds at most FINAL_ROWS rows by now.
    rows = source.rows_inside(last).groupBy("tid").agg(
        F.sort_array(F.collect_list("x")).alias("xs"), F.first("want").alias("want")
    )
    hits = rows.select("tid", "xs", F.explode("want").alias("want")).withColumn("x", F.get("xs", F.col("want")))
    for row in hits.select(
        "tid",
        "want",
        "x",
        (F.array_position("xs", F.col("x")) - 1).alias("before"),
        F.size(F.filter("xs", lambda v: v == F.col("x"))).alias("same"),
    ).collect():
        g = last[row["tid"]]
        g.found[row["want"] + g.below] = (row["x"], g.below + row["before"], row["same"])


def _ranks(n: int, prob: float) -> tuple[int, int, float]:
    place = prob * (n - 1)
    low = math.floor(place)
    return low, min(low + 1, n - 1), place - low


def _between(target: Target, low: int, high: int, part: float) -> float:
    a, b = target.found[low][0], target.found[high][0]
    return a + (b - a) * part


def exact_quantiles(
    df: DataFrame, probs: dict[str, Sequence[float]], exact: bool = True
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns; NULL and NaN are left out."""
    names = list(probs)
    if not names:
        return {}
    value = {c: clean(df, c).cast("double") for c in names}
    pick = lambda row: {c: list(row[c]) if row[c] else [None] * len(probs[c]) for c in names}
    if not exact:
        return pick(df.agg(*[F.percentile_approx(value[c], list(probs[c]), ACCURACY).alias(c) for c in names]).first())
    counts = df.agg(*[F.count(value[c]).alias(c) for c in names]).first()
    filled = [c for c in names if counts[c]]
    if not filled:
        return {c: [None] * len(probs[c]) for c in names}
    grids = _Columns(df, value).sketch({c: Target(counts[c], ()) for c in filled})
    places = {(c, p): _ranks(counts[c], p) for c in filled for p in probs[c]}
    targets, values = {}, {}
    for c in filled:
        for p in probs[c]:
            low, high, _ = places[c, p]
            tid = f"{names.index(c)}:{p}"
            targets[tid], values[tid] = Target(counts[c], tuple(sorted({low, high}))), value[c]
            targets[tid].narrow(grids[c])
    source = _Columns(df, values)
    edges = source.count(targets)
    for tid, target in targets.items():
        target.check(*edges[tid])
    select_ranks(source, targets)
    return {
        c: [_between(targets[f"{names.index(c)}:{p}"], *places[c, p]) if c in filled else None for p in probs[c]]
        for c in names
    }


def grouped_quantile(df: DataFrame, keys: Sequence[str], name: str, prob: float, out: str) -> DataFrame:
    """Exact quantile of `name` per group (keys not NULL), also where one group holds most of the rows."""
    keys = list(keys)
    data = df
    for k in keys:
        data = data.filter(clean(df, k).isNotNull())
    # Plain names inside, whatever the keys are called.
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    data = data.select(*[F.col(f"`{k}`").alias(a) for a, k in named.items()], clean(df, name).cast("double").alias("__x"))
    keys = list(named)
    place = F.col("n") * prob - prob
    sketched = data.groupBy(*keys).agg(F.count("__x").alias("n"), F.kll_sketch_agg_double("__x", SKETCH).alias("sketch"))
    sketched = sketched.withColumn("low", F.greatest(F.floor(place), F.lit(0)))
    ranks = sketched.withColumns(
        {"high": F.greatest(F.least(F.col("low") + 1, F.col("n") - 1), F.lit(0)), "part": F.greatest(place - F.col("low"), F.lit(0.0))}
    )
    # A bracket reaches the margin to both sides, which covers the sketch's error and, with three rows, the step to the
    # next rank. It is open at an end of the group, and on both sides where the margin is less than three rows.
    edge = lambda at: F.kll_sketch_get_quantile_double("sketch", F.lit(at)) if 0 < at < 1 else F.lit(None).cast("double")
    wide = F.col("n") * MARGIN >= 3
    brackets = ranks.select(*keys, "n", "low", "high", "part", F.when(wide, edge(prob - MARGIN)).alias("from"), F.when(wide, edge(prob + MARGIN)).alias("to"))
    brackets = stage(brackets, "brackets")
    found = stage(_ranked_in(data, brackets, keys), "found")
    missed = found.filter("n > 0 AND (a IS NULL OR b IS NULL)").select(*keys)
    if missed.limit(1).count():
        # A sketch missed its bracket: all values of these groups are ranked.
        none = F.lit(None).cast("double")
        again = brackets.join(missed, keys).withColumns({"from": none, "to": none})
        found = found.join(missed, keys, "left_anti").unionByName(_ranked_in(data.join(missed, keys), again, keys))
    return found.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(out)).withColumnsRenamed(named)


def _ranked_in(data: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The brackets with the values at their ranks `low` and `high`, NULL where one lies outside of its bracket.

    Equal values merge before they are moved, and so do all below and all above a bracket.
    """
    x = F.col("__x")
    side = F.when(x < F.col("from"), 0).when(x > F.col("to"), 2).otherwise(1)
    placed = data.filter(x.isNotNull()).join(brackets.select(*keys, "low", "high", "from", "to"), keys)
    cells = placed.withColumn("side", side).withColumn("x", F.when(F.col("side") == 1, x))
    cells = cells.groupBy(*keys, "low", "high", "side", "x").agg(F.count("*").alias("rows"))
    summed = running_sums(cells, keys, ["side", "x"], "rows", "upto")
    holds = lambda rank: F.when((F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("rows") <= F.col(rank)), F.col("x"))
    hits = summed.groupBy(*keys).agg(F.max(holds("low")).alias("a"), F.max(holds("high")).alias("b"))
    return brackets.select(*keys, "n", "part").join(hits, keys, "left")


def most_frequent(df: DataFrame, name: str):
    """The most frequent value, the smallest on ties; None for a column without values."""
    return most_frequent_of(df, [name])[name]


def most_frequent_of(df: DataFrame, names: Sequence[str]) -> dict[str, object]:
    """The most frequent value of each column, the smallest on ties; None for a column without values.

    The values of all columns travel as (column, value) in one pass, so frequent ones merge before the shuffle. A
    value takes the field of its own type, and one struct field per type keeps types apart.
    """
    if not names:
        return {}
    kinds = sorted({df.schema[c].dataType.simpleString() for c in names})
    cells = []
    for i, c in enumerate(names):
        value, own = clean(df, c), df.schema[c].dataType.simpleString()
        fields = [(value if k == own else F.lit(None).cast(k)).alias(f"v{j}") for j, k in enumerate(kinds)]
        cells.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("seq"), *fields)))
    values = df.select(F.inline(F.array(*cells))).filter(F.col("seq").isNotNull())
    columns = [f"v{j}" for j in range(len(kinds))]
    counts = values.groupBy("seq", *columns).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("seq").agg(F.min(F.struct((-F.col("n")).alias("o"), *columns)).alias("best")).collect()
    found = dict.fromkeys(names)
    for row in best:
        name = names[row["seq"]]
        found[name] = row["best"][f"v{kinds.index(df.schema[name].dataType.simpleString())}"]
    return found
