"""The first k rows in an order, as an ordinary filter.

The key of row k is searched for by comparison alone, so any type that can be sorted will do. Each round is one pass: it
counts the rows before and at two pivots, samples the rows between them and picks the next two pivots from the sorted
sample, some rows to both sides of where row k should stand. The counts are exact, so a sample can cost a round but no
wrong row. Once the sample is all that lies between the pivots, it holds the key itself. Whatever the size of the table,
one task keeps a sample, and only pivots reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.columns import clean

# Keys in a sample, fewer where they are long texts, and the bytes that a sample may take.
SAMPLE, LEAST_SAMPLE = 4_000, 64
SAMPLE_BYTES = 32 * 2**20
# A sample of 4,000 leaves a sixteenth, so 10**12 rows take eight rounds.
MOST_ROUNDS = 200

Key = tuple[Column | None, ...]


@dataclass
class _Cut:
    """Row k (from 0) lies between two keys, both left out; the pivots of the next round lie between these."""

    k: int
    inside: int
    expected: float
    before: int = 0
    lo: Key | None = None
    hi: Key | None = None
    pivots: tuple[Key | None, Key | None] = (None, None)
    found: Key | None = None


def rank_cuts(df: DataFrame, order_by: Sequence[str], cuts: Callable[[int], Sequence[int]]) -> tuple[int, list[Column]]:
    """Row count n, and for each k in `cuts(n)` a filter that is true for the first k rows in order, missing values last.

    The filter compares with the key of row k, so no row is moved. It is never NULL. `order_by` must tell the rows on
    both sides of a cut apart; a cut through equal keys raises ValueError.
    """
    columns, kinds = [clean(df, c) for c in order_by], [df.schema[c].dataType for c in order_by]
    for c, kind in zip(order_by, kinds):
        if not isinstance(kind, (T.StringType, T.BinaryType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise TypeError(f"cannot order rows by {c} of type {kind.simpleString()}")
    long = [F.max(F.octet_length(c)) for c, kind in zip(columns, kinds) if isinstance(kind, (T.StringType, T.BinaryType))]
    n, *widths = df.agg(F.count(F.lit(1)), *long).first()
    size = max(LEAST_SAMPLE, min(SAMPLE, SAMPLE_BYTES // (64 + sum(w or 0 for w in widths))))
    wanted = list(cuts(n))
    state = {k: _Cut(k, n, n) for k in sorted(set(wanted)) if 0 < k < n}
    for _ in range(MOST_ROUNDS):
        busy = [c for c in state.values() if c.found is None]
        if not busy:
            break
        row = _look(df, columns, kinds, busy, size)
        for i, cut in enumerate(busy):
            if not _narrow(cut, kinds, row[f"c{i}"]):
                raise ValueError(f"order_by {list(order_by)} does not separate the rows around position {cut.k}")
    else:
        raise RuntimeError(f"no key found after {MOST_ROUNDS} rounds: does the table change between its reads?")
    return n, [F.lit(k >= n) if k <= 0 or k >= n else _compare(columns, state[k].found, F.lit(False)) for k in wanted]


def _compare(columns: Sequence[Column], key: Key, at: bool | Column) -> Column:
    """Whether a row's key comes before the given one, and `at` where it is equal; missing values come last."""
    for c, v in reversed(list(zip(columns, key))):
        at = c.isNotNull() | at if v is None else c.isNotNull() & ((c < v) | ((c == v) & at))
    return at


def _struct(values: Sequence[Column], missing: Sequence[Column]) -> Column:
    """A key as one value; missing ones come first in a struct, so a flag before each value moves them to the end."""
    pairs = zip(missing, values, strict=True)
    return F.struct(*[x for i, (m, v) in enumerate(pairs) for x in (m.alias(f"n{i}"), v.alias(f"v{i}"))])


def _place(lead: Column, key: Column, cut: _Cut, kinds: Sequence[T.DataType]) -> Column:
    """Where a row stands: 0 before the first pivot, 1 at it, 2 between the pivots, 3 at the second, 4 after it, and -1
    outside of the cut's borders.

    Keys are compared as structs, each by a small method of its own; as nested tests on their columns, several cuts make
    one method that is too long to be compiled.
    """
    literal = lambda k: _struct([F.lit(None).cast(t) if v is None else v for v, t in zip(k, kinds)], [F.lit(v is None) for v in k])
    (a, b), place = cut.pivots, F.when(~_near(lead, cut), -1)
    if cut.lo is not None:
        place = place.when(key <= literal(cut.lo), -1)
    if cut.hi is not None:
        place = place.when(key >= literal(cut.hi), -1)
    if a is not None:
        place = place.when(key < literal(a), 0).when(key == literal(a), 1)
    if b is not None:
        place = place.when(key > literal(b), 4).when(key == literal(b), 3)
    return place.otherwise(2)


def _near(lead: Column, cut: _Cut) -> Column:
    """A looser test on the leading column alone, which scans can push down."""
    test = F.lit(True)
    if cut.lo is not None:
        test = lead.isNull() if cut.lo[0] is None else lead.isNull() | (lead >= cut.lo[0])
    if cut.hi is not None and cut.hi[0] is not None:
        test = test & (lead <= cut.hi[0])
    return test


def _look(df: DataFrame, columns: Sequence[Column], kinds: Sequence[T.DataType], cuts: Sequence[_Cut], size: int) -> Row:
    """Per cut the counts before and up to both pivots, within the cut's borders, and the pivots of the next round."""
    near = reduce(Column.__or__, [_near(columns[0], cut) for cut in cuts])
    keys = [F.col(f"k{i}") for i in range(len(columns))]
    rows = df.filter(near).select(*[c.alias(f"k{i}") for i, c in enumerate(columns)], F.rand().alias("r"))
    key = _struct(keys, [k.isNull() for k in keys])
    rows = rows.select("*", *[_place(keys[0], key, cut, kinds).alias(f"p{i}") for i, cut in enumerate(cuts)])
    cells = []
    for i, cut in enumerate(cuts):
        (a, b), place = cut.pivots, F.col(f"p{i}")
        none, every = F.lit(0).cast("long"), F.lit(cut.inside).cast("long")
        upto = lambda pivot, last, otherwise: otherwise if pivot is None else F.count_if(place.between(0, last))  # noqa: E731, B023
        taken = place == 2
        if cut.expected > size:
            taken = taken & (F.col("r") < size / cut.expected)
        cells += [upto(a, 0, none).alias(f"a1_{i}"), upto(a, 1, none).alias(f"a2_{i}")]
        cells += [upto(b, 2, every).alias(f"b1_{i}"), upto(b, 3, every).alias(f"b2_{i}")]
        cells.append(F.sort_array(F.collect_list(F.when(taken, key))).alias(f"xs_{i}"))
    return rows.agg(*cells).select(*[_picked(i, cut, kinds).alias(f"c{i}") for i, cut in enumerate(cuts)]).first()


def _picked(i: int, cut: _Cut, kinds: Sequence[T.DataType]) -> Column:
    xs, rows = F.col(f"xs_{i}"), F.col(f"b1_{i}") - F.col(f"a2_{i}")
    size, place = F.size(xs), F.lit(cut.k - cut.before) - F.col(f"a2_{i}")
    whole = size == rows
    middle = F.floor(F.try_divide(place + 0.5, rows) * size)
    # Four standard deviations of a sampled rank at most.
    margin = F.ceil(2 * F.sqrt(size))
    first = F.get(xs, F.when(whole, place - 1).otherwise(middle - margin).cast("int"))
    second = F.get(xs, F.when(whole, place).otherwise(middle + margin).cast("int"))
    return F.struct(
        *[F.col(f"{name}_{i}").alias(name) for name in ("a1", "a2", "b1", "b2")],
        whole.alias("whole"),
        size.alias("size"),
        first.eqNullSafe(second).alias("tied"),
        _carried(first, kinds).alias("first"),
        _carried(second, kinds).alias("second"),
    )


def _carried(key: Column, kinds: Sequence[T.DataType]) -> Column:
    """A key's values in a form that reaches the driver and comes back unchanged."""
    cells = []
    for i, kind in enumerate(kinds):
        value = key[f"v{i}"]
        if isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)
        elif isinstance(kind, (T.TimestampNTZType, T.DateType)):
            value = value.cast("string")
        cells.append(value.alias(f"v{i}"))
    return F.when(key.isNotNull(), F.struct(*cells))


def _literals(key: Row | None, kinds: Sequence[T.DataType]) -> Key | None:
    if key is None:
        return None
    read = lambda v, kind: F.timestamp_micros(F.lit(v)) if isinstance(kind, T.TimestampType) else F.lit(v).cast(kind)
    return tuple(None if v is None else read(v, kind) for v, kind in zip(key, kinds))


def _narrow(cut: _Cut, kinds: Sequence[T.DataType], seen: Row) -> bool:
    """Takes the counts of a round; false where row k lies amid equal keys."""
    (a, b), place = cut.pivots, cut.k - cut.before
    for pivot, before, upto in ((a, seen["a1"], seen["a2"]), (b, seen["b1"], seen["b2"])):
        if pivot is not None and before <= place < upto:
            cut.found = pivot
            return before == place
    cut.pivots = (None, None)
    if place < seen["a1"]:
        # The pivots missed; their counts still cut the bracket on one side.
        cut.hi, cut.inside = a, seen["a1"]
    elif place >= seen["b2"]:
        cut.lo, cut.before, cut.inside = b, cut.before + seen["b2"], cut.inside - seen["b2"]
    else:
        cut.lo, cut.hi = a or cut.lo, b or cut.hi
        cut.before, cut.inside = cut.before + seen["a2"], seen["b1"] - seen["a2"]
        if seen["whole"]:
            cut.found = _literals(seen["second"], kinds)
            return place == seen["a2"] or not seen["tied"]
        cut.pivots = _literals(seen["first"], kinds), _literals(seen["second"], kinds)
    missed = cut.pivots == (None, None)
    cut.expected = cut.inside if missed else cut.inside * min(1, (4 * seen["size"] ** 0.5 + 3) / seen["size"])
    return True
