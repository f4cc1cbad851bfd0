"""Cuts of ordered rows: the filters must keep what a full sort keeps, for every type of key."""

import datetime
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.plans import cuts


@pytest.fixture
def small_samples(monkeypatch):
    """Samples so small that small tables take several rounds."""
    monkeypatch.setattr(cuts, "SAMPLE", 80)


def _ordered_frame(spark, kind):
    rng = random.Random(11)
    days = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.choice([0, 0, 0, 1, 2, 5])) for _ in range(400)]
    if kind == "timestamp":
        return spark.createDataFrame([(d, i) for i, d in enumerate(days)], "a timestamp_ntz, b long")
    if kind == "date":
        return spark.createDataFrame([(d.date(), i) for i, d in enumerate(days)], "a date, b long")
    if kind == "text":
        return spark.createDataFrame([(f"customer-{d.day:02d}-é{'x' * (i % 3)}", i) for i, d in enumerate(days)], "a string, b long")
    if kind == "big":
        return spark.createDataFrame([(2**60 + d.day, i) for i, d in enumerate(days)], "a long, b long")
    if kind == "gaps":
        return spark.createDataFrame([(None if i % 7 == 0 else float(d.day), i) for i, d in enumerate(days)], "a double, b long")
    raise AssertionError(kind)


@pytest.mark.parametrize("kind", ["timestamp", "date", "text", "big", "gaps"])
@pytest.mark.parametrize("small", [False, True])
def test_rank_cuts_keep_exactly_the_first_rows(spark, kind, small, request):
    if small:
        request.getfixturevalue("small_samples")
    df = _ordered_frame(spark, kind).repartition(6)
    places = [0, 1, 80, 200, 399, 400, 500]
    n, tests = cuts.rank_cuts(df, ["a", "b"], lambda n: places)
    assert n == 400
    ordered_rows = [r["b"] for r in df.orderBy(F.asc_nulls_last("a"), "b").collect()]
    for k, test in zip(places, tests):
        kept = {r["b"] for r in df.filter(test).collect()}
        assert kept == set(ordered_rows[: min(k, 400)]), k


def test_rank_cuts_refuse_an_order_with_ties_at_the_cut(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)], "a int, b int")
    with pytest.raises(ValueError, match="does not separate"):
        cuts.rank_cuts(df, ["a"], lambda n: [5])


def test_rank_cuts_do_not_depend_on_the_layout(spark):
    df = _ordered_frame(spark, "timestamp")
    want = None
    for parts in (1, 3, 8):
        _, (test,) = cuts.rank_cuts(df.repartition(parts), ["a", "b"], lambda n: [123])
        kept = sorted(r["b"] for r in df.filter(test).collect())
        assert want is None or kept == want
        want = kept


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text("ab\x00é", max_size=4)), st.one_of(st.none(), st.integers(0, 2))), min_size=1, max_size=60), st.data())
def test_cuts_of_any_texts(spark, pairs, data):
    """Missing values in both keys and texts that begin each other; a cut through equal keys is refused."""
    df = spark.createDataFrame(pairs, "a string, b long")
    key = lambda p: (p[0] is None, (p[0] or "").encode(), p[1] is None, p[1] or 0)
    ranked = sorted(map(key, pairs))
    k = data.draw(st.integers(0, len(pairs)))
    if 0 < k < len(pairs) and ranked[k - 1] == ranked[k]:
        with pytest.raises(ValueError, match="does not separate"):
            cuts.rank_cuts(df, ["a", "b"], lambda n: [k])
        return
    n, (test,) = cuts.rank_cuts(df, ["a", "b"], lambda n: [k])
    assert n == len(pairs)
    assert sorted(key(tuple(r)) for r in df.filter(test).collect()) == ranked[:k]
    assert df.filter(test.isNull()).count() == 0


def test_keys_of_other_types(spark):
    rows = [(i % 2 == 0, Decimal(i) / 8, bytes([i % 5, 0]), float(-i), datetime.datetime(2024, 10, 27, 0, 0, i)) for i in range(60)]
    df = spark.createDataFrame(rows, "t boolean, d decimal(20,6), y binary, f float, s timestamp").repartition(4)
    for order in (["t", "d"], ["y", "f"], ["f"], ["s"], ["d"]):
        _, (test,) = cuts.rank_cuts(df, order, lambda n: [23])
        assert sorted(map(str, df.filter(test).collect())) == sorted(map(str, df.orderBy(*order).limit(23).collect()))
    with pytest.raises(TypeError, match="cannot order"):
        cuts.rank_cuts(df.select(F.array("f").alias("l")), ["l"], lambda n: [3])


def test_a_hot_leading_key_and_long_texts(spark, monkeypatch):
    """A third of the rows share a text of 10 KB; rounds don't grow with the length of a key."""
    rounds, look = [], cuts._look
    monkeypatch.setattr(cuts, "_look", lambda *given: rounds.append(1) or look(*given))
    monkeypatch.setattr(cuts, "SAMPLE", 400)
    name = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.xxhash64("id") % 50).cast("string")
    df = spark.range(20_000).select(F.concat(F.lit("x" * 10_000), name).alias("a"), "id").repartition(8)
    _, tests = cuts.rank_cuts(df, ["a", "id"], lambda n: [4_000, 10_000, 15_000])
    assert [df.filter(t).count() for t in tests] == [4_000, 10_000, 15_000]
    assert len(rounds) <= 8
    last = df.filter(tests[1]).agg(F.max(F.struct("a", "id"))).first()[0]
    assert df.filter(~tests[1]).agg(F.min(F.struct("a", "id"))).first()[0] > last


def test_no_rows_and_one_row(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert cuts.rank_cuts(df.limit(0), ["a"], lambda n: [n // 2])[0] == 0
    n, (none, every) = cuts.rank_cuts(df, ["a"], lambda n: [0, 1])
    assert (n, df.filter(none).count(), df.filter(every).count()) == (1, 0, 1)
