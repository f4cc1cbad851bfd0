"""Exact order statistics: narrowing must agree with a full sort, whatever the shape of the data."""

import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.plans import selection as sel
from tallyglass.plans.ordered import never_decreases, number_rows, over_ordered
from tallyglass.plans import ordered


@pytest.fixture
def narrowing(monkeypatch):
    """Limits so low that small tables take the path of large ones."""
    monkeypatch.setattr(sel, "FINAL_ROWS", 25)
    monkeypatch.setattr(sel, "GRID", 10)
    monkeypatch.setattr(sel, "ACCURACY", 50)
    monkeypatch.setattr(sel, "_STEPS", [i / 10 for i in range(11)])


def shapes():
    rng = np.random.default_rng(7)
    skewed = np.concatenate([np.full(1000, 5.0), rng.normal(size=2000) * 10])
    return {
        "normal": rng.normal(size=3000),
        "third_tied": skewed,
        "wild": 10.0 ** rng.uniform(-200, 200, size=2000) * rng.choice([-1, 1], size=2000),
        "constant": np.full(500, 3.25),
        "two_values": rng.choice([1.0, 2.0], size=1001),
        "tiny": np.array([4.0, 1.0]),
        "single": np.array([9.0]),
    }


@pytest.mark.parametrize("shape", list(shapes()))
def test_quantiles_equal_sorting(spark, narrowing, shape):
    values = shapes()[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = sel.exact_quantiles(df, {"x": probs})["x"]
    want = np.quantile(values, probs)
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_quantiles_skip_missing_and_empty(spark, narrowing):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "a double, b double")
    got = sel.exact_quantiles(df, {"a": [0.5], "b": [0.5]})
    assert got == {"a": [2.0], "b": [None]}
    assert sel.exact_quantiles(df, {"a": [0.5]}, exact=False)["a"][0] in (1.0, 3.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5).map(float), min_size=1, max_size=200), st.floats(0, 1))
def test_quantiles_of_any_list(spark, values, prob):
    limit = sel.FINAL_ROWS
    sel.FINAL_ROWS = 10
    try:
        df = spark.createDataFrame([(v,) for v in values], "x double")
        got = sel.exact_quantiles(df, {"x": [prob]})["x"][0]
    finally:
        sel.FINAL_ROWS = limit
    assert got == pytest.approx(np.quantile(values, prob), abs=1e-9)


def test_grouped_quantile_with_a_hot_group(spark, narrowing):
    rng = np.random.default_rng(3)
    keys = rng.choice(["hot", "a", "b", "c"], size=4000, p=[0.9, 0.05, 0.04, 0.01])
    pdf = pd.DataFrame({"k": keys, "x": np.round(rng.exponential(size=4000), 2)})
    pdf.loc[3, "k"] = None
    df = spark.createDataFrame(pdf)
    got = {r["k"]: r["m"] for r in sel.grouped_quantile(df, ["k"], "x", 0.5, "m").collect()}
    want = pdf.groupby("k")["x"].median().to_dict()
    assert got == pytest.approx(want)


def test_most_frequent_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "x string")
    assert sel.most_frequent(df, "x") == "a"
    assert sel.most_frequent(df.filter("x is null"), "x") is None
    day = datetime.date(2024, 2, 3)
    mixed = spark.createDataFrame([("b", 2, 1.5, day), ("b", 3, float("nan"), day), (None, 3, 2.5, None)], "s string, n int, x double, d date")
    assert sel.most_frequent_of(mixed, ["s", "n", "x", "d"]) == {"s": "b", "n": 3, "x": 1.5, "d": day}
    assert sel.most_frequent_of(mixed, []) == {}


@pytest.mark.parametrize("shift", [-0.3, -0.02, 0.02, 0.3])
def test_a_shifted_sketch_is_recovered_from(shift):
    """A source whose sketches lie beside the truth: the counts must still lead to the right row."""
    values = np.sort(np.random.default_rng(3).normal(size=400_000))
    passes = []

    class Source:
        def sketch(self, targets):
            out = {}
            for t, g in targets.items():
                own = values[(values > (g.lo if g.lo is not None else -np.inf)) & (values < (g.hi if g.hi is not None else np.inf))]
                places = np.clip((np.linspace(0, 1, sel.GRID + 1) + shift) * (len(own) - 1), 0, len(own) - 1).astype(int)
                out[t] = own[places]
            passes.append(1)
            return out

        def count(self, targets):
            edge = lambda v, side, none: none if v is None else int(np.searchsorted(values, v, side))
            return {
                t: (edge(g.lo, "left", 0), edge(g.lo, "right", 0), edge(g.hi, "left", g.n), edge(g.hi, "right", g.n))
                for t, g in targets.items()
            }

    for rank in (0, 1, 1000, 200_000, 399_998):
        target = sel.Target(len(values), (rank, rank + 1))
        passes.clear()
        busy = {"t": target}
        while any(g.open and g.inside > sel.FINAL_ROWS for g in busy.values()):
            target.narrow(Source().sketch(busy)["t"])
            target.check(*Source().count(busy)["t"])
            assert len(passes) < 40
        lo = -np.inf if target.lo is None else target.lo
        hi = np.inf if target.hi is None else target.hi
        for r in target.open:
            assert lo < values[r] < hi and target.below <= r < target.below + target.inside
            assert target.below == np.searchsorted(values, lo, "right")


def test_number_rows_and_blocked_windows(spark, monkeypatch):
    df = spark.range(997).select((F.col("id") * 37 % 997).alias("k")).repartition(7)
    placed = number_rows(df, ["k"])
    assert placed.filter("position != k").count() == 0
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    got = over_ordered(df, ["k"], 7, lambda w: {"before": F.lag("k", 7).over(w), "s": F.sum("k").over(w.rowsBetween(-6, 0))})
    assert got.count() == 997
    assert got.filter("before is null").count() == 7
    assert got.filter("before is not null and before != k - 7").count() == 0
    assert got.filter("k >= 6 and s != 7 * k - 21").count() == 0


def test_never_decreases(spark):
    df = spark.createDataFrame(
        [(i, i // 3, -i, None if i == 4 else float(i), float("nan") if i == 2 else float(i)) for i in range(50)],
        "k int, up int, down int, gap double, nan double",
    ).repartition(6)
    got = {r["name"]: r["monotonic"] for r in never_decreases(df, ["up", "down", "gap", "nan"], ["k"]).collect()}
    assert got == {"up": True, "down": False, "gap": False, "nan": False}
    assert never_decreases(df.limit(0), ["up"], ["k"]).first()["monotonic"] is True


def test_grouped_quantile_of_many_heavy_groups(spark):
    """Fifty thousand groups, none collected, and sketches that miss."""
    rows = spark.range(1_000_000).select((F.col("id") % 50_000).alias("k"), (F.xxhash64("id") % 1000).cast("double").alias("x"))
    got = sel.grouped_quantile(rows, ["k"], "x", 0.5, "m")
    want = rows.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("w"))
    assert got.join(want, "k").filter("abs(m - w) > 1e-9").count() == 0 and got.count() == 50_000


@pytest.mark.parametrize("margin", [0.001, 0.015])
def test_grouped_quantile_recovers_from_missed_brackets(spark, monkeypatch, margin):
    monkeypatch.setattr(sel, "SKETCH", 8)
    monkeypatch.setattr(sel, "MARGIN", margin)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "none"], size=6000, p=[0.8, 0.1, 0.1]), "x": rng.normal(size=6000)})
    pdf.loc[pdf.k == "none", "x"] = np.nan
    for prob in (0.0, 0.37, 0.5, 1.0):
        got = {r["k"]: r["m"] for r in sel.grouped_quantile(spark.createDataFrame(pdf).repartition(6), ["k"], "x", prob, "m").collect()}
        assert got.pop("none") is None
        assert got == pytest.approx(pdf[pdf.k != "none"].groupby("k")["x"].quantile(prob).to_dict())


def test_running_sums_cross_blocks_and_keys(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SUM_BITS", 2)
    rows = [(k, i, (i * 7 + k) % 5) for k in range(3) for i in range(100 if k else 700)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    got = {(r["k"], r["i"]): r["s"] for r in ordered.running_sums(df, ["k"], ["i"], "v", "s").collect()}
    total = {}
    for k, i, v in rows:
        total[k] = total.get(k, 0) + v
        assert got[k, i] == total[k]
