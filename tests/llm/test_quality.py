import random

import numpy as np
from pyspark.sql import functions as F

from tallyglass.llm import quality
from tallyglass.llm.common import fold


def corpus(n=1200, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    out = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        good = rng.random() < 0.8
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + rng.choice(["###", "$$$"]) for w in words], [w for w in words[:9] for _ in range(15)]])
        lines = [" ".join(words[i : i + 12]) + "." * good for i in range(0, len(words), 12)]
        label = int(good) if rng.random() < 0.5 else None
        out.append((k, "\n".join(lines), good, label))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, v, 0) for i, _, _, v in rows if v is not None], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_stage(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    net = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(docs, net).collect()}
    assert len(got) == len(rows)
    held = {i: g for i, _, g, _ in rows if got[i]["held_out"]}
    assert 100 < len(held) < 400
    assert np.mean([got[i]["predicted"] == g for i, g in held.items()]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    kept = quality.keep_good(docs.withColumn("score", F.lit("x")), net)
    assert kept.columns == [*docs.columns, "score"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    again = quality.train(docs.repartition(7), labels.repartition(3))
    assert np.allclose(again.logits(np.zeros((1, quality.FEATURES))), net.logits(np.zeros((1, quality.FEATURES))), atol=0.05)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = frames(spark, corpus(300))
    flipped = labels.withColumn("quality", F.when(fold(parts=5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    x = np.random.default_rng(1).random((5, quality.FEATURES))
    assert np.allclose(quality.train(docs, labels).logits(x), quality.train(docs, flipped).logits(x), atol=1e-3)


def test_class_prior():
    rng = np.random.default_rng(4)
    positive = rng.normal(2, 1, 6000)
    unlabelled = np.concatenate([rng.normal(2, 1, 4200), rng.normal(-3, 1, 1800)])
    assert abs(quality.class_prior(positive, unlabelled) - 0.7) < 0.05


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, ""), (3, "x " * 50_000), (4, "\n\n")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is None
    got = quality.score(docs, None).collect()
    assert len(got) == 6 and all(r["score"] == 1 and r["predicted"] == 1 for r in got)
    assert quality.score(docs.limit(0), None).count() == 0
    assert quality.keep_good(docs, None).count() == 6
    for text in ["", "\n", " ", "\ud83d", "é" * 100_000, "a"]:
        assert np.isfinite(quality.features(text)).all()


def plain_risk(z, n_p, prior, part):
    loss = lambda v: np.log1p(np.exp(-v))
    negative = loss(-z[n_p:]).mean() - prior * loss(-z[:n_p]).mean()
    return prior * loss(z[:n_p]).mean() + negative if part == "whole" else -negative


def test_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(7)
    seen = set()
    for shift in (-4.0, -1.0, 0.0, 2.0):
        z, n_p, prior = rng.normal(size=30), 12, 0.6
        z[n_p:] += shift
        negative = -plain_risk(z, n_p, prior, "negative")
        part = "whole" if negative >= 0 else "negative"
        seen.add(part)
        got = quality.risk_slope(z, n_p, prior)
        for k in range(30):
            step = np.eye(30)[k] * 1e-5
            want = (plain_risk(z + step, n_p, prior, part) - plain_risk(z - step, n_p, prior, part)) / 2e-5
            assert abs(got[k] - want) < 1e-7
    assert seen == {"whole", "negative"}


def test_an_id_on_many_rows_counts_once(spark):
    docs, labels = frames(spark, corpus(300))
    some = docs.filter(fold(parts=5) != 0).orderBy("doc_id").limit(1)
    many = docs.unionByName(some.crossJoin(spark.range(3000)).drop("id"))
    x = np.random.default_rng(1).random((5, quality.FEATURES))
    assert np.allclose(quality.train(docs, labels).logits(x), quality.train(many, labels).logits(x), atol=1e-3)
