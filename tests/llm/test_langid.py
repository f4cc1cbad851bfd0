import random

import numpy as np
from pyspark.sql import functions as F

from tallyglass.llm import langid

SYLLABLES = {
    "aa": "the ing th er on an re ed st en at or",
    "bb": "der sch ung en ein ge ch be zu ver ß ü",
    "cc": "que le de la é è ment tion eau oi ou ç",
}


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        parts = SYLLABLES[lang].split()
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(8, 80))]
        rows.append((k, " ".join(words) + ". 12", lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(got) == len(rows) and 150 < len(held) < 300
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_languages_are_not_learned(spark):
    docs = frame(spark, corpus(200))
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang")))
    a, b = langid.train(docs), langid.train(wrong)
    assert b.languages == a.languages and np.array_equal(a.weights, b.weights)


def plain_spectrum(text):
    gaps = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(gaps.split(" ")) + " "
    while "  " in padded:
        padded = padded.replace("  ", " ")
    return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)}


def test_spectrum_has_a_slot_for_each_gram():
    for text in ["Abc abd!  x", "ÄÖ ß", "a", "  a1b2  c  ", "北京 x"]:
        assert abs(int(langid.spectrum(text).sum()) - len(plain_spectrum(text))) <= 1
    assert langid.spectrum("12 ..") is None and langid.spectrum("") is None
    assert np.array_equal(langid.spectrum("ab cd"), langid.spectrum("AB...cd"))


def test_folded_weights_equal_the_kernel_form():
    rng = np.random.default_rng(1)
    bits = (rng.random((90, langid.SLOTS)) < 0.01).astype(np.uint8)
    kinds = ["x", "y", "z"] * 30
    model = langid.fit(bits, kinds)
    got = model.outputs(list(bits))
    assert (got.argmax(1) == [model.languages.index(k) for k in kinds]).mean() > 0.9
    kernel = lambda a, b: (a @ b.T) / np.sqrt(a.sum(1)[:, None] * b.sum(1)[None])
    assert np.allclose(kernel(bits * 1.0, bits[:1] * 1.0)[0], 1)


def test_odd_inputs(spark):
    rows = [(1, None, "aa"), (1, None, "aa"), (None, "text", "aa"), (2, "", None), (3, "123 ...", "bb"), (4, "der " * 100_000, None)]
    docs = frame(spark, rows).withColumn("language", F.lit("q")).withColumn("score", F.lit(1)).withColumn("place", F.lit(1))
    assert langid.train(docs.limit(0)) is None
    assert [r["lang_pred"] for r in langid.identify(docs, None).collect()] == ["und"] * 6
    model = langid.train(frame(spark, corpus(60)))
    got = sorted(((str(r["doc_id"]), r["lang_pred"]) for r in langid.identify(docs, model).collect()))
    assert [g for g in got if g[0] in "123"] == [("1", "und"), ("1", "und"), ("2", "und"), ("3", "und")] and got[4] == ("4", "bb")
    assert langid.identify(docs.limit(0), model).count() == 0


def test_letters_of_all_planes():
    """A flag of tag characters and private use have no letter; an ideograph behind the second plane is one."""
    assert langid.spectrum("\U0001f3f4\U000e0067\U000e0062\U000e007f") is None
    assert langid.spectrum("\U000f0000 12") is None
    assert langid.spectrum("\U00020000") is not None


def test_an_id_on_many_rows_counts_once(spark):
    docs = frame(spark, corpus(60))
    some = docs.filter("lang is not null and text is not null").filter(langid.fold(parts=langid.FOLDS) != langid.HELD_OUT).orderBy("doc_id").limit(1)
    many = docs.unionByName(some.crossJoin(spark.range(3000)).drop("id"))
    asked = ["der und das", "the of and", "x"]
    assert langid.train(many).predict(asked) == langid.train(docs).predict(asked)
