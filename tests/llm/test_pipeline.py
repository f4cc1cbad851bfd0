import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyglass.llm import decontaminate, linedup, quality, simhash
from tallyglass.llm.packing import encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Good prose, junk, near copies, benchmark leaks and shared passages, with labels for some."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(700)]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(9, 15))) + "." for _ in range(n))
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(25))) for k in range(6)]
    passage = prose(12)
    docs, labels, kinds = [], [], {}
    for k in range(420):
        kind = rng.choices(["good", "junk", "leak", "shared", "copy"], [60, 14, 6, 10, 10])[0]
        text = prose(rng.randrange(4, 12))
        if kind == "junk":
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join(w for w in text.split()[:8] for _ in range(14))])
        elif kind == "leak":
            text = f"{text}\n{rng.choice(items)[1]} {prose(2)}"
        elif kind == "shared":
            text = f"{text}\n{passage}\n{prose(3)}"
        elif kind == "copy" and docs:
            text = rng.choice(docs)[1]
        kinds[k] = kind
        docs.append((k, text, "en", "src", len(text)))
        if kind != "copy" and rng.random() < 0.6:
            labels.append((k, int(kind != "junk"), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "word " * 20_000, "en", "s", 100_000)]
    return docs, labels, items, kinds


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, labels, items, _ = corpus()
    write(spark, path, docs, labels, items)
    return path


def test_stages_one_by_one(spark, folder):
    docs, _, items, kinds = corpus()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    frame, given = spark.createDataFrame(docs, DOCS), {d[0]: d[1] for d in docs}
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, frame, folder)
        assert out.columns == COLUMNS
        rows = [tuple(r) for r in out.collect()]
        kept = {r[0]: r[1] for r in rows}
        assert len(kept) == len(rows) and set(kept) <= set(given)
        if name == "quality_classifier":
            net = quality.train(spark.createDataFrame(docs, DOCS), spark.read.parquet(f"{folder}/labels.parquet"))
            import numpy as np

            scores = dict(zip(given, net.scores(np.array([quality.features(t or "") for t in given.values()])), strict=True))
            assert set(kept) == {i for i in given if scores[i] >= quality.THRESHOLD}
            good, junk = [i for i, k in kinds.items() if k != "junk" and k != "copy"], [i for i, k in kinds.items() if k == "junk"]
            assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in junk) <= 0.1 * len(junk)
        elif name == "line_dedup":
            seen = set()
            for i in sorted(given):
                gone = set()
                for k, lines in linedup.text_chunks(given[i] or ""):
                    body = "\n".join(lines)
                    gone |= {k} if body in seen else set()
                    seen.add(body)
                assert kept[i] == (linedup.without(given[i], gone) if given[i] is not None else None)
        elif name == "simhash_near_dedup":
            fps = {i: simhash.simhash(t or "") for i, t in given.items()}
            label = {i: i for i in fps}
            changed = True
            while changed:
                changed = False
                for i in fps:
                    for j in fps:
                        if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                            label[i], changed = label[j], True
            assert set(kept) == set(label.values())
        else:
            index = decontaminate.Index(items)
            hits = {t for t, *_ in index.search([t or "" for t in given.values()])}
            assert set(kept) == {i for k, i in enumerate(given) if k not in hits} and len(hits) > 5
        frame, given = spark.createDataFrame(rows, DOCS), kept
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect()
    encode = encoder(None).encode
    assert {r["doc_id"] for r in packed} == set(given)
    for i, t in given.items():
        assert sum(r["length"] for r in packed if r["doc_id"] == i) == len(encode(t or "")) // 4 + 1


def test_run_equals_the_stages(spark, folder):
    whole = corpus_pipeline.run(spark, folder)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        frame = step(spark, frame, folder)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*keys).collect())) == sorted(map(tuple, frame.select(*keys).collect()))


def test_empty_tables_and_further_columns(spark, tmp_path, folder):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    frame = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("piece", F.lit("y"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        frame = step(spark, frame, folder)
        assert frame.columns == [*COLUMNS, "score", "fp", "piece"]
    assert corpus_pipeline.STAGES[-1][1](spark, frame, folder).count() > 0
