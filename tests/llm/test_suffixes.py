"""Repeated strings against a count of every string."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import suffixes


def plain(texts, length=200):
    """(kept bytes, spans) of every text."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((bytes(np.frombuffer(d, np.uint8)[~gone]), [tuple(x) for x in edges.reshape(-1, 2).tolist()]))
    return out


def found(documents, texts, length=200, gram=32):
    got = suffixes.remove_repeated(documents(*texts), length, gram).orderBy("doc_id").collect()
    return [(bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in got]


def corpus(n=60, seed=1, alphabet="abcé\n"):
    """Texts with shared passages of many lengths, copies and edits."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.choice([20, 60, 90, 150, 199, 200, 201, 260, 400])) for _ in range(12)]
    out = []
    for k in range(n):
        text = "".join(rng.choice([word(rng.randrange(120)), rng.choice(passages)]) for _ in range(rng.randrange(1, 9)))
        if k % 7 == 3:
            text = out[-1]
        if k % 7 == 5 and out[-1]:
            at = rng.randrange(len(out[-1]))
            text = out[-1][:at] + "X" + out[-1][at + 1 :]
        out.append(text)
    return out


def test_equals_a_count_of_every_string(documents):
    texts = corpus()
    assert found(documents, texts) == plain(texts)


@pytest.mark.parametrize("most", [1, 2, 4])
def test_crowded_anchors_are_divided(documents, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
    texts = corpus(40, seed=most)
    assert found(documents, texts) == plain(texts)


def test_small_shards_pieces_and_strings(documents, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD", 3)
    monkeypatch.setattr(suffixes, "MERGED", 10)
    monkeypatch.setattr(suffixes, "PIECE", 64)
    texts = corpus(50, seed=9)
    assert found(documents, texts, 40, 8) == plain(texts, 40)


def test_periodic_long_short_null_and_equal_texts(documents):
    prose = "".join(random.Random(3).choice("abcdefgh ") for _ in range(30_000))
    texts = [None, "", "x" * 199, "x" * 199, "y" * 200, "z" * 201, "ab" * 300, prose, "é" * 150 + prose[100:299], prose[:200], prose[-200:] + "!"]
    assert found(documents, texts) == plain(texts)


def test_null_and_repeated_ids_and_other_columns(spark):
    text = "".join(random.Random(4).choice("abc") for _ in range(450))
    rows = [(None, text), (None, text), (7, text[:210]), (7, "other " * 3), (7, text[:210]), (8, "u" * 20 + text[200:420])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gram": F.lit(1), "at": F.lit("x"), "n": F.lit(2), "low": F.lit(3)})
    got = sorted((r["doc_id"] or -1, bytes(r["kept"])) for r in suffixes.remove_repeated(docs).collect())
    assert got == sorted((d or -1, kept) for (d, _), (kept, _) in zip(rows, plain([t for _, t in rows]), strict=True))


def test_empty_table(spark):
    assert suffixes.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merged_transforms_equal_a_sort_of_all_suffixes():
    """The interleave and its common prefixes at every column, against sorted suffixes."""
    rng = np.random.default_rng(5)
    body = rng.integers(97, 99, (30, 12)).astype(np.uint8)
    groups = np.sort(rng.integers(0, 4, 30)).astype(np.uint16)
    parts = [np.arange(k, 30, 3) for k in range(3)]
    shards = [(*suffixes.transform(body[p], groups[p], 12), groups[p], p.astype(np.int32)) for p in parts]
    for column, rows, common in suffixes.merged(shards, 12):
        keys = [(groups[r], bytes(body[r, column:])) for r in rows.tolist()]
        assert keys == sorted(keys)
        for i in range(1, 30):
            (g, x), (h, y) = keys[i - 1], keys[i]
            shared = 0
            while g == h and shared < len(x) and x[shared] == y[shared]:
                shared += 1
            assert common[i] == shared


def test_anchors_lie_alike_in_equal_strings():
    rng = random.Random(6)
    common = bytes(rng.randrange(97, 105) for _ in range(200))
    places = []
    for left, right in ((0, 0), (1, 3), (170, 300), (999, 5)):
        data = bytes(rng.randrange(97, 105) for _ in range(left)) + common + bytes(rng.randrange(97, 105) for _ in range(right))
        at, hashes = suffixes.anchors(np.frombuffer(data, np.uint8), 200, 32)
        places.append({(a - left, h) for a, h in zip(at.tolist(), hashes.tolist(), strict=True) if 0 <= a - left <= 168})
    assert set.intersection(*places)
