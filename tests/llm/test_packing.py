import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.llm import packing
from tallyglass.llm.common import join_spread


def plain_best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time: the contents of every sequence."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + n <= capacity]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return bins


def placed(runs):
    """(sequence, offset, length) of every ranked piece."""
    for length, first_rank, n, first, each, used in runs:
        for k in range(n):
            yield (length, first_rank + k), first + k // each, used + k % each * length


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=70))
def test_plan_equals_one_by_one(lengths):
    runs = packing.plan_runs(Counter(lengths), 24)
    got, sequences = list(placed(runs)), defaultdict(list)
    assert sorted(r for r, _, _ in got) == sorted((n, k) for n, c in Counter(lengths).items() for k in range(c))
    for (length, _), sequence, offset in got:
        sequences[sequence].append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 24
    want = plain_best_fit(lengths, 24)
    # Which of two equally full sequences takes a piece is open; how full all of them get is not.
    assert sorted(sum(n for _, n in p) for p in sequences.values()) == sorted(map(sum, want))


def test_tightest_capacity():
    tree, rng = packing.OpenCapacities(37), random.Random(2)
    have = set()
    for _ in range(600):
        c = rng.randrange(1, 38)
        (have.discard if c in have else have.add)(c)
        tree.mark(c, c in have)
        n = rng.randrange(1, 38)
        assert tree.tightest(n) == min((x for x in have if x >= n), default=None)


def test_pieces_of_a_document():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


TEXTS = [
    "", " ", "  two  spaces ", "tab\t\tand\nlines\n\n\n end ", "It's 12,345.67 déjà vu — 北京 🙂 ​", "a <|endoftext|> b", "<|endoftext|>",
    " " * 3000 + "x", "word " * 9000, "x" * 5000, "\u0085x y", "İstanbul ŞİŞLİ 'Twas 'll", "\r\n\r\n", "1 2 3 4 5" * 50,
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizer(text):
    e = packing.encoder(None)
    assert e.encode(text) == e.plain(text)


def test_operator(documents):
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choice(["alpha", "beta,", "gamma.", "x1"]) for _ in range(rng.randrange(0, 300)))) for k in range(60)]
    rows = [*texts, (100, None), (101, "word " * 700), (7, texts[7][1]), (None, "no id"), *((200 + k, "same text") for k in range(90))]
    docs = documents(*rows).withColumn("piece", F.lit("x")).withColumn("length", F.lit(1)).withColumn("bucket", F.lit(2))
    got = packing.pack(docs, capacity=128).collect()
    e = packing.encoder(None)
    want = Counter()
    for i, t in rows:
        ids = e.encode(t or "") + b"\0\0\0\0"
        for k, (start, n) in enumerate(packing.cut(len(ids) // 4, 128)):
            want[i, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = 0
        for offset, n in sorted(parts):
            assert offset == ends
            ends += n
        assert ends <= 128
    assert len(sequences) == len(plain_best_fit([k[3] for k in want.elements()], 128))


def test_empty_table(documents):
    assert packing.pack(documents()).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_spread_equals_a_join(spark, how):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(3000)] + [(None, -1), (50, -2)], "k int, v int")
    keyed = rows.filter("k is not null and k < 5").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = join_spread(rows, keyed, ["k"], "n", how)
    want = rows.join(keyed.drop("n"), ["k"], how)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
