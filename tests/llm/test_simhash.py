import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tallyglass.llm import simhash
from tallyglass.llm.components import components


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > len(hashes) / 2)


def plain_components(pairs):
    """Smallest reachable id by comparing all fingerprints."""
    ids, fps = [i for i, _ in pairs], [f for _, f in pairs]
    label = dict(zip(range(len(ids)), ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: label[k] for k, i in enumerate(ids)}


def test_fingerprint_matches_plain_form():
    for text in ["", " \t\n", "One", "one two", "A b\tC d e\x0bf g", "É ä ß Ö The the", "x " * 40, "a b c d", "a\x1cb c\x1fd e f"]:
        assert simhash.simhash(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    text = "the quick brown"
    row = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert simhash.simhash(text) == row["h"] & (1 << 64) - 1


def test_bit_sliced_comparison_against_popcount():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 12, np.uint64)
    values = np.concatenate([base[rng.integers(0, 12)] ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, int(k)))) for k in rng.integers(0, 6, 700)] if False else [[base[rng.integers(0, 12)] ^ np.uint64(sum({1 << int(b) for b in rng.integers(0, 64, int(k))}))] for k in rng.integers(0, 6, 700)])
    values = np.array(values, np.uint64)
    for sizes in ([700], [100, 3, 2, 1, 64, 65, 129, 336], [1] * 10 + [2] * 100 + [490]):
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        root = simhash.bucket_roots(bucket, values)
        for g in range(len(sizes)):
            rows = np.flatnonzero(bucket == g)
            want = plain_components([(int(r), int(values[r])) for r in rows]) if len(rows) < 150 else None
            if want:
                assert {int(r): int(root[r]) for r in rows} == want


def test_components_of_chains_and_hubs(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(rng, n):
    base = [" ".join(f"w{rng.randrange(900)}" for _ in range(120)) for _ in range(6)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(50)}"
        out.append(" ".join(words))
    return out


def check(documents, texts, limit):
    docs = documents(*texts)
    want = plain_components([(i, simhash.simhash(t or "")) for i, t in enumerate(texts)])
    got = simhash.near_duplicates(docs, limit).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(texts)
    assert all(r["fingerprint"] == f"{simhash.simhash(texts[r['doc_id']] or ''):016x}" for r in got)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(want.values()))


def test_operator_against_all_pairs(documents):
    rng = random.Random(3)
    check(documents, [*variants(rng, 90), None, "", "  ", "one", "One", "one"], 8192)


def test_large_buckets_are_divided(documents):
    check(documents, variants(random.Random(9), 60), 6)


def test_repeated_rows_empty_table_and_null_ids(spark, documents):
    docs = documents((5, "a b c d"), (5, "a b c d"), (9, "a b c d"), (None, "q r s t"), (3, None))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3), (5, 5), (5, 5), (9, 5), (None, None)]
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(docs).collect()) == ["3", "5", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    clash = docs.withColumn("component_id", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("mask", F.lit(2))
    assert simhash.keep_one(clash).columns == clash.columns


def test_texts_that_share_an_id_are_documents_of_their_own(documents):
    one, other, third = "a first text of some words", "quite another set of terms here", "nothing in common with either one"
    docs = documents((1, one), (1, other), (2, other), (3, third), (3, third), (4, one))
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == [(1, one), (1, other), (3, third)]


def test_a_very_long_text(documents):
    text = " ".join(f"w{k % 5003}" for k in range(200_000))
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents((1, text), (2, text + " end"), (3, "short"))).collect()) == [1, 3]
