import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from tallyglass.llm import winnow


def code(word):
    return xxhash.xxh64_intdigest(word.encode(), 42)


def signed_mod(h):
    return (h - (1 << 64) if h >> 63 else h) % winnow.PRIME


def plain(text):
    """[(hash, position)] by the definition."""
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    if not words:
        return []
    if len(words) < winnow.GRAM:
        return [(signed_mod(code(" ".join(words))), 0)]
    codes, grams = [signed_mod(code(w)) for w in words], []
    for i in range(len(words) - winnow.GRAM + 1):
        h = 0
        for c in codes[i : i + winnow.GRAM]:
            h = (h * winnow.BASE + c) % winnow.PRIME
        grams.append(h)
    out = []
    for s in range(max(1, len(grams) - winnow.WINDOW + 1)):
        part = grams[s : s + winnow.WINDOW]
        best = max(k for k, h in enumerate(part) if h == min(part))
        if (part[best], s + best) not in out[-1:]:
            out.append((part[best], s + best))
    return out


def plain_rows(rows):
    def near(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    show = lambda f: " ".join(f"{h:x}:{p}" for h, p in f)
    ordered = sorted((i, t or "") for i, t in rows if i is not None)
    pairs = [(i, t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered)] + [(None, t or "", "") for i, t in rows if i is None]
    out = []
    for i, t, following in pairs:
        q = len(t) // 4
        e = t[: len(t) - q] + following[:q]
        a, b, c = plain(t), plain(e), plain(following)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), show(a), show(b), near(a, b), near(a, c)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{k}é" for k in range(60)]
    ids = rng.sample(range(3000), 90) + [10**12, 10**12 + 1, -5, -70_000, 2**40]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 90)))) for i in ids]
    return rows + [(4000, None), (4001, ""), (4002, " \t lead and trail \n"), (4003, "a b"), (4004, "same " * 300), (4005, "北京" * 9), (None, "no id here at all"), (None, None)]


def test_against_the_definition(documents):
    rows = corpus()
    got = sorted((tuple(r) for r in winnow.fingerprints(documents(*rows)).collect()), key=str)
    assert got == plain_rows(rows)


def test_shared_passages_share_a_hash():
    rng = random.Random(1)
    for _ in range(50):
        passage = [f"p{rng.randrange(30)}" for _ in range(winnow.WINDOW + winnow.GRAM - 1)]
        a = [f"a{k}" for k in range(rng.randrange(30))] + passage + [f"b{k}" for k in range(rng.randrange(30))]
        b = [f"c{k}" for k in range(rng.randrange(30))] + passage + [f"d{k}" for k in range(rng.randrange(30))]
        assert {h for h, _ in plain(" ".join(a))} & {h for h, _ in plain(" ".join(b))}


def test_small_tables_repeated_rows_and_clashing_columns(documents):
    assert winnow.fingerprints(documents()).count() == 0
    one = winnow.fingerprints(documents((7, "a b c d e f g h"))).first()
    assert one["near_next"] == 1.0
    rows = [(1, "x y z q"), (1, "x y z q"), (2, "k")]
    docs = documents(*rows).withColumn("block", F.lit("b")).withColumn("chosen", F.lit(1)).withColumn("_words", F.lit(2))
    assert sorted((tuple(r) for r in winnow.fingerprints(docs).collect()), key=str) == plain_rows(rows)


def test_no_python_in_the_plan(documents):
    plan = winnow.fingerprints(documents((1, "a")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_hashed_ids(spark, documents):
    rng = random.Random(2)
    rows = [(rng.randrange(-(2**63), 2**63), f"text number {k} of some words") for k in range(300)]
    assert sorted((tuple(r) for r in winnow.fingerprints(documents(*rows)).collect()), key=str) == plain_rows(rows)
    numbers = sorted({i >> 8 for i, _ in rows})
    table = spark.createDataFrame([(n,) for n in numbers], "block long")
    got = {r["block"]: r["following"] for r in winnow.next_blocks(table).collect()}
    assert got == dict(zip(numbers, numbers[1:] + numbers[:1]))


def test_a_very_long_text(documents):
    rows = [(1, " ".join(f"w{k % 997}" for k in range(100_000))), (2, "short one")]
    assert sorted((tuple(r) for r in winnow.fingerprints(documents(*rows)).collect()), key=str) == plain_rows(rows)
