import pickle
import random

from pyspark.sql import functions as F

from tallyglass.llm import decontaminate as dec


def best(text, item):
    """(distance, position) of the run of words nearest to an item: of equal ones that which ends first, then the shortest."""
    row, starts = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, x in enumerate(item):
        new, own = [i + 1], [0]
        for j, y in enumerate(text):
            ways = [(row[j] + (x != y), -starts[j]), (row[j + 1] + 1, -starts[j + 1]), (new[j] + 1, -own[j])]
            least = min(ways)
            new.append(least[0])
            own.append(-least[1])
        row, starts = new, own
    end = row.index(min(row))
    return row[end], starts[end]


def plain(text, item):
    """The least distance of any run of words, or None beyond a fifth."""
    w, i = dec.words_of(text or ""), dec.words_of(item)
    if len(i) < dec.MIN_WORDS:
        return None
    found = best(w, i)[0]
    return found if found <= dec.edits_allowed(len(i)) else None


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        change = rng.randrange(3)
        if change == 0:
            words[at] = "zz"
        elif change == 1:
            words.insert(at, "qq")
        else:
            words.pop(at)
    return words


def corpus(seed=3, items=14, texts=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(260)]
    bench = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 9, 14, 14, 22, 31])))) for k in range(items)]
    bench += [(100, bench[0][1]), (101, "too short"), (102, None), (103, "")]
    docs = []
    for k in range(texts):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if k % 2:
            source = bench[rng.randrange(items)][1].split()
            words[len(words) // 2 : len(words) // 2] = edited(rng, source, rng.randrange(0, dec.edits_allowed(len(source)) + 2))
        docs.append((k, " ".join(words).title() if k % 3 else ", ".join(words)))
    docs += [(500, None), (501, ""), (502, bench[3][1]), (503, " ".join(bench[3][1].split()[1:])), (504, "the " * 3000)]
    return docs, bench


def frame(spark, bench):
    return spark.createDataFrame(bench, "item_id long, text string")


def test_against_all_windows(spark, documents):
    docs, bench = corpus()
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in dec.contaminated(documents(*docs), frame(spark, bench)).collect()}
    want = {(d, i): v for d, t in docs for i, x in bench if (v := plain(t, x or "")) is not None}
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want) and all(got[k] == want[k] for k in got)
    clean = dec.drop_contaminated(documents(*docs), frame(spark, bench)).collect()
    assert {r["doc_id"] for r in clean} == {d for d, _ in docs} - {d for d, _ in got}


def test_recall_at_the_border():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(2000)]
    for n, number in ((10, 150), (30, 150), (55, 100), (120, 40), (250, 20), (500, 10)):
        items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k in range(25)]
        index, hits, due = dec.Index(items), 0, 0
        texts = []
        for k in range(number):
            around = [rng.choice(vocabulary) for _ in range(12)]
            texts.append(" ".join([*around, *edited(rng, items[k % 25][1].split(), dec.edits_allowed(n)), *around]))
        found = {(t, i): d for t, i, d, *_ in index.search(texts)}
        for k, text in enumerate(texts):
            distance = plain(text, items[k % 25][1])
            if distance is not None:
                due += 1
                hits += found.get((k, k % 25)) == distance
        assert hits >= 0.97 * due > 0


def test_words_inserted_or_deleted_in_the_middle():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(900)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    index, texts = dec.Index([(7, " ".join(item))]), []
    for j in range(1, 10):
        texts += [" ".join(["a"] * 9 + item[:20] + ["new"] * j + item[20:] + ["b"] * 9), " ".join(["a"] * 9 + item[:20] + item[20 + j :] + ["b"] * 9)]
    assert index.search(texts) == [(t, 7, t // 2 + 1, 40, 9) for t in range(16)]


def test_best_runs_are_exact():
    rng = random.Random(3)
    for _ in range(400):
        a, b = [[rng.randrange(1, 6) for _ in range(rng.randrange(1, 90))] for _ in range(2)]
        distance, position = best(b, a)
        assert dec.best_run(a, b) == ((distance, position) if distance < len(a) else (len(a), 0))


def test_index_bytes_grow_with_the_words():
    items = [(k, " ".join(f"w{(k * 31 + j * 7) % 4001}" for j in range(5 + k))) for k in range(600)]
    assert len(pickle.dumps(dec.Index(items))) < 20 * sum(len(x) for _, x in items) / 10


def test_items_without_an_id_and_short_items(spark, documents):
    _, bench = corpus()
    ten = [(None, "one two three four five six seven eight nine ten"), (None, "ten nine eight seven six five four three two one")]
    found = dec.contaminated(documents((1, ten[0][1]), (2, ten[1][1])), frame(spark, bench + ten)).filter("item_words = 10").collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found) == [(1, None, 0), (2, None, 0)]
    assert sorted(r["item_id"] for r in dec.too_short(frame(spark, bench)).collect()) == [101, 102, 103]


def test_a_very_long_text():
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    assert [r[:3] for r in dec.Index([(3, " ".join(words[250_000:250_040]))]).search([" ".join(words)])] == [(0, 3, 0)]


def test_blocks_give_the_same(spark, documents, monkeypatch):
    docs, bench = corpus(seed=8, texts=40)
    whole = sorted(map(tuple, dec.contaminated(documents(*docs), frame(spark, bench)).collect()), key=str)
    monkeypatch.setattr(dec, "BLOCK_CHARS", 400)
    assert len(list(dec.blocks(frame(spark, bench)))) > 2
    assert sorted(map(tuple, dec.contaminated(documents(*docs), frame(spark, bench)).collect()), key=str) == whole


def test_empty_tables_repeated_rows_and_clashing_columns(spark, documents):
    docs, bench = corpus(texts=4)
    twice = documents((1, bench[0][1]), (1, bench[0][1]), (None, bench[0][1])).withColumn("item_id", F.lit(3)).withColumn("row", F.lit(4))
    got = dec.contaminated(twice, frame(spark, bench)).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["item_id"] == 0) == ["1", "1", "None"]
    assert dec.drop_contaminated(twice, frame(spark, bench)).count() == 0
    assert dec.contaminated(twice, frame(spark, bench).limit(0)).count() == 0
    kept = dec.drop_contaminated(twice, frame(spark, bench).limit(0))
    assert kept.count() == 3 and kept.columns == twice.columns
    assert dec.contaminated(twice.limit(0), frame(spark, bench)).count() == 0
