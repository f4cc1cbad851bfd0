import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.llm import linedup


def plain(rows):
    """Brute force: walk through all chunks in order and keep the first of each text."""
    seen, out = {}, {}
    order = sorted({(i if i is not None else 1 << 63, i, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    for _, i, t in order:
        gone = set()
        for k, lines in linedup.text_chunks(t):
            body = "\n".join(lines)
            if body in seen:
                gone.add(k)
            seen[body] = True
        out[i, t] = linedup.without(t, gone)
    return out


def run(docs, rows, want):
    got = linedup.remove_repeated(docs, counts=True).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], set()).add(r["text"])
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert texts == {i: {want[i, t] if t is not None else None for j, t in rows if j == i} for i, _ in rows}


def corpus():
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 14))) for _ in range(60)]
    passage = [f"shared line {k} of a passage" for k in range(14)]
    rows = []
    for k in range(80):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        if k % 3 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage
        rows.append((k, "\n".join(lines)))
    rows += [(90 + k, rows[3][1]) for k in range(20)]
    return [*rows, (200, None), (201, ""), (202, "\n\n\n"), (203, "x " * 60), (204, "x " * 60), (205, "same\n" * 200), (None, rows[0][1])]


def test_against_brute_force(documents):
    rows = corpus()
    run(documents(*rows), rows, plain(rows))


def test_passages_are_cut_alike_wherever_they_stand():
    passage = [f"line number {k}" for k in range(12)]
    inner = lambda lines: {tuple(lines[a:b]) for a, b in linedup.line_chunks(lines)}
    a, b = inner(["q", *passage, "z"]), inner(["other", "start", "here", *passage, "end"])
    shared = [c for c in a & b if set(c) <= set(passage)]
    assert sum(map(len, shared)) >= 6


def test_long_lines_are_passages_and_short_ones_stay(documents):
    long = " ".join(f"v{k}" for k in range(60))
    rows = [(1, f"{long}"), (2, f"{long}"), (3, "short line"), (4, "short line")]
    got = {r["doc_id"]: r["text"] for r in linedup.remove_repeated(documents(*rows)).collect()}
    assert got == {1: long, 2: "", 3: "short line", 4: "short line"}


def test_repeated_rows_clashing_columns_and_empty_table(documents):
    text = "one two\nthree four\nfive six\nseven eight\nnine ten"
    docs = documents((7, text), (7, text), (8, text)).withColumn("chunk", F.lit("c")).withColumn("h1", F.lit(1)).withColumn("body", F.lit(2))
    got = linedup.remove_repeated(docs)
    assert got.columns == docs.columns
    texts = sorted((r["doc_id"], len(r["text"])) for r in got.collect())
    assert texts[0] == texts[1] and texts[0][1] == len(text) and texts[2][1] < len(text)
    assert linedup.remove_repeated(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["", "a", "b b", "c"]), max_size=90))
def test_chunks_cover_the_lines(lines):
    text = "\n".join(lines)
    spans = linedup.line_chunks(text.split("\n"))
    assert [x for a, b in spans for x in range(a, b)] == list(range(len(text.split("\n"))))
    assert linedup.without(text, []) == text


@pytest.mark.parametrize("text", ["", "x" * 300_000, "y\n" * 20_000])
def test_long_texts(text):
    assert linedup.without(text, []) == text


def due(rows):
    """Lines, by document, in a run of at least 50 words that stands earlier too: brute force over all runs of lines."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines, gone, own = text.split("\n"), set(), []
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(x.split()) for x in run) >= 50 and lines[a].strip() and lines[b - 1].strip():
                    gone |= set(range(a, b)) if run in seen else set()
                    own.append(run)
        seen.update(own)
        out[i] = gone
    return out


def test_whole_line_passages_go_between_any_neighbours(documents):
    rng = random.Random(7)
    words = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for lines in (1, 2, 3, 4, 5, 6, 9):
        for gaps in (False, True):
            each = -(-54 // lines) if lines % 2 else 60
            passage = [words(each + rng.randrange(3)) for _ in range(lines)]
            passage = [x for line in passage for x in (line, "")][:-1] if gaps else passage
            for _ in range(4):
                before, after = [words(rng.randrange(2, 9)) for _ in range(3)], [words(rng.randrange(2, 9)) for _ in range(2)]
                rows.append((len(rows), "\n".join([*before, *passage, *after])))
    gone = due(rows)
    assert sum(map(len, gone.values())) > 200
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in linedup.remove_repeated(documents(*rows)).collect()} == want


def test_a_passage_that_overlaps_itself_keeps_its_first(documents):
    rows = [(1, "a b\nc\n" * 60), (2, "x\n" + "a b\nc\n" * 60)]
    got = {r["doc_id"]: r["text"] for r in linedup.remove_repeated(documents(*rows)).collect()}
    assert 50 <= len(got[1].split()) < 60
    assert got[2].split() == ["x"]
