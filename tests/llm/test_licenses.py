import random
from collections import Counter

from pyspark.sql import functions as F

from tallyglass.llm import licenses
from tallyglass.llm.license_texts import TEMPLATES


def plain_best(text, templates, threshold):
    """{template: (largest coefficient of any passage, its length, whether one reaches the threshold)}, over all spans."""
    words, out = licenses.words_of(text), {}
    pairs = list(zip(words, words[1:]))
    for name, body in templates:
        own = licenses.words_of(body)
        a, best = Counter(zip(own, own[1:])), (0.0, 0)
        for s in range(len(pairs)):
            b, shared = Counter(), 0
            for e in range(s, len(pairs)):
                shared += b[pairs[e]] < a[pairs[e]]
                b[pairs[e]] += 1
                best = max(best, (2 * shared / (a.total() + e - s + 1), e - s + 1))
        if best[0] >= threshold:
            out[name] = max(out.get(name, (0.0, 0)), best)
    return out


def corpus():
    rng = random.Random(4)
    filler = "the of in and this for any to software work use".split() + [f"w{k}" for k in range(40)]
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    out = []
    for k in range(60):
        name, body = rng.choice(TEMPLATES)
        words = body.split()
        for _ in range(rng.randrange(0, 1 + len(words) // 12)):
            words[rng.randrange(len(words))] = "changed"
        out.append(f"{prose(rng.randrange(30))}\n{' '.join(words)}{rng.choice([' ', chr(10)])}{prose(rng.randrange(30))}" if k % 4 else prose(80))
    return out


def test_every_template_is_found_whole():
    scanner = licenses.Scanner(TEMPLATES)
    for name, body in TEMPLATES:
        found = scanner.scan(f"Notes before it.\n\n{body.upper()}\n\nand behind, of the kind.")
        assert [(f[0], round(f[1], 6)) for f in found][0][0] == name and found[0][1] > 0.95


def test_against_all_passages():
    for text in corpus()[:24]:
        for template in TEMPLATES[::3]:
            want = plain_best(text, [template], licenses.THRESHOLD)
            found = licenses.Scanner([template]).scan(text)
            assert bool(found) == bool(want)
            if want:
                best = max(found, key=lambda f: (f[1], f[3]))
                assert (best[1], best[3] - 1) == want[template[0]]
    scanner = licenses.Scanner(TEMPLATES)
    for text in corpus():
        found, words = scanner.scan(text), licenses.words_of(text)
        for name, likeness, at, n in found:
            pairs = Counter(zip(words[at : at + n], words[at + 1 : at + n]))
            assert likeness >= licenses.THRESHOLD
            assert any(abs(likeness - licenses.dice(pairs, t.bigrams)) < 1e-12 for t in scanner.templates if t.name == name)
        assert all(a + n <= b for (_, _, a, n), (_, _, b, _) in zip(found, found[1:]))


def test_stretched_and_shortened_licences_amid_prose():
    body = max((t for n, t in TEMPLATES if n == "MIT"), key=len).split()
    prose = "in the middle of the work any use of the software to the end and this for the".split() * 6
    scanner = licenses.Scanner(TEMPLATES)
    half = len(body) // 2
    for words, least in ((body[:half] + ["clause"] * 40 + body[half:], 0.88), (body[: len(body) * 3 // 4], 0.85), (body[len(body) // 4 :], 0.85)):
        found = scanner.scan(" ".join([*prose, *words, *prose]))
        assert [f[0] for f in found] == ["MIT"] and found[0][1] >= least


def test_many_notices_take_time_in_proportion():
    line = "Released under the MIT License. " + "x " * 8
    assert len(licenses.Scanner(TEMPLATES).scan(line * 4000)) == 4000


def test_repeats_and_versions():
    scanner = licenses.Scanner(TEMPLATES)
    line = "Licensed under the Apache License, Version 2.0."
    assert [f[0] for f in scanner.scan(f"{line}\n{'x ' * 30}\n{line}")] == ["Apache-2.0"] * 2
    assert [f[0] for f in scanner.scan("Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")] == ["CC-BY-NC-4.0", "MIT"]
    assert [f[0] for f in scanner.scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    assert scanner.scan("He was released under the bridge; the licence of the work.") == []


def test_operator(spark, documents):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (None, TEMPLATES[0][1]), (4, "the of " * 50_000)]
    docs = documents(*rows).withColumn("license", F.lit("x")).withColumn("dice", F.lit(1))
    got = sorted(str(r["doc_id"]) + r["license"] for r in licenses.scan_licenses(docs).collect())
    assert got == ["1MIT", "1MIT", "NoneMIT"]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
