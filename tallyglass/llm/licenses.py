"""Licence scans: passages of normalised text compared with templates by the Dice coefficient of word bigrams.

Normalised text is its words of ASCII letters and digits in lower case. Size bounds prune and lose nothing: a
coefficient of t needs sizes of at most (2 - t) / t to one and an overlap of at least t / (2 - t) of the template. So
only zones are looked at where that many of a template's bigrams lie within the longest passage allowed, and in them
only passages that start and end on a bigram of the template, since any other gains by being cut to one. From every
start the passage with the largest coefficient counts (of equal ones the longest); repeats count as often as both
have them. Of one template's overlapping passages the one with the largest coefficient stays, then of all overlapping
ones that with the largest product of coefficient and words, so a full header wins over the notice inside it.

Defined cases: null and empty texts hold no licence; a text that repeats a notice reports each passage; repeated
rows are reported alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import small_batches, text_or_empty, texts
from tallyglass.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
FOUND = "doc_id long, license string, dice double, first_word long, n_words long"

_word = re.compile(r"[a-z0-9]+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def dice(a: Counter, b: Counter) -> float:
    """Twice the shared bigrams over all bigrams of both, counted with repeats."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


@dataclass
class Template:
    name: str
    size: int
    bigrams: Counter
    #: The fewest shared bigrams and the most bigrams of a passage that can reach the threshold.
    least: int
    most: int


class Scanner:
    """Templates ready to be searched for."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates, self.holders = [], {}
        for k, (name, text) in enumerate(templates):
            words = words_of(text)
            bigrams = Counter(zip(words, words[1:], strict=False))
            size, part = bigrams.total(), threshold / (2 - threshold)
            self.templates.append(Template(name, size, bigrams, max(1, math.ceil(size * part - 1e-9)), int(size / part + 1e-9)))
            for pair in bigrams:
                self.holders.setdefault(pair, []).append(k)

    def zones(self, words: list[str]):
        """(template, places, bigrams) of its bigrams in each zone that could hold a passage like a template."""
        hits: dict[int, list[int]] = {}
        pairs = list(zip(words, words[1:], strict=False))
        for at, pair in enumerate(pairs):
            for k in self.holders.get(pair, ()):
                hits.setdefault(k, []).append(at)
        for k, found in hits.items():
            template = self.templates[k]
            need = template.least
            if len(found) < need:
                continue
            places = np.array(found)
            close = np.flatnonzero(places[need - 1 :] - places[: len(places) - need + 1] < template.most)
            if not len(close):
                continue
            for run in np.split(close, np.flatnonzero(np.diff(close) > need) + 1):
                zone = found[run[0] : run[-1] + need]
                yield template, zone, [pairs[at] for at in zone]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first word, words) of every passage that reaches the threshold."""
        words, found = words_of(text), []
        for template, places, pairs in self.zones(words):
            tried = [(template.name, likeness, at, n + 1) for likeness, at, n in self._passages(template, places, pairs)]
            found += self._apart(tried, lambda f: (-f[1], -f[3], f[2]))
        return self._apart(found, lambda f: (-f[1] * f[3], -f[1], f[2], f[0]))

    def _passages(self, template: Template, places: list[int], pairs: list[tuple[str, str]]):
        """(coefficient, first bigram, bigrams) of the best passage from each start that reaches the threshold."""
        size, most, limit = template.size, template.most, template.bigrams
        # Bigrams shared, with repeats, by the longest passage from each start: what no shorter one exceeds.
        held, shared, end = Counter(), 0, 0
        for i, first in enumerate(places):
            while end < len(places) and places[end] - first < most:
                shared += held[pairs[end]] < limit[pairs[end]]
                held[pairs[end]] += 1
                end += 1
            if shared >= template.least:
                own, overlap, best = Counter(), 0, (0.0, 0)
                for j in range(i, end):
                    pair = pairs[j]
                    if own[pair] < limit[pair]:
                        overlap += 1
                        own[pair] += 1
                        n = places[j] - first + 1
                        best = max(best, (2 * overlap / (n + size), n))
                if best[0] >= self.threshold - 1e-12:
                    yield best[0], first, best[1]
            held[pairs[i]] -= 1
            shared -= held[pairs[i]] < limit[pairs[i]]

    @staticmethod
    def _apart(found, order):
        """In this order, the passages that overlap none before them."""
        starts, ends, kept = [], [], []
        for passage in sorted(set(found), key=order):
            at, end = passage[2], passage[2] + passage[3]
            k = bisect_right(starts, at)
            if (not k or ends[k - 1] <= at) and (k == len(starts) or starts[k] >= end):
                starts.insert(k, at)
                ends.insert(k, end)
                kept.append(passage)
        return sorted(kept, key=lambda f: f[2])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each licence passage of each document."""
    small_batches(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, threshold)

    def run(batches):
        for batch in batches:
            rows, ids = [], batch["doc_id"].astype("Int64").to_numpy()
            for k, text in enumerate(texts(batch)):
                rows += [(ids[k], *f) for f in scanner.scan(text)]
            frame = pd.DataFrame(rows, columns=["doc_id", "license", "dice", "first_word", "n_words"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, FOUND)
