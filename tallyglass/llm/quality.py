"""Quality classifier learned from trusted positives and unlabelled text.

The features are statistics of a whole text (kinds of characters, repeated words and lines, word lengths).
A small network minimises the non-negative unbiased risk (Kiryo et al. 2017): positives are rows labelled 1,
the unlabelled ones are rows without a label, and labels of 0 are never learned from. The share of positives
in unlabelled text is estimated by the best-bin bound of Garg et al. (2021) on the scores of a first fit.

Training uses at most SAMPLE rows of either kind, chosen by a hash of the id; their features (not their texts)
go to the driver, about SAMPLE * FEATURES numbers. Every row is scored in its own task.

Defined cases: null and empty texts are scored like any text without characters; repeated rows get equal
scores; without positives or without any other text nothing can be learned and every score is 1; an empty
table gives an empty result; further columns are kept by `keep_good` and ignored by `score`.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import fold, small_batches, text_or_empty, texts
from tallyglass.llm.sampling import place, threshold

SAMPLE = 12_000
HIDDEN = 32
#: Steps of the optimiser, and rows of either kind in a step: alike for small and large samples.
STEPS = 270
BATCH = 4096
RATE = 1e-2
DECAY = 1e-4
FOLDS = 5
HELD_OUT = 0
THRESHOLD = 0.3
SEED = 7
#: A fresh estimate of the prior stays below one so that the risk of the unlabelled part keeps a meaning.
MOST_PRIOR = 0.98

MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
KINDS = sorted({"Lu", "Ll", "Lo", "Nd", "Zs", "Cc", "Po", "Pd", "Sm", "Sc", "So", "Xx"})
WORD_LENGTHS = 16
FEATURES = len(MARKS) + len(KINDS) + WORD_LENGTHS + 10

_kind_of: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane, as a position in KINDS."""
    if not _kind_of:
        place = {k: i for i, k in enumerate(KINDS)}
        rest = place["Xx"]
        _kind_of.append(np.array([place.get(unicodedata.category(chr(c)), rest) for c in range(0x10000)], np.uint8))
    return _kind_of[0]


def features(text: str) -> np.ndarray:
    """Statistics of a whole text, all of about unit size."""
    out = np.zeros(FEATURES, np.float32)
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = max(n, 1)
    ascii_counts = np.bincount(points[points < 128], minlength=128)
    out[: len(MARKS)] = np.sqrt(ascii_counts[MARKS] / total)
    kinds = np.bincount(_kinds()[np.minimum(points, 0xFFFF)], minlength=len(KINDS)) / total
    at = len(MARKS)
    out[at : at + len(KINDS)] = np.sqrt(kinds)
    at += len(KINDS)
    words = text.split()
    count = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[at : at + WORD_LENGTHS] = np.sqrt(np.bincount(np.minimum(lengths, WORD_LENGTHS) - 1, minlength=WORD_LENGTHS) / count)
    at += WORD_LENGTHS
    lines = text.split("\n")
    distinct = len(set(words))
    pairs = set(zip(words, words[1:], strict=False))
    out[at:] = [
        np.log1p(n) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(len(words) / len(lines)) / 5,
        sum(map(eq, words, words[1:])) / count,
        distinct / count,
        np.log1p(distinct) / 10,
        len(pairs) / count,
        len(set(lines)) / len(lines),
        sum(line.rstrip()[-1:] in set(".!?") for line in lines) / len(lines),
        len(max(words, key=len, default="")) / (len(max(words, key=len, default="")) + 50),
    ]
    return out


@dataclass
class Network:
    """Standardised features, one hidden layer, one logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return (np.maximum(self._standard(x) @ w1 + b1, 0) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)


def risk_slope(z: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """How the minimised risk changes with each logit, the first n_p of them of positives.

    Where the estimate of the negative risk falls below zero, that part alone counts, reversed.
    """
    sigma = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    as_negative = np.logaddexp(0, z)  # loss of calling a row negative
    negative_risk = as_negative[n_p:].mean() - prior * as_negative[:n_p].mean()
    slope = np.zeros_like(z)
    slope[n_p:] = sigma[n_p:] / (len(z) - n_p)
    slope[:n_p] = -prior * sigma[:n_p] / n_p
    if negative_risk < 0:
        return -slope
    slope[:n_p] += prior * (sigma[:n_p] - 1) / n_p
    return slope


def non_negative_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Network:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss, by Adam.

    Where a batch's estimate of the negative risk falls below zero, the step goes against that part, as the
    non-negative estimator prescribes.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 0.02, [])
    p, u = net._standard(positive), net._standard(unlabelled)
    width = p.shape[1]
    net.weights = [
        rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)).astype(np.float32),
        np.zeros(1, np.float32),
    ]
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    draw = lambda rows: rows if len(rows) <= BATCH else rows[rng.integers(0, len(rows), BATCH)]
    for step in range(1, STEPS + 1):
        x_p, x_u = draw(p), draw(u)
        x = np.concatenate([x_p, x_u])
        w1, b1, w2, b2 = net.weights
        hidden = np.maximum(x @ w1 + b1, 0)
        z = (hidden @ w2 + b2)[:, 0]
        slope = risk_slope(z, len(x_p), prior)
        back = (slope[:, None] @ w2.T) * (hidden > 0)
        grads = [x.T @ back + DECAY * w1, back.sum(0), hidden.T @ slope[:, None] + DECAY * w2, np.array([slope.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            move = RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            net.weights[i] = (net.weights[i] - move).astype(np.float32)
    return net


def class_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives in unlabelled text: the least ratio of upper bounds over all score cuts."""
    cuts = np.sort(positive_scores)
    above_p = 1 - np.arange(len(cuts)) / len(cuts)
    above_u = 1 - np.searchsorted(np.sort(unlabelled_scores), cuts) / len(unlabelled_scores)
    slack = lambda n: np.sqrt(np.log(4 / delta) / (2 * n))
    bound = (above_u + slack(len(unlabelled_scores)) + slack(len(cuts))) / above_p
    best = int(np.argmin(bound[above_p > 0.05]))
    return float(min(MOST_PRIOR, max(0.02, above_u[best] / above_p[best])))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Network, float]:
    """A first fit at an even prior ranks the texts; half of each kind, left out of it, gives the prior."""
    net = non_negative_fit(positive[::2], unlabelled[::2], 0.5)
    odd_p, odd_u = positive[1::2] if len(positive) > 1 else positive, unlabelled[1::2] if len(unlabelled) > 1 else unlabelled
    prior = class_prior(net.logits(odd_p), net.logits(odd_u))
    return non_negative_fit(positive, unlabelled, prior), prior


def _featured(chosen: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            made = [features(t).tolist() for t in texts(batch)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "kind": batch["kind"], "x": made})

    chosen = chosen.select(F.col("doc_id").cast("string").alias("doc_id"), "kind", "text")
    return chosen.mapInPandas(run, "doc_id string, kind int, x array<float>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn=None) -> Network | None:
    """Fit on rows that `learn` (a condition on doc_id) lets through; None where nothing can be learned."""
    small_batches(docs.sparkSession)
    learn = fold(parts=FOLDS) != HELD_OUT if learn is None else learn
    own = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("digest")).filter(F.col("doc_id").isNotNull() & learn)
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # An id counts once, however many rows repeat it: with the text of the least hash.
    marked = own.groupBy("doc_id").agg(F.min("digest").alias("digest")).join(marks, "doc_id", "left")
    kind = F.when(F.col("quality") == 1, 1).when(F.col("quality").isNull(), 0)
    marked = marked.select("doc_id", "digest", kind.alias("kind")).filter("kind is not null")
    # Few more ids than wanted pass the threshold of their kind, so the cut sees no more whatever the table's size.
    counts, chosen = {r["kind"]: r["count"] for r in marked.groupBy("kind").count().collect()}, None
    for k in (1, 0):
        some = marked.filter((F.col("kind") == k) & (place() < threshold(sample, F.lit(max(counts.get(k, 0), 1)))))
        some = some.orderBy(place(), "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    # At most 2 * sample ids: a bound of the operator, so they may be sent to every task.
    found = _featured(own.join(F.broadcast(chosen), ["doc_id", "digest"])).dropDuplicates(["doc_id"]).collect()
    x = np.array([r["x"] for r in found], np.float32).reshape(-1, FEATURES)
    kinds = np.array([r["kind"] for r in found])
    order = np.lexsort(x.T) if len(x) else []
    x, kinds = x[order], kinds[order]
    positive, unlabelled = x[kinds == 1], x[kinds == 0]
    if len(positive) < 2 or len(unlabelled) < 2:
        return None
    rng = np.random.default_rng(SEED)
    return fit(rng.permutation(positive), rng.permutation(unlabelled))[0]


def score(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [features(t) for t in texts(batch)]
            found = net.scores(np.array(made)).astype(float) if net and made else np.ones(len(made))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": found})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, score double")
    held_out = F.coalesce(fold(parts=FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    if net is None:
        return docs

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        return pd.Series(net.scores(np.array([features(t) for t in column])).astype(float))

    return docs.filter(scored(text_or_empty()) >= threshold)

