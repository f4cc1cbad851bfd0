"""Language identification with a string kernel.

A text's blended spectrum is the set of its character n-grams of lengths 1 to LONGEST over lower-case letters,
any other characters counting as one kind of gap. The presence kernel of two texts is the number of n-grams
they share over the root of the product of their numbers. Nystroem landmarks, dealt evenly over the languages,
give each text finite coordinates, on which a one-versus-rest kernel ridge regression is solved in closed form.
The kernel is linear in the presence vectors, so landmarks, whitening and regression fold into one matrix, and a
batch of texts is scored by one product of its presence matrix with it.

Learned from at most PER_LANGUAGE rows of each of MOST_LANGUAGES languages, chosen by a hash of the id; what goes to the driver is a
bit vector of SLOTS bits for each. N-grams are hashed into SLOTS slots.

Defined cases: a null text or one without letters is `und` with score 0, as is every text where nothing was
learned; rows with null ids or languages are not learned from; repeated rows get equal predictions; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import fold, small_batches, text_or_empty, texts
from tallyglass.llm.sampling import place, threshold

LONGEST = 3
SLOTS = 1 << 15
PER_LANGUAGE = 500
#: Languages that can be learned, the most frequent ones.
MOST_LANGUAGES = 500
LANDMARKS = 240
RIDGE = 1e-2
SHARPNESS = 4.0
FOLDS = 4
HELD_OUT = 2
UNKNOWN = "und"
BATCH = 64

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each character of all planes is a letter."""
    if not _letters:
        _letters.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _letters[0]


def spectrum(text: str) -> np.ndarray | None:
    """Which slots the n-grams of a whole text fall into; None where it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _is_letter()[points]
    if not letters.any():
        return None
    # one gap for each run of other characters, and one at either end
    codes = np.concatenate(([0], np.where(letters, points, 0), [0])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] > 0) | (codes[:-1] > 0)))]
    present = np.zeros(SLOTS, bool)
    grams = np.zeros(len(codes), np.uint64)
    for n in range(LONGEST):
        if len(codes) <= n:
            break
        grams = (grams[: len(codes) - n] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[n:] + np.uint64(n + 1))
        mixed = (grams ^ grams >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        present[(mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)] = True
    return present


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def outputs(self, spectra: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest outputs of a batch: a product of its presence matrix with the folded weights."""
        presence = np.array(spectra, np.float32)
        return presence @ self.weights / np.sqrt(presence.sum(1, keepdims=True)) + self.bias

    def predict(self, batch: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(batch)
        for at in range(0, len(batch), BATCH):
            found = {k: s for k, t in enumerate(batch[at : at + BATCH], at) if (s := spectrum(t)) is not None}
            if found:
                raised = np.exp(SHARPNESS * self.outputs(list(found.values())))
                shares = raised / raised.sum(1, keepdims=True)
                for k, row in zip(found, shares, strict=True):
                    out[k] = (self.languages[int(row.argmax())], float(min(1.0, row.max())))
        return out


def fit(spectra: np.ndarray, languages: list[str]) -> Model:
    """Nystroem landmarks and one-versus-rest ridge regression on rows of presence bits."""
    names = sorted(set(languages))
    kind = np.array([names.index(x) for x in languages])
    rows = spectra.astype(np.float32)
    rows /= np.sqrt(rows.sum(1, keepdims=True))
    each = max(1, LANDMARKS // len(names))
    marks = np.concatenate([np.flatnonzero(kind == k)[:each] for k in range(len(names))])
    landmarks = rows[marks]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    coordinates = (rows @ landmarks.T) @ whiten
    centre = coordinates.mean(0)
    target = np.where(kind[:, None] == np.arange(len(names)), 1.0, -1.0)
    # languages weigh alike however many rows each has
    share = 1 / (np.bincount(kind)[kind] * len(names))
    mean = (target * share[:, None]).sum(0)
    x = coordinates - centre
    solved = np.linalg.solve((x * share[:, None]).T @ x + RIDGE * np.eye(x.shape[1]) / len(names), (x * share[:, None]).T @ (target - mean))
    folded = landmarks.T @ (whiten @ solved)
    return Model(names, folded.astype(np.float32), mean - centre @ solved)


def train(docs: DataFrame, learn=None) -> Model | None:
    """Fit on the rows that `learn` (a condition on doc_id) lets through; None where nothing can be learned."""
    small_batches(docs.sparkSession)
    learn = fold(parts=FOLDS) != HELD_OUT if learn is None else learn
    own = docs.select("doc_id", F.col("lang").alias("language"), "text").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & learn
    )
    # An id counts once for each of its languages, however many rows repeat it: with the text of the least hash.
    named = own.groupBy("language", "doc_id").agg(F.min(F.xxhash64("text")).alias("digest"))
    # Few more ids than wanted pass the threshold of their language, so the cut of a language sees no more than that.
    common = named.groupBy("language").count().orderBy(F.desc("count"), "language").limit(MOST_LANGUAGES)
    first = Window.partitionBy("language").orderBy(place(), "doc_id")
    chosen = (
        named.join(F.broadcast(common), "language")
        .filter(place() < threshold(PER_LANGUAGE, F.col("count")))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= PER_LANGUAGE)
        .select("doc_id", "language", "digest")
    )

    def run(batches):
        for batch in batches:
            found = [(i, x, s) for i, x, t in zip(batch["doc_id"], batch["language"], texts(batch), strict=True) if (s := spectrum(t)) is not None]
            yield pd.DataFrame([(i, x, np.packbits(s).tobytes()) for i, x, s in found], columns=["doc_id", "language", "bits"])

    own = own.select(F.col("doc_id").cast("string").alias("doc_id"), "language", "text", F.xxhash64("text").alias("digest"))
    chosen = chosen.withColumn("doc_id", F.col("doc_id").cast("string"))
    sample = own.join(F.broadcast(chosen), ["doc_id", "language", "digest"]).select("doc_id", "language", "text")
    sample = sample.mapInPandas(run, "doc_id string, language string, bits binary").dropDuplicates(["doc_id", "language"])
    rows = sorted((r["language"], bytes(r["bits"])) for r in sample.collect())
    if not rows:
        return None
    order = np.random.default_rng(5).permutation(len(rows))
    bits = np.unpackbits(np.frombuffer(b"".join(rows[k][1] for k in order), np.uint8).reshape(len(rows), -1), axis=1)
    return fit(bits, [rows[k][0] for k in order])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = model.predict(list(texts(batch))) if model else [(UNKNOWN, 0.0)] * len(batch)
            frame = pd.DataFrame(found, columns=["lang_pred", "score"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    held_out = F.coalesce(fold(parts=FOLDS) == HELD_OUT, F.lit(False))
    return asked.mapInPandas(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
