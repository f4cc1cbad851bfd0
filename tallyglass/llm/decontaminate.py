"""Benchmark decontamination: passages within a fifth of an item's words in edit distance.

Texts are words (letters and digits, lower case). Every window of an item's length is a candidate, first
thinned by a test that loses nothing: k edits leave at least n - 1 - 2k of an item's n - 1 word pairs, and the
item-sized window from the passage's first word on (at the end of a text: the last one) holds as many, since a
passage longer by j words took j insertions, which break one pair each where other edits break two. The
rest is embedded by the CGK random walk (Chakraborty, Goldenberg and Koucky 2016): a walk copies the current
word and moves on or stays by a random bit of step and word, so few edits become few differing places.
WALKS walks with TABLES samples of a few places each are hashed; a window that meets an item in any table is
verified. The miss rate of one table is raised to the power WALKS * TABLES. Places agree less the more edits
there are, so long items sample fewer places at once (`places`), which keeps the recall up at any length.

Verifying is exact and free of the window's ends: the least edit distance of the item to any run of words among
those of the met windows and as many words around them as edits are allowed (Myers' bit vectors, 1999).

The benchmark is read in blocks of bounded size, so what goes to the tasks does not grow with it, and the bytes of
a block grow with its words alone; each block is one pass over the texts, and nothing is shuffled.

Defined cases: null and empty texts hold nothing; items of fewer than MIN_WORDS words are too short to tell,
are left out and listed by `too_short`; a text shorter than an item is compared as a whole; equal items are all
reported, items without an id under a null id, items that share an id but not a text one by one; repeated
rows are reported alike; empty tables give an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tallyglass.llm.common import small_batches, text_or_empty

EDITS = 0.2
MIN_WORDS = 5
WALKS = 8
TABLES = 8
SEED = 17
BATCH_TEXTS = 512
#: Characters of benchmark text in one block, and windows handled at a time.
BLOCK_CHARS = 4_000_000
SLICE = 4096
CELLS = SLICE * 64
PAIR_BITS = 20
LONG_TEXT = 1_000_000

HITS = "doc_id long, item_id long, distance int, item_words int, position long, similarity double"

_word = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def edits_allowed(n: int) -> int:
    return int(EDITS * n + 1e-9)


def places(n: int) -> int:
    """Places in one sample for items of n words."""
    return 3 if n <= 16 else 2 if n <= 64 else 1


def _pair_slots(ids: np.ndarray) -> np.ndarray:
    """Slots of neighbouring word pairs in a bit table."""
    mixed = (ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids[1:].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def embed(rows: np.ndarray, sizes: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """The random-walk embedding of rows of word ids, row i holding sizes[i] of them and -1 behind.

    Column j holds the word the walk stands on after j steps; behind the end it stays at -1.
    """
    padded = np.concatenate([rows, np.full((len(rows), 1), -1, rows.dtype)], axis=1)
    flat, first = padded.ravel(), np.arange(len(rows)) * padded.shape[1]
    place, last = first.copy(), first + sizes
    codes = ((flat + 2) * 2 + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((len(coins), len(rows)), np.int64)
    for step, coin in enumerate(coins):
        out[step] = flat[place]
        mixed = codes[place] * coin
        place = np.minimum(place + ((mixed ^ mixed >> np.uint64(29)) >> np.uint64(20) & np.uint64(1)).astype(np.int64), last)
    return out.T


def word_masks(item: list[int]) -> dict[int, int]:
    """The places of each word of an item, as bits."""
    out: dict[int, int] = {}
    for place, word in enumerate(item):
        out[word] = out.get(word, 0) | 1 << place
    return out


def distances(masks: dict[int, int], n: int, words: list[int], anchored: bool) -> Iterator[int]:
    """For each word the exact edit distance of an item of n words, given as masks, to a run that ends with it.

    The run begins with the first word (anchored) or wherever the distance is least: Myers' bit vectors.
    """
    full, top, lead = (1 << n) - 1, 1 << n - 1, int(anchored)
    plus, minus, score = full, 0, n
    for word in words:
        equal = masks.get(word, 0)
        down = equal | minus
        across = ((equal & plus) + plus ^ plus) | equal
        more = minus | full & ~(across | plus)
        less = plus & across
        score += (1 if more & top else 0) - (1 if less & top else 0)
        more, less = (more << 1 | lead) & full, less << 1 & full
        plus, minus = less | full & ~(down | more), more & down
        yield score


def best_run(item: list[int], words: list[int]) -> tuple[int, int]:
    """The least edit distance of an item to any run of words, and where the run starts.

    Of equally near runs the one that ends first counts, and of these the shortest.
    """
    n = len(item)
    scores = list(distances(word_masks(item), n, words, False))
    least = min(scores, default=n)
    if least >= n:
        return n, 0
    end = scores.index(least) + 1
    behind = distances(word_masks(item[::-1]), n, words[:end][::-1], True)
    return least, end - 1 - next(k for k, score in enumerate(behind) if score == least)


def walk_coins(longest: int) -> list[np.ndarray]:
    """The random bits of each walk: an odd multiplier for every step, over twice the longest item."""
    return [np.random.default_rng((SEED, walk)).integers(1, 1 << 62, 2 * longest, np.uint64) * np.uint64(2) + np.uint64(1) for walk in range(WALKS)]


class Length:
    """The items of one length, embedded and hashed."""

    def __init__(self, n: int, rows: list[tuple[int | None, list[int]]]):
        self.n = n
        self.numbers = [i for i, _ in rows]
        self.items = np.array([w for _, w in rows], np.int32)
        rng = np.random.default_rng((SEED, WALKS, n))
        # A walk takes two steps a word on average; places behind that mostly hold the end for any text.
        self.samples = rng.integers(0, 2 * n, (WALKS, TABLES, places(n)))
        self.salts = rng.integers(1, 1 << 62, (WALKS, TABLES), np.uint64)
        self.keys = self.owners = None

    def prepare(self, coins: list[np.ndarray]) -> None:
        each, made = max(1, CELLS // self.n), []
        for at in range(0, len(self.items), each):
            items = self.items[at : at + each].astype(np.int64)
            sizes = np.full(len(items), self.n)
            made.append(self.hashes(np.stack([embed(items, sizes, c[: 2 * self.n]) for c in coins])))
        hashed = np.concatenate(made, axis=1)
        order = np.argsort(hashed, axis=None, kind="stable")
        self.keys, self.owners = hashed.ravel()[order], order % len(self.items)

    def slots(self) -> np.ndarray:
        """Slots of the word pairs of all items."""
        items = self.items.astype(np.int64)
        return _pair_slots(np.concatenate([items, np.zeros((len(items), 1), np.int64)], axis=1).ravel())

    def hashes(self, embedded: np.ndarray) -> np.ndarray:
        """The hashes of rows, embedded under every walk, in each table; tables are told apart by their salt."""
        mixed = np.repeat(self.salts[:, :, None], embedded.shape[1], axis=2)
        for k in range(self.samples.shape[2]):
            places = embedded[np.arange(WALKS)[:, None], :, self.samples[:, :, k]].astype(np.uint64)
            mixed = (mixed ^ places) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
        return mixed.reshape(WALKS * TABLES, -1)

    def candidates(self, embedded: np.ndarray) -> np.ndarray:
        """(row, item) pairs that meet in some table, each once."""
        hashed = self.hashes(embedded)
        low, high = np.searchsorted(self.keys, hashed, "left").ravel(), np.searchsorted(self.keys, hashed, "right").ravel()
        met = np.flatnonzero(high > low)
        counts = (high - low)[met]
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        items = self.owners[np.repeat(low[met], counts) + inner]
        pairs = np.unique(np.repeat(met % hashed.shape[1], counts) * len(self.items) + items)
        return np.stack([pairs // len(self.items), pairs % len(self.items)], axis=1)


class Index:
    """A block of benchmark items ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]):
        split = [(number, words_of(text or "")) for number, text in items]
        split = [(number, words) for number, words in split if len(words) >= MIN_WORDS]
        vocabulary = sorted({w for _, words in split for w in words})
        self.ids = {w: k + 1 for k, w in enumerate(vocabulary)}
        by_length: dict[int, list] = {}
        for number, words in sorted(split, key=lambda x: (len(x[1]), x[0] is None, x[0] or 0, x[1])):
            by_length.setdefault(len(words), []).append((number, [self.ids[w] for w in words]))
        self.lengths = [Length(n, rows) for n, rows in by_length.items()]
        self.ready = False

    def prepare(self) -> None:
        if not self.ready:
            self.coins = walk_coins(max((length.n for length in self.lengths), default=0))
            self.pairs, self.own = np.zeros(1 << PAIR_BITS, bool), np.zeros(1 << PAIR_BITS, bool)
            for length in self.lengths:
                length.prepare(self.coins)
                self.pairs[length.slots()] = True
            # A slot that no pair of any item has, for pairs with a word of no item.
            self.nowhere = int(np.argmin(self.pairs))
            self.ready = True

    def word_ids(self, text: str) -> np.ndarray:
        """Ids of a text's words; words of no item are 0."""
        get = self.ids.get
        lower = text.lower()
        if len(lower) <= LONG_TEXT:
            return np.array([get(w, 0) for w in _word.findall(lower)], np.int64)
        return np.fromiter((get(m.group(), 0) for m in _word.finditer(lower)), np.int64)

    def search(self, texts: list[str]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item id, distance, item words, position of the nearest run) of every text and item that match."""
        self.prepare()
        if not self.lengths or not texts:
            return []
        parts, owners = [], []
        gap = np.zeros(1, np.int64)
        for k, text in enumerate(texts):
            ids = self.word_ids(text)
            parts += [ids, gap]
            owners.append(len(ids) + 1)
        words = np.concatenate(parts)
        firsts = np.concatenate(([0], np.cumsum(owners)[:-1]))
        owner = np.repeat(np.arange(len(texts)), owners)
        slots = np.where((words[:-1] > 0) & (words[1:] > 0), _pair_slots(words), self.nowhere)
        known = np.concatenate(([0], np.cumsum(self.pairs[slots])))
        lengths_of = np.array(owners) - 1
        asked: list[tuple[int, np.ndarray, int]] = []
        for own, length in enumerate(self.lengths):
            n, k = length.n, edits_allowed(length.n)
            need, each = n - 1 - 2 * k, max(1, CELLS // length.n)
            if len(words) > n:
                starts = np.flatnonzero(known[n - 1 :] - known[: len(known) - n + 1] >= need)
                starts = starts[starts - firsts[owner[starts]] + n <= lengths_of[owner[starts]]]
                if len(starts):
                    # the same test against the pairs of items of this length alone
                    pairs = length.slots()
                    self.own[pairs] = True
                    held = [starts[at : at + each] for at in range(0, len(starts), each)]
                    held = [some[self.own[slots[some[:, None] + np.arange(n - 1)]].sum(1) >= need] for some in held]
                    self.own[pairs] = False
                    asked += [(own, some, n) for some in held if len(some)]
            for t in np.flatnonzero((lengths_of < n) & (lengths_of >= n - k)):
                asked.append((own, firsts[t : t + 1], int(lengths_of[t])))
        met = []
        while asked:
            widest = self.lengths[asked[0][0]].n
            size, together = 0, 0
            for own, starts, _ in asked:
                size += len(starts)
                # lengths that differ much aren't padded to the same width
                if together and (size * self.lengths[own].n > CELLS or self.lengths[own].n > 2 * widest):
                    break
                together += 1
            met += self._meet(asked[:together], words)
            asked = asked[together:]
        return self._verify(met, words, owner, firsts, lengths_of)

    def _meet(self, asked, words) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
        """(length, items, starts, window size) of windows that meet an item of their length."""
        starts = np.concatenate([s for _, s, _ in asked])
        sizes = np.concatenate([np.full(len(s), size) for _, s, size in asked])
        widest = max(self.lengths[own].n for own, _, _ in asked)
        across = np.arange(widest)
        rows = np.where(across < sizes[:, None], words[np.minimum(starts[:, None] + across, len(words) - 1)], -1)
        embedded = np.stack([embed(rows, sizes, coins[: 2 * widest]) for coins in self.coins])
        at, out = 0, []
        for own, some, size in asked:
            pairs = self.lengths[own].candidates(embedded[:, at : at + len(some)])
            if len(pairs):
                out.append((own, pairs[:, 1], some[pairs[:, 0]], size))
            at += len(some)
        return out

    def _verify(self, met, words, owner, firsts, lengths_of) -> list[tuple[int, int | None, int, int, int]]:
        """The nearest run of each text and item among the met windows and the words around them."""
        found = []
        for own in sorted({m[0] for m in met}):
            length, mine = self.lengths[own], [m for m in met if m[0] == own]
            n, k = length.n, edits_allowed(length.n)
            items = np.concatenate([m[1] for m in mine])
            starts = np.concatenate([m[2] for m in mine])
            ends = starts + np.concatenate([np.full(len(m[2]), m[3]) for m in mine])
            texts = owner[starts]
            low, high = np.maximum(starts - k, firsts[texts]), np.minimum(ends + k, firsts[texts] + lengths_of[texts])
            order = np.lexsort((low, items, texts))
            texts, items, low, high = texts[order], items[order], low[order], high[order]
            # stretches of one text and item that overlap are searched as one
            fresh = np.ones(len(low), bool)
            fresh[1:] = (texts[1:] != texts[:-1]) | (items[1:] != items[:-1]) | (low[1:] > high[:-1])
            first = np.flatnonzero(fresh)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for a, b in zip(low[first], np.append(first[1:], len(low)) - 1, strict=True):
                distance, at = best_run(length.items[items[b]].tolist(), words[a : high[b]].tolist())
                if distance <= k:
                    key, here = (int(texts[b]), int(items[b])), (distance, int(a + at - firsts[texts[b]]))
                    best[key] = min(best.get(key, here), here)
            found += [(t, length.numbers[i], distance, n, at) for (t, i), (distance, at) in best.items()]
        return sorted(found, key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2:]))


def too_short(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, text) of the items of fewer than MIN_WORDS words, which are not searched for."""

    @F.pandas_udf(BooleanType())
    def short(column: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) < MIN_WORDS for t in column], dtype=bool)

    return benchmark.select(item_id, text).filter(short(text_or_empty(text))).distinct()


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text"):
    """The benchmark's items in blocks of about BLOCK_CHARS characters."""
    size = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    parts = int(-(-size // BLOCK_CHARS)) or 1
    for k in range(parts):
        rows = benchmark.filter(F.pmod(F.xxhash64(item_id, text), F.lit(parts)) == k).select(item_id, text).distinct().collect()
        yield Index([(r[0], r[1]) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds, with the least distance and where (in words) it was found."""
    small_batches(docs.sparkSession, BATCH_TEXTS)
    asked, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), None
    for index in blocks(benchmark):

        def run(batches, index=index):
            for batch in batches:
                found = index.search(list(batch["text"]))
                ids = batch["doc_id"].astype("Int64")
                frame = pd.DataFrame(found, columns=["row", "item_id", "distance", "item_words", "position"])
                frame.insert(0, "doc_id", ids.iloc[frame["row"].to_numpy(int)].to_numpy())
                frame["similarity"] = 1 - frame["distance"] / frame["item_words"]
                yield frame.drop(columns="row").astype({"doc_id": "Int64", "item_id": "Int64"})

        part = asked.mapInPandas(run, HITS)
        out = part if out is None else out.union(part)
    return out


def holds_benchmark(index: Index, column: Column) -> Column:
    """Whether a text holds an item of a block."""

    @F.pandas_udf(BooleanType())
    def found(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        for at in range(0, len(texts), BATCH_TEXTS):
            for row, *_ in index.search(list(texts.iloc[at : at + BATCH_TEXTS])):
                out[at + row] = True
        return pd.Series(out)

    return found(column)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    small_batches(docs.sparkSession, BATCH_TEXTS)
    for index in blocks(benchmark):
        docs = docs.filter(~holds_benchmark(index, text_or_empty()))
    return docs
