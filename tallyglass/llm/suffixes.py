"""Removal of repeated byte strings by merging the Burrows-Wheeler transforms of shards.

A text's anchors are the places whose GRAM bytes have the smallest hash of a window (rightmost on ties), a window being
all places at which a gram can start in a string of LENGTH bytes. So any LENGTH equal bytes have an equal anchor at the
same place, and only texts around anchors that occur twice matter. The context of an anchor holds all strings of LENGTH
bytes around it. Contexts of one anchor are aligned, so their suffixes are sorted column by column.

The contexts of a bucket of anchors are dealt to shards. Every shard builds its own transform: from the last column on,
the bytes before its sorted suffixes, each column from the order of the one behind it. The shards are then merged without
looking at a suffix again: the interleave of the shards at one column is refined to that of the column before it by one
stable distribution over the transforms' next bytes, and the common prefix of two neighbours is one more than the least
one between them in the interleave before (zero where their bytes differ). Neighbours with a common prefix of LENGTH, or
contexts that occur more than once, are repeated.

An anchor with more than MOST_CONTEXTS different contexts is not gathered: its strings are divided by their start into
ranges, and grouped by the bytes that all strings of a range share; in the end a range is one start, and its string is
counted. All ways are exact and cover all occurrences.

Equal contexts are counted before any shuffle of their bytes: anchors carry 128 bits of the BLAKE2 digest of their
context, and the bytes are read from one representative for each. Long texts are read in pieces, so that the arrays stay
small. Occurrences get their range back by anchor and digest, frequent ones where their rows lie.

Defined cases: a null text is empty; a text shorter than LENGTH bytes loses nothing, whatever repeats; rows with equal
ids or null ids are told apart by their text, and equal rows are repeats of each other and both lose it; an empty table
gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import join_spread, small_batches, texts
from tallyglass.plans.staging import stage

#: Bytes that must repeat; bytes of an anchor.
LENGTH = 200
GRAM = 32
#: Different contexts that one task merges for an anchor; contexts of a merge; contexts of a shard.
MOST_CONTEXTS = 20_000
MERGED = 16_384
SHARD = 4_096
#: Starts of a range by level, for anchors with more contexts.
RANGES = (24, 4, 1)
#: Bytes of a text taken at a time.
PIECE = 1 << 18
#: Anchors of a batch.
MOST_PLACES = 10_000
#: A byte that UTF-8 never has stands where a text has none.
NOTHING = 0xFF

SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63], np.uint64)
UPPER = np.uint64(0xFFFFFFFFFF000000)
KEY = ["__doc", "__null", "__digest"]
PLACES = "__doc long, __null boolean, __digest long, at long, upto long, times long, gram long, d1 long, d2 long"
STRINGS = "gram long, d1 long, d2 long, n long, shift int, group string, body binary"
FOUND = "gram long, d1 long, d2 long, low int, high int"


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the bytes at every place; `gram` is a multiple of eight."""
    n = len(data) - gram + 1
    total = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        words = np.ndarray((n,), "<u8", data, offset=8 * k, strides=(1,))
        total += (words ^ (words >> np.uint64(29))) * SEEDS[k % 4] + np.uint64(k)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(29)
    return total


def least_places(keys: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest key of any window (rightmost on ties), ascending."""
    n = len(keys)
    if n < window:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(n, 2).bit_length())
    # the smaller the farther right
    ranked = (keys >> bits << bits) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    whole = -(-n // window) * window
    padded = np.full(whole, np.iinfo(np.uint64).max)
    padded[:n] = ranked
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    mask = (np.uint64(1) << bits) - np.uint64(1)
    return np.unique(np.int64(n - 1) - (least & mask).astype(np.int64))


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of all anchors of a text."""
    window, places, hashes, start = length - gram + 1, [], [], 0
    while len(data) - start >= length:
        piece = data[start : start + PIECE + length - 1]
        keys = grams(piece, gram)
        # only the upper bits decide, whatever a piece's size
        at = least_places(keys & UPPER, window)
        places.append(at + start)
        hashes.append(keys[at].view(np.int64))
        start += PIECE
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def contexts(data: bytes, places: list[int], length: int, gram: int) -> list[bytes]:
    """All strings of `length` bytes around each anchor, padded to one size where the text ends."""
    side = length - gram
    padded = bytes([NOTHING]) * side + data + bytes([NOTHING]) * side
    return [padded[at : at + side + length] for at in places]


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _grams(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [anchors(np.frombuffer(_encoded(t), np.uint8), length, gram)[1] for t in texts(batch, "__text")]
            yield pd.DataFrame({"gram": np.concatenate(found) if found else np.zeros(0, np.int64)})

    return run


def _places(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, rows = [], 0
            for *key, text in zip(*(batch[c] for c in KEY), texts(batch, "__text"), strict=True):
                data = _encoded(text)
                at, hashes = anchors(np.frombuffer(data, np.uint8), length, gram)
                for k in range(0, len(at), MOST_PLACES):
                    part = at[k : k + MOST_PLACES]
                    bodies = contexts(data, part.tolist(), length, gram)
                    digests = np.frombuffer(b"".join([hashlib.blake2b(b, digest_size=16).digest() for b in bodies]), np.int64).reshape(-1, 2)
                    held.append((key, part, hashes[k : k + MOST_PLACES], digests))
                    rows += len(part)
                    if rows >= MOST_PLACES:
                        yield _listed(held)
                        held, rows = [], 0
            if rows:
                yield _listed(held)

    return run


def _listed(held: list) -> pd.DataFrame:
    """Anchors of several texts as rows. Neighbours with equal contexts, as in periodic texts, are one row: their strings
    overlap, since no two neighbours are farther apart than a window."""
    text = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
    at, digests = np.concatenate([h[1] for h in held]), np.concatenate([h[3] for h in held])
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (digests[1:] != digests[:-1]).any(1)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(at)))
    columns = {c: [held[t][0][k] for t in text[first].tolist()] for k, c in enumerate(KEY)}
    columns |= {"at": at[first], "upto": at[first + times - 1], "times": times, "gram": np.concatenate([h[2] for h in held])[first]}
    return pd.DataFrame(columns | {"d1": digests[first, 0], "d2": digests[first, 1]})


ASKED = ("gram", "d1", "d2", "n", "at")


def _bodies(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            held, rows = [], 0
            for *key, text, grams, d1, d2, n, at in zip(*(batch[c] for c in KEY), texts(batch, "__text"), *(batch[c] for c in ASKED), strict=True):
                # equal rows come one after the other, and one is enough
                if key == last:
                    continue
                last, data = key, _encoded(text)
                for k in range(0, len(at), MOST_PLACES):
                    part = slice(k, k + MOST_PLACES)
                    held.append((grams[part], d1[part], d2[part], n[part], contexts(data, at[part].tolist(), length, gram)))
                    rows += len(at[part])
                    if rows >= MOST_PLACES:
                        yield _strings(held)
                        held, rows = [], 0
            if rows:
                yield _strings(held)

    return run


def _strings(held: list) -> pd.DataFrame:
    """Contexts of several texts as rows, grouped by their anchor's gram."""
    columns = {c: np.concatenate([h[k] for h in held]) for k, c in enumerate(ASKED[:4])}
    bodies = [b for h in held for b in h[4]]
    return pd.DataFrame(columns | {"shift": 0, "group": list(map(str, columns["gram"].tolist())), "body": bodies})


# ---------------------------------------------------------------- transforms and their merge


def _distributed(order: np.ndarray, groups: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Where each element of a sorted column goes in the column before it: stable by byte within its group."""
    by_char = np.argsort(chars, kind="stable")
    return by_char[np.argsort(groups[by_char], kind="stable")]


def transform(body: np.ndarray, groups: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's transform (column, rank -> byte before the suffix) and the order of its suffixes at the first columns.

    `body` holds the shard's contexts as rows, in the order of their groups.
    """
    order = np.arange(len(body))
    before, orders = np.empty(body.shape[::-1], np.uint8), np.empty((starts, len(body)), np.int32)
    for column in range(body.shape[1] - 1, -1, -1):
        before[column] = body[order, column]
        order = order[_distributed(order, groups, before[column])]
        if column < starts:
            orders[column] = order
    return before, orders


def _between(common: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of common[left + 1 .. right] for every pair, left < right."""
    out = np.empty(len(left), common.dtype)
    spans = right - left
    level, table = 0, common
    while len(left):
        here = (spans >> level) == 1
        if here.any():
            out[here] = np.minimum(table[left[here] + 1], table[right[here] - (1 << level) + 1])
        if not (spans >> (level + 1)).any():
            break
        table = np.minimum(table[: -(1 << level)], table[1 << level :])
        level += 1
    return out


def merged(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, rows in order, common prefixes with the one before) of the merged shards, last column first.

    A shard is (transform, orders, groups, rows): groups and rows in the shard's own order.
    """
    width, starts = len(shards[0][0]), len(shards[0][1])
    groups = np.concatenate([s[2] for s in shards])
    which = np.concatenate([np.full(len(s[2]), k, np.uint8) for k, s in enumerate(shards)])
    at = np.argsort(groups, kind="stable")
    which, groups = which[at], groups[at]
    bound = np.empty(len(groups), bool)
    bound[:1] = True
    bound[1:] = groups[1:] != groups[:-1]
    common = np.zeros(len(groups), np.uint16)
    chars = np.empty(len(groups), np.uint8)
    rows = np.empty(len(groups), np.int32)
    for column in range(width - 1, -1, -1):
        members = [which == k for k in range(len(shards))]
        for k, own in enumerate(members):
            chars[own] = shards[k][0][column]
        goes = _distributed(which, groups, chars)
        which = which[goes]
        follows = np.flatnonzero(~bound & (np.concatenate([[False], chars[goes][1:] == chars[goes][:-1]])))
        refined = np.zeros(len(groups), np.uint16)
        refined[follows] = np.minimum(_between(common, goes[follows - 1], goes[follows]), length - 1) + 1
        common = refined
        # what all of a group share begins anew for its first
        if column < starts:
            for k in range(len(shards)):
                rows[which == k] = shards[k][3][shards[k][1][column]]
            yield column, rows, common


def _whole(body: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of a string that lies whole in its text, for each context."""
    real = body != NOTHING
    return np.argmax(real, 1), body.shape[1] - np.argmax(real[:, ::-1], 1) - length


def repeated_starts(body: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of a string that another context of the group shares at the same place; -1 where none is.

    `groups` ascend.
    """
    m, starts = len(body), body.shape[1] - length + 1
    first, last = np.full(m, -1, np.int32), np.full(m, -1, np.int32)
    pieces = -(-m // SHARD)
    shards = []
    for k in range(pieces):
        rows = np.arange(k, m, pieces)
        shards.append((*transform(body[rows], groups[rows], starts), groups[rows], rows.astype(np.int32)))
    low, high = _whole(body, length)
    for column, rows, common in merged(shards, length):
        hit = np.flatnonzero(common >= length)
        if len(hit):
            same = np.concatenate([rows[hit], rows[hit - 1]])
            same = same[(low[same] <= column) & (column <= high[same])]
            last[same] = np.maximum(last[same], column)
            first[same] = column
    return first, last


def _merging(length: int):
    """Ranges of contexts that are repeated; rows come by group, and a group has a bounded number of them."""

    def solve(held: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(held, ignore_index=True)
        body = np.frombuffer(b"".join(frame["body"]), np.uint8).reshape(len(frame), -1)
        groups = frame["group"].to_numpy()
        numbers = np.concatenate([[0], np.cumsum(groups[1:] != groups[:-1])]).astype(np.uint16 if len(frame) < 60_000 else np.int64)
        first, last = repeated_starts(body, numbers, length)
        many = frame["n"].to_numpy() > 1
        if many.any():
            first[many], last[many] = _whole(body[many], length)
        keep = (first >= 0) & (last >= first)
        out = frame.loc[keep, ["gram", "d1", "d2", "shift"]].copy()
        out["low"] = first[keep] + out["shift"].to_numpy()
        out["high"] = last[keep] + length + out["shift"].to_numpy()
        return out[["gram", "d1", "d2", "low", "high"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= MERGED:
                frame = pd.concat(held, ignore_index=True)
                others = np.flatnonzero((frame["group"] != frame["group"].iloc[-1]).to_numpy())
                whole = int(others[-1]) + 1 if len(others) else 0
                if whole:
                    yield solve([frame.iloc[:whole]])
                held, rows = [frame.iloc[whole:]], len(frame) - whole
        if rows:
            yield solve(held)

    return run


def _divided(length: int, inner: int):
    """Strings of a context by ranges of `inner` starts, grouped by the bytes that all strings of a range share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for gram, d1, d2, n, shift, body in zip(*(batch[c] for c in ("gram", "d1", "d2", "n", "shift", "body")), strict=True):
                padded = bytes(body) + bytes([NOTHING]) * (inner - 1)
                for a in range(0, len(body) - length + 1, inner):
                    part = padded[a : a + inner - 1 + length]
                    core = part[inner - 1 : length]
                    if NOTHING not in core:
                        group = hashlib.blake2b(b"%d:%d:" % (gram, shift + a) + core, digest_size=16).hexdigest()
                        rows.append((gram, d1, d2, n, shift + a, group, part))
            yield pd.DataFrame(rows, columns=["gram", "d1", "d2", "n", "shift", "group", "body"])

    return run


def repeated_ranges(strings: DataFrame, sizes: DataFrame, length: int = LENGTH) -> DataFrame:
    """(gram, d1, d2, low, high): the part of each context that strings of `length` bytes cover that occur again.

    `sizes` has the number of different contexts of each group.
    """
    level, found = strings, []
    for inner in RANGES:
        crowded = stage(sizes.filter(F.col("contexts") > MOST_CONTEXTS).withColumn("crowd", F.lit(True)), "crowded")
        hot = crowded.limit(1).count() > 0
        if hot:
            marked = stage(join_spread(level, crowded, ["group"], "contexts", "left"), "marked")
            level = marked.filter("crowd is null").drop("crowd")
        ordered = level.repartition("group").sortWithinPartitions("group", "d1", "d2")
        found.append(ordered.mapInPandas(_merging(length), FOUND))
        if not hot:
            break
        level = stage(marked.filter("crowd").drop("crowd").mapInPandas(_divided(length, inner), STRINGS), "ranges")
        sizes = level.groupBy("group").agg(F.count("*").alias("contexts"))
    else:
        # ranges of one start: equal groups are equal strings
        counted = stage(level.groupBy("group").agg(F.sum("n").alias("total")).filter("total > 1"), "counted")
        again = join_spread(level, counted, ["group"], "total", "left_semi")
        found.append(again.select("gram", "d1", "d2", F.col("shift").alias("low"), (F.col("shift") + length).alias("high")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # all strings of a context overlap, so what they cover is one range
    return every.groupBy("gram", "d1", "d2").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part, rows = batch.iloc[at : at + 64], []
            for doc, null, text, lows, highs in zip(part["__doc"], part["__null"], texts(part, "__text"), part["low"], part["high"], strict=True):
                data, spans = _encoded(text), []
                for low, high in sorted(zip(lows.tolist(), highs.tolist(), strict=True)) if lows is not None else ():
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                ends = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((None if null else str(doc), len(data), [{"start": a, "end": b} for a, b in spans], kept))
            yield pd.DataFrame(rows, columns=["doc", "n_bytes", "spans", "kept"])


CUT = "doc string, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the repeated bytes of every text and what is left without them."""
    small_batches(docs.sparkSession)
    last = F.lit((1 << 63) - 1)
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), last).alias("__doc"),
        F.col("doc_id").isNull().alias("__null"),
        F.xxhash64("text").alias("__digest"),
        F.col("text").cast("string").alias("__text"),
    )
    seen = keyed.select("__text").mapInPandas(_grams(length, gram), "gram long")
    twice = stage(seen.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "twice")
    # a plain join, so that the anchors are found once; adaptive execution divides frequent grams
    places = stage(keyed.mapInPandas(_places(length, gram), PLACES).join(twice, "gram", "left_semi"), "places")
    first = F.min(F.struct(*KEY, "at")).alias("first")
    kinds = stage(places.groupBy("gram", "d1", "d2").agg(F.sum("times").alias("n"), first), "kinds")
    asked = kinds.select(*[f"first.{c}" for c in KEY], F.struct("gram", "d1", "d2", "n", "first.at").alias("one"))
    asked = asked.groupBy(*KEY).agg(F.collect_list("one").alias("all")).select(*KEY, *[F.col(f"all.{c}").alias(c) for c in ASKED])
    strings = keyed.join(asked, KEY).mapInPandas(_bodies(length, gram), STRINGS)
    sizes = kinds.groupBy(F.col("gram").cast("string").alias("group")).agg(F.count("*").alias("contexts"))
    ranges = repeated_ranges(strings, sizes, length)
    cut = F.struct((F.col("at") + F.col("low") - (length - gram)).alias("low"), (F.col("upto") + F.col("high") - (length - gram)).alias("high"))
    spans = places.join(ranges, ["gram", "d1", "d2"]).groupBy(*KEY).agg(F.collect_set(cut).alias("all"))
    spans = spans.select(*KEY, F.col("all.low").alias("low"), F.col("all.high").alias("high"))
    return keyed.join(spans, KEY, "left").mapInPandas(_cut, CUT).withColumn("doc_id", F.col("doc").cast("long")).select("doc_id", "n_bytes", "spans", "kept")
