"""SimHash near-duplicates: fingerprints, bit-sliced comparison within pigeonhole buckets, components.

Equal fingerprints are first made one. Two that differ in at most three bits agree in one of four blocks of
their bits, and again in one of four blocks of the rest, so they meet in a bucket named by the agreed bits.
Buckets larger than BUCKET_LIMIT are divided by the same rule on their remaining bits until so few bits are
left that distinct fingerprints cannot exceed the limit: no bucket is cut short and none grows with the data.

A bucket keeps bit planes (bit b of 64 rows in one word). One XOR, and an addition into carry-save counters,
updates 64 distances at once; words whose 64 distances all exceed the radius are abandoned. Of a bucket's
links only a spanning forest leaves the task, which keeps every component and no pairs.

Defined cases: null texts are empty; a text without words has fingerprint zero and is linked like any other;
rows that repeat an id are separate rows with the same result; a group known only by null ids has a null
component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import join_spread, narrow_rows, small_batches, text_or_empty, texts
from tallyglass.llm.components import components
from tallyglass.plans.staging import stage

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET_LIMIT = 8192
#: Blocks of bits of which two fingerprints within the radius share one.
BLOCKS = RADIUS + 1
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
SIZE_CLASSES = (2, 4, 8, 16, 32, 64)


# ---------------------------------------------------------------- fingerprints


def simhash(text: str) -> int:
    """Majority bits of the XXH64 hashes of 3-word shingles; A-Z count as a-z, white space is ASCII."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 15):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in range(BITS) if 2 * counts[b] > len(starts)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp): a hash and the fingerprint of every whole text, as signed longs."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = np.array([simhash(t) for t in texts(batch)], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "digest": batch["digest"], "fp": found})

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), text_or_empty().alias("text"))
    return chosen.mapInPandas(run, "doc_id long, digest long, fp long")


# ---------------------------------------------------------------- buckets


def _split(mask: int) -> list[int]:
    """The masks that add one of four blocks of the bits not yet agreed."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    bounds = [len(rest) * k // BLOCKS for k in range(BLOCKS + 1)]
    return [mask | sum(1 << b for b in rest[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bucketed(rows: DataFrame, masks: list[int], column: str | None = None) -> DataFrame:
    """Rows (fp) under each mask; with a column, only under the masks that follow from that row's mask."""
    if column is None:
        under = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    else:
        follow = [F.when(F.col(column) == F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in _split(m)])) for m in masks]
        under = F.explode(F.coalesce(*follow))
    return rows.select("fp", under.alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def buckets(distinct: DataFrame, limit: int = BUCKET_LIMIT) -> list[DataFrame]:
    """Tables (mask, value, fp) of buckets within the limit that together hold every pair within the radius."""
    masks = [m for first in _split(0) for m in _split(first)]
    rows, out = _bucketed(distinct, masks), []
    while True:
        left = min(BITS - m.bit_count() for m in masks)
        if 1 << left <= limit or left < BLOCKS:
            return [*out, rows]
        large = rows.groupBy("mask", "value").count().filter(F.col("count") > limit).select("mask", "value")
        large = stage(large, "large")
        if large.isEmpty():
            return [*out, rows]
        out.append(rows.join(large, ["mask", "value"], "left_anti"))
        rows = _bucketed(rows.join(large, ["mask", "value"], "left_semi"), masks, "mask")
        masks = sorted({x for m in masks for x in _split(m)})


# ---------------------------------------------------------------- bit-sliced comparison


def bit_planes(values: np.ndarray) -> list[np.ndarray]:
    """Plane b holds bit b of 64 rows in each word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    return [np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(BITS)]


def _shifted(words: np.ndarray, rows: int) -> np.ndarray:
    """A plane as seen from `rows` rows further on; zeros follow the end."""
    skip, bits = divmod(rows, 64)
    out = np.zeros_like(words)
    out[: len(words) - skip] = words[skip:]
    if bits:
        carried = np.zeros_like(out)
        carried[:-1] = out[1:] << np.uint64(64 - bits)
        out = out >> np.uint64(bits) | carried
    return out


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def within_radius(left: list, right: list, over: np.ndarray, counters: int = 2) -> np.ndarray:
    """Bits that are set where the distance exceeds 2**counters - 1 (or was excluded at the start).

    left and right hold a plane for each bit and broadcast to the shape of `over`. Every distance is a
    column of carry-save counter bits; the carry out of the last one sticks. After every eighth plane
    the words that are wholly over are abandoned.
    """
    shape, result = over.shape, over.copy()
    kept = np.nonzero(result != FULL)
    state = [np.zeros(len(kept[0]), np.uint64) for _ in range(counters)]
    live = result[kept]
    for b in range(BITS):
        carry = np.broadcast_to(left[b], shape)[kept] ^ np.broadcast_to(right[b], shape)[kept]
        for k in range(counters):
            state[k], carry = state[k] ^ carry, state[k] & carry
        live |= carry
        if b % 8 == 7 and b + 1 < BITS:
            stay = live != FULL
            if not stay.all():
                result[kept] = live
                kept, live, state = tuple(x[stay] for x in kept), live[stay], [s[stay] for s in state]
                if not len(live):
                    return result
    result[kept] = live
    return result


class Forest:
    """Disjoint sets over row numbers; the smallest row is the root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                further = root[root]
                if np.array_equal(further, root):
                    break
                root = further
            self.root = root


def bucket_roots(bucket: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For rows grouped by bucket: the smallest row of each row's component within its bucket."""
    n = len(bucket)
    firsts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if n else np.array([], int)
    sizes = np.diff(np.append(firsts, n))
    forest = Forest(n)
    lower = 1
    for upper in SIZE_CLASSES:
        chosen = (sizes > lower) & (sizes <= upper)
        if chosen.any():
            lengths = sizes[chosen]
            number = np.repeat(np.arange(len(lengths)), lengths)
            rows = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(firsts[chosen], lengths)
            planes = bit_planes(values[rows])
            for d in range(1, int(lengths.max())):
                excluded = ~_packed(number[d:] == number[:-d], len(planes[0]))
                over = within_radius(planes, [_shifted(p, d) for p in planes], excluded)
                near = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))
                forest.join(rows[near], rows[near + d])
        lower = upper
    for first, size in zip(firsts[sizes > lower], sizes[sizes > lower], strict=True):
        own = values[first : first + size]
        planes = bit_planes(own)
        width = len(planes[0])
        for at in range(0, size, 128):
            some = own[at : at + 128]
            skip = at // 64
            asked = [np.where(some >> np.uint64(b) & np.uint64(1), FULL, np.uint64(0))[:, None] for b in range(BITS)]
            excluded = np.zeros((len(some), width - skip), np.uint64)
            excluded[:, -1] = ~_packed(np.ones(size - (width - 1) * 64, np.uint8), 1)[0]
            over = within_radius([p[None, skip:] for p in planes], asked, excluded)
            i, j = np.nonzero(np.unpackbits(np.ascontiguousarray(~over).view(np.uint8), axis=1, bitorder="little"))
            i, j = i + at, j + skip * 64
            ahead = i < j
            forest.join(first + i[ahead], first + j[ahead])
    return forest.root


def bucket_links(rows: DataFrame, parts: int) -> DataFrame:
    """A spanning forest (a, b) of the links inside every bucket (mask, value, fp)."""

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 60_000:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows["mask"] == rows["mask"].iloc[-1]) & (rows["value"] == rows["value"].iloc[-1])
            if not last.all():
                yield links(rows[~last])
                rows = rows[last]
            held = [rows]
        if held:
            yield links(pd.concat(held, ignore_index=True))

    def links(rows):
        mask, value, fp = (rows[c].to_numpy(np.int64) for c in ("mask", "value", "fp"))
        bucket = np.cumsum(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))) if len(fp) else fp
        root = bucket_roots(bucket, fp.view(np.uint64))
        own = np.arange(len(fp))
        joined = root != own
        return pd.DataFrame({"a": fp[root[joined]], "b": fp[own[joined]]})

    dealt = rows.repartition(parts, "mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.mapInPandas(run, "a long, b long")


# ---------------------------------------------------------------- operator


def linked_rows(docs: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, digest, fp, component) of every row: components of fingerprints within the radius.

    A component is named by the smallest (doc_id, digest) of its rows with an id, so texts that share an id stay apart.
    """
    spark = docs.sparkSession
    found = stage(fingerprints(docs), "fingerprints")
    named_row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))
    distinct = stage(found.groupBy("fp").agg(F.min(named_row).alias("least"), F.count("*").alias("n")), "distinct")
    narrow_rows(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    forests = [bucket_links(rows, parts) for rows in buckets(distinct.select("fp"), limit)]
    links = forests[0]
    for more in forests[1:]:
        links = links.union(more)
    rooted = components(links).select(F.col("node").alias("fp"), "root")
    linked = distinct.join(rooted, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(least, "root").select("fp", "component")
    groups = distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "n")
    return join_spread(found, stage(groups, "groups"), ["fp"], "n")


def near_duplicates(docs: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: components of fingerprints within the radius."""
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return linked_rows(docs, limit).select("doc_id", shown, F.col("component.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without near-duplicates: of each component the row with the smallest id stays, once.

    Rows that share an id but not a text are documents of their own. Rows without an id stay.
    """
    found = linked_rows(docs)
    first = (F.col("doc_id") == F.col("component.doc_id")) & (F.col("digest") == F.col("component.digest"))
    kept = found.filter(first).select("doc_id", F.col("digest").alias("__digest")).distinct()
    unnamed = docs.filter("doc_id is null")
    told = docs.withColumn("__digest", F.xxhash64("text")).join(kept, ["doc_id", "__digest"], "left_semi")
    return told.dropDuplicates(["doc_id", "__digest"]).select(*docs.columns).unionByName(unnamed)
