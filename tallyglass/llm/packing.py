"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Best fit looks only at lengths, and a length is at most the capacity. The driver therefore plans on the
histogram of lengths (one count per length, at most `capacity` rows), and the plan is a table of runs:
pieces ranked r..r+n of one length go to consecutive sequences, so many to each, from one offset. Its size
follows the capacity, not the corpus. Pieces find their rank within their length by counts over hash
buckets, so a length that holds a third of all pieces is ranked in many tasks.

Defined cases: null and empty texts are the single end id; equal rows are packed as separate documents; a
null id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import small_batches, text_or_empty, texts
from tallyglass.plans.staging import stage

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces ranked together; the number of buckets follows the number of pieces.
BUCKET_ROWS = 5_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "length long, first_rank long, n long, first_sequence long, per_sequence long, used long"

_encoders: dict[str, Encoder] = {}


#: How the byte-level vocabulary cuts text before merging (fixed values).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's 12 words,  two\n\n lines; déjà vu, 北京 …\tend "


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: visible Latin-1 stands for itself, the rest follows from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary file is read by `tokenizers`; its merges run through tiktoken's faster merger, built from the
    same vocabulary and compared on a probe. Texts that hold a special token's spelling, and those the merger
    can't take, are encoded by `tokenizers` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        back = byte_of_char()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self.plain(PROBE) != self.encode(PROBE):
            raise ValueError(f"{path} isn't a byte-level vocabulary with merges in the order of its ids")

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self.plain(text)
        try:
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the merger gives up on very long runs of white space
            return self.plain(text)


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full ones, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of each tokenised document."""
    small_batches(docs.sparkSession)
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], texts(batch), strict=True):
                ids = encode(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, PIECES)


class OpenCapacities:
    """A segment tree over remaining capacities: which of them some open sequence has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.has = [False] * (2 * self.leaves)

    def mark(self, capacity: int, present: bool) -> None:
        at = capacity + self.leaves
        self.has[at] = present
        while at > 1:
            at //= 2
            self.has[at] = self.has[2 * at] or self.has[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least `length`, in logarithmic time."""
        at = length + self.leaves
        if self.has[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.has[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.has[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Pieces of one length that fit into one sequence follow each other there, since after each of them that
    sequence is the tightest of all that still fit; so whole groups of alike sequences are filled at a time.
    """
    tree, groups, runs, made = OpenCapacities(capacity), defaultdict(list), [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            groups[left].append((first, n))
            tree.mark(left, True)

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                left = capacity
                fresh = -(-todo // (capacity // length))
                put(capacity, made, fresh)
                made += fresh
            first, n = groups[left].pop()
            if not groups[left]:
                tree.mark(left, False)
            each = left // length
            full = min(n, todo // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - left))
                put(left - each * length, first, full)
                rank, todo, first, n = rank + full * each, todo - full * each, first + full, n - full
            if n and 0 < todo < each:
                runs.append((length, rank, todo, first, todo, capacity - left))
                put(left - todo * length, first, 1)
                todo, first, n = 0, first + 1, n - 1
            put(left, first, n)
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack documents (doc_id, text): one row per piece with its sequence_id and offset in it."""
    spark = docs.sparkSession
    cut_up = stage(pieces(docs, capacity, tokenizer), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(plan_runs(counts, capacity), RUNS)
    buckets = -(-sum(counts.values()) // BUCKET_ROWS) or 1
    keyed = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        keyed.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("place", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("place") + F.col("base")).drop("place", "base", "bucket")
    # The plan has few rows for each length whatever the size of the corpus.
    r, p = F.broadcast(runs).alias("r"), ranked.alias("p")
    inside = F.col("p.rank") - F.col("r.first_rank")
    return p.join(r, (F.col("p.length") == F.col("r.length")) & (inside >= 0) & (inside < F.col("r.n"))).select(
        "p.doc_id",
        "p.piece",
        "p.start",
        "p.length",
        "p.ids_crc32",
        (F.col("r.first_sequence") + F.floor(inside / F.col("r.per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("r.used") + F.pmod(inside, F.col("r.per_sequence")) * F.col("p.length")).cast("long").alias("offset"),
    )
