"""Removal of multi-line chunks that occur elsewhere in the corpus.

A text is cut into chunks of lines where a rolling hash over the hashes of the last lines hits a mark, so a
passage shared by two texts is cut alike in both, wherever it stands. Chunks of at least MIN_LINES lines with
content (or one line of at least LONG_LINE words, itself a passage) take part.

The ends of a passage depend on its neighbours, so the shortest runs of at least LONG_LINE words from and up to every
line take part as chunks too, at most two for a line. They depend on nothing outside themselves and cover every passage
of that many words, so all of a passage of whole lines is found, whatever stands around it. Of equal chunks the
first one, by doc_id and place, stays and all others go; where a chunk overlaps its own repeat, as in a line said over
and over, the lines of the first stay.

Only hashes and places of chunks travel at first; they are counted with map-side combining. Texts of chunks
with a repeated hash are then compared byte by byte: their least and greatest bytes are aggregated, and only
where both are the same is anything removed. A chunk that fills a third of the corpus is thus one row per
task in either shuffle, and the joins back to the chunks broadcast the few frequent ones.

Defined cases: null texts stay null; empty texts and lines take no part; rows equal in doc_id and text count as
one document and keep the same lines; null ids come last in the order; a text may become empty, its row stays;
an empty table gives an empty result; all columns are kept, `n_chars` follows the new text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyglass.llm.common import join_spread, small_batches, texts
from tallyglass.plans.staging import stage

#: Lines in the rolling hash; mean lines of a chunk; most lines of one.
WINDOW = 2
MEAN_LINES = 3
MOST_LINES = 64
MIN_LINES = 2
LONG_LINE = 50

BASE = 0x9E3779B97F4A7C15
WORD = (1 << 64) - 1
KEY = ["__doc", "__digest"]
PLACES = "__doc long, __digest long, chunk int, h1 long, h2 long"
CHUNK_TEXTS = "__doc long, __digest long, chunk int, h1 long, h2 long, body string"


def line_chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first, end) of the chunks of a list of lines, cut at content-defined boundaries."""
    hashes = [xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines]
    drop = pow(BASE, WINDOW, 1 << 64)
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * BASE + h) & WORD
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * drop) & WORD
        mixed = (rolling ^ rolling >> 29) * BASE & WORD
        if (mixed >> 32) % MEAN_LINES == 0 or i + 1 - start == MOST_LINES:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def takes_part(lines: list[str]) -> bool:
    filled = sum(1 for line in lines if line.strip())
    return filled >= MIN_LINES or filled == 1 and any(len(line.split()) >= LONG_LINE for line in lines)


def passages(lines: list[str]) -> set[tuple[int, int]]:
    """(first, end) of the shortest runs of LONG_LINE words from and up to each line with content.

    They cover every run of at least as many words between two lines with content: a line with too few words behind
    it lies in the run up to the last one. Empty lines between two lines that are passages of their own go with them.
    """
    counts = [len(line.split()) for line in lines]
    filled = [i for i, n in enumerate(counts) if n]
    spans, behind, words = set(), 0, 0
    for i in filled:
        while words < LONG_LINE and behind < len(filled):
            words += counts[filled[behind]]
            behind += 1
        if words >= LONG_LINE:
            spans.add((i, filled[behind - 1] + 1))
        words -= counts[i]
    first, words = 0, 0
    for i in filled:
        words += counts[i]
        while words - counts[filled[first]] >= LONG_LINE:
            words -= counts[filled[first]]
            first += 1
        if words >= LONG_LINE:
            spans.add((filled[first], i + 1))
    spans.update((a, b + 1) for a, b in zip(filled, filled[1:], strict=False) if b > a + 1 and min(counts[a], counts[b]) >= LONG_LINE)
    return spans


def spans_of(lines: list[str]) -> list[tuple[int, int]]:
    """(first, end) of every chunk that takes part, each once, in the order of the text."""
    return sorted({(a, b) for a, b in line_chunks(lines) if takes_part(lines[a:b])} | passages(lines))


def text_chunks(text: str):
    """(number, lines) of every chunk that takes part."""
    lines = text.split("\n")
    for k, (a, b) in enumerate(spans_of(lines)):
        yield k, lines[a:b]


def without(text: str, chunks) -> str:
    """The text without the chunks of these numbers; lines that a chunk shares with its own first occurrence stay."""
    lines, gone = text.split("\n"), set(chunks)
    if not gone:
        return text
    spans = spans_of(lines)
    firsts = {tuple(lines[a:b]): (a, b) for k, (a, b) in enumerate(spans) if k not in gone}
    cut = set()
    for k in gone:
        a, b = spans[k]
        kept = range(*firsts.get(tuple(lines[a:b]), (0, 0)))
        cut.update(i for i in range(a, b) if i not in kept)
    return "\n".join(line for i, line in enumerate(lines) if i not in cut)


def _hashed(body: str) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(body.encode("utf-8", "surrogatepass")), np.int64).tolist())


def _places(batches):
    for batch in batches:
        rows = []
        for doc, digest, text in zip(batch["__doc"], batch["__digest"], texts(batch, "__text"), strict=True):
            rows += [(doc, digest, k, *_hashed("\n".join(lines))) for k, lines in text_chunks(text)]
        yield pd.DataFrame(rows, columns=["__doc", "__digest", "chunk", "h1", "h2"])


def _bodies(batches):
    for batch in batches:
        for at in range(0, len(batch), 64):
            part, rows = batch.iloc[at : at + 64], []
            for doc, digest, text, asked in zip(part["__doc"], part["__digest"], texts(part, "__text"), part["chunks"], strict=True):
                asked = set(asked)
                rows += [(doc, digest, k, *_hashed(b), b) for k, b in ((k, "\n".join(x)) for k, x in text_chunks(text)) if k in asked]
            yield pd.DataFrame(rows, columns=["__doc", "__digest", "chunk", "h1", "h2", "body"])


@F.pandas_udf(StringType())
def _cleaned(column: pd.Series, chunks: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or c is None else without(t, c) for t, c in zip(column, chunks, strict=True)], dtype=object)


def _listed(chunks: DataFrame, name: str) -> DataFrame:
    """The chunk numbers of each document; a document's own chunks are the most that meet."""
    return chunks.groupBy(*KEY).agg(F.sort_array(F.collect_set("chunk")).alias(name))


def repeated_chunks(keyed: DataFrame) -> DataFrame:
    """(__doc, __digest, chunk) of all occurrences but the first of chunks equal in their bytes."""
    asked = keyed.select(*KEY, F.col("text").alias("__text")).filter("__text is not null")
    places = stage(asked.mapInPandas(_places, PLACES), "chunks")
    twice = stage(places.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    candidates = _listed(join_spread(places, twice, ["h1", "h2"], "n", "left_semi"), "chunks")
    bodies = asked.join(candidates, KEY).mapInPandas(_bodies, CHUNK_TEXTS)
    same = (
        bodies.groupBy("h1", "h2")
        .agg(
            F.min("body").alias("low"),
            F.max("body").alias("high"),
            F.min(F.struct(*KEY, "chunk")).alias("first"),
            F.count("*").alias("n"),
        )
        .filter(F.col("low") == F.col("high"))
        .select("h1", "h2", "first", "n")
    )
    later = join_spread(places, stage(same, "firsts"), ["h1", "h2"], "n")
    return later.filter(F.struct(*KEY, "chunk") > F.col("first")).select(*KEY, "chunk")


def remove_repeated(docs: DataFrame, counts: bool = False) -> DataFrame:
    """`docs` with later occurrences of repeated chunks cut out of `text`; with counts, also `removed_chunks`.

    Chunks may overlap, and each counts.
    """
    small_batches(docs.sparkSession)
    last = F.lit((1 << 63) - 1)
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), last), "__digest": F.xxhash64("text")})
    gone = _listed(repeated_chunks(keyed), "__gone")
    joined = keyed.join(gone, KEY, "left").withColumn("text", _cleaned("text", "__gone"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    extra = [F.coalesce(F.size("__gone"), F.lit(0)).alias("removed_chunks")] if counts else []
    return joined.select(*docs.columns, *extra)
