"""CSV records with line breaks inside quotes, read by as many tasks as the files have byte ranges.

A byte range cannot know whether it begins inside quotes, so a first scan follows each range from both states and keeps
only the pair of states it ends in. Such pairs compose: each either keeps the state, turns it, or fixes it. A running
count of the turns since the last range that fixed the state gives every range its true beginning, on a table with a row
for each range. A second scan then cuts the records; only what crosses a border travels, and is joined in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELD = r'(?:"[^"]*(?:""[^"]*)*"(?!")[^,]*|[^",][^,]*|)'
WHOLE_LINE = re.compile(rf"{FIELD}(?:,{FIELD})*\Z")
CLOSED_LINE = re.compile(rf'[^"]*(?:""[^"]*)*"(?!")[^,]*(?:,{FIELD})*\Z')
RANGE = ["file", "start"]


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside or outside of quotes ends inside of them.

    Quotes open a value only at its start; inside, two of them are one.
    """
    if '"' not in line:
        return inside
    return (CLOSED_LINE if inside else WHOLE_LINE).match(line) is None


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.Array, np.ndarray]]:
    """(range, lines, places of the lines with a quote) of the consecutive ranges in a batch."""
    keys = [batch.column(c).to_numpy() for c in RANGE]
    new = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            lines = batch.column("value").slice(low, high - low)
            quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
            yield (int(keys[0][low]), int(keys[1][low])), lines, np.flatnonzero(quoted)


STATES = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_())])


def _range_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, outside, inside = None, False, True
    told = lambda: pa.RecordBatch.from_pylist([dict(zip(STATES.names, (*here, outside, inside), strict=True))], STATES)
    for batch in batches:
        for key, lines, quoted in _parts(batch):
            if key != here:
                if here:
                    yield told()
                here, outside, inside = key, False, True
            for line in lines.take(pa.array(quoted)).to_pylist():
                outside, inside = ends_inside(line, outside), ends_inside(line, inside)
    if here:
        yield told()


def true_states(ranges: DataFrame) -> DataFrame:
    """(file, start, inside) from the pairs of states that each range ends in."""
    turns = F.col("from_outside") & ~F.col("from_inside")
    fixes = F.col("from_outside") == F.col("from_inside")
    order = Window.partitionBy("file").orderBy("start")
    counted = ranges.withColumn("turn", turns.cast("int")).withColumn("turned", F.sum("turn").over(order))
    last = F.last(F.when(fixes, F.struct("from_outside", "turned")), ignorenulls=True)
    fixed = counted.withColumn("fixed", last.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    since = F.col("turned") - F.col("turn") - F.coalesce("fixed.turned", F.lit(0))
    return fixed.select(*RANGE, (F.coalesce("fixed.from_outside", F.lit(False)) != (since % 2 == 1)).alias("inside"))


CUT = pa.schema([("record", pa.string()), ("header", pa.bool_()), ("file", pa.int64()), ("start", pa.int64()), ("side", pa.int32())])


class _Range:
    """A byte range while its lines pass."""

    def __init__(self, key: tuple[int, int], inside: bool):
        self.key, self.inside, self.held = key, inside, []
        # the first record was begun elsewhere; the next one is the file's header
        self.foreign, self.first = inside, key[1] == 0

    def piece(self, side: int) -> tuple:
        row = ("\n".join(self.held), self.first and not self.foreign, *self.key, side)
        self.held, self.foreign = [], False
        return row

    def take(self, lines: list[str], quoted: list[int], plain: list[str], pieces: list[tuple]) -> None:
        """Whole records go to `plain`, but for the header, which goes to `pieces`."""
        done = 0
        for at in [*quoted, len(lines)]:
            self._unquoted(lines[done:at], plain, pieces)
            if at == len(lines):
                return
            self.inside, done = ends_inside(lines[at], self.inside), at + 1
            self.held.append(lines[at])
            if not self.inside:
                self._close(plain, pieces)

    def _unquoted(self, lines: list[str], plain: list[str], pieces: list[tuple]) -> None:
        if self.inside:
            self.held += lines
        elif lines:
            if self.first:
                pieces.append((lines[0], True, None, None, None))
                self.first, lines = False, lines[1:]
            plain += lines

    def _close(self, plain: list[str], pieces: list[tuple]) -> None:
        if self.foreign:
            pieces.append(self.piece(0))
        else:
            record, self.held = "\n".join(self.held), []
            self._unquoted([record], plain, pieces)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces at a range's beginning (side 0) and end (side 1) whose rest lies elsewhere."""
    here: _Range | None = None

    def told(plain: list[str], pieces: list[tuple]) -> pa.RecordBatch:
        rest = pa.RecordBatch.from_pylist([dict(zip(CUT.names, p, strict=True)) for p in pieces], CUT)
        n = len(plain)
        whole = [pa.array(plain, pa.string()), pa.array(np.zeros(n, bool)), *[pa.nulls(n, t) for t in CUT.types[2:]]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(whole, rest.columns, strict=True)], schema=CUT)

    for batch in batches:
        plain, pieces, row = [], [], 0
        for key, lines, quoted in _parts(batch):
            if here is None or here.key != key:
                if here and here.held:
                    pieces.append(here.piece(0 if here.foreign else 1))
                here = _Range(key, batch.column("inside")[row].as_py())
            here.take(lines.to_pylist(), quoted.tolist(), plain, pieces)
            row += len(lines)
        yield told(plain, pieces)
    if here and here.held:
        yield told([], [here.piece(0 if here.foreign else 1)])


def cut_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(record, header, file, start, side) of all files; every range is read by its own task."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.option("lineSep", "\n").text(paths)
    lines = lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ranges = lines.mapInArrow(_range_states, "file long, start long, from_outside boolean, from_inside boolean")
    # a row for each byte range of the files
    return lines.join(F.broadcast(true_states(ranges)), RANGE).select("value", *RANGE, "inside").mapInArrow(_records, "record string, header boolean, file long, start long, side int")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """(record, header) from the pieces of records that cross borders of ranges."""
    order = Window.partitionBy("file").orderBy("start", "side")
    numbered = pieces.withColumn("number", F.sum("side").over(order))
    in_order = F.sort_array(F.collect_list(F.struct("start", "side", "record")))
    whole = numbered.groupBy("file", "number").agg(in_order.alias("parts"), F.max("header").alias("header"))
    return whole.select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), "header")
