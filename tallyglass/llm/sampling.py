"""Bounded samples chosen by a hash of the id, without sorting or gathering what isn't in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 40


def place(key: str = "doc_id") -> Column:
    """An id's place in [0, RANGE), by its hash."""
    return F.pmod(F.xxhash64(key), F.lit(RANGE))


def threshold(n: int, total: Column) -> Column:
    """Below this place about 2 n of `total` ids lie (all of them where there are fewer)."""
    return F.least(F.lit(1.0), 2.0 * n / total) * RANGE
