"""Every corpus operator applied to its whole table, under the names of the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import decontaminate, langid, licenses, linedup, packing, pii, quality, repair, simhash, sql, suffixes, trie, warc, winnow
from tallyglass.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited forms."""
    return winnow.fingerprints(table(spark, folder, "documents"))


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the component of each under three differing bits."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item it holds within a fifth of the item's words in edits."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three folds of four."""
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.train(docs))


@query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return pii.personal_data(table(spark, folder, "documents"))


@query
def op6_linedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the multi-line chunks that occur before them in the corpus."""
    return linedup.remove_repeated(table(spark, folder, "documents"), counts=True)


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document, learned from the labels of four folds of five."""
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


@query
def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Every licence passage of every document."""
    return licenses.scan_licenses(table(spark, folder, "documents"))


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed best fit into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"))


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as Zstandard WARC records and read back."""
    return warc.round_trip(spark, table(spark, folder, "pages"))


@query
def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return repair.repair(table(spark, folder, "conversations"))


ORACLES["op11_repair"] = sql.REPAIR


@query
def op12_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """What every document loses as strings of 200 bytes that start elsewhere too."""
    cut = suffixes.remove_repeated(table(spark, folder, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_suffixes"] = sql.SUFFIXES


@query
def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.trie(table(spark, folder, "conversations"))


ORACLES["op13_trie"] = sql.TRIE

ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to
FROM q
"""
