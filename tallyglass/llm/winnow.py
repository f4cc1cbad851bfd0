"""Document fingerprints by winnowing, with DataFrame functions only.

The words of a text (runs of anything but ASCII white space) are hashed; GRAM of them in a row give a polynomial
rolling hash modulo a Mersenne prime. Of every WINDOW hashes in a row the smallest is chosen, the rightmost where
several are smallest. A hash and the complement of its position share one long, so the choice is a plain minimum.
Any passage of WINDOW + GRAM - 1 words that two texts share puts at least one equal hash into both fingerprints,
and the positions say where it stands.

A text's successor (the next id) is found with one shuffle of the texts: windows over blocks of BLOCK ids, and for
the last row of a block the first row of the next block there is. The order of blocks comes from their numbers
alone, over LEVELS levels of groups, so no task orders more than 2^20 of them, however sparse the ids are. (Where
nearly every document is the first of its block, as with hashed ids, its text is shuffled twice.)

Defined cases: null and empty texts have the empty fingerprint, and two empty fingerprints are alike (1.0); fewer
than GRAM words form one gram; rows without an id have no successor and are edited with an empty text; rows with
equal ids follow each other by text; the last row is followed by the first; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import text_or_empty

GRAM = 4
WINDOW = 8
PRIME = (1 << 31) - 1
BASE = 1_000_003
PLACES = (1 << 32) - 1
WHITE = " \t\n\x0b\f\r"
#: Ids in a block, and blocks in a group of blocks, as powers of two.
BLOCK_BITS = 8
GROUP_BITS = 12
#: Levels of groups: 56 bits of block numbers less LEVELS * GROUP_BITS are ordered in one task.
LEVELS = 3


def chosen(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the chosen grams of a text column as longs: the hash above, the complement of the position below."""
    trimmed = F.btrim(F.col(text), F.lit(WHITE))
    docs = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE}]+")))
    n = F.size("_words")
    docs = docs.withColumns(
        {
            "_codes": F.transform("_words", lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))),
            "_whole": F.when((n > 0) & (n < GRAM), F.pmod(F.xxhash64(F.array_join("_words", " ")), F.lit(PRIME))),
            "_n": n,
        }
    )

    def gram(code: Column, i: Column) -> Column:
        for k in range(1, GRAM):
            code = (code * BASE + F.get("_codes", i + k)) % PRIME
        return code

    docs = docs.withColumn("_grams", F.transform("_codes", gram))
    grams = F.when(F.col("_whole").isNotNull(), F.array("_whole")).otherwise(F.slice("_grams", F.lit(1), F.greatest(F.col("_n") - (GRAM - 1), F.lit(0))))
    docs = docs.withColumn("_packed", F.transform(grams, lambda h, i: F.shiftleft(h, 32) + (F.lit(PLACES) - i)))

    def least(own: Column, i: Column) -> Column:
        return F.least(own, *[F.get("_packed", i + k) for k in range(1, WINDOW)])

    docs = docs.withColumn("_least", F.transform("_packed", least))
    windows = F.when(F.size("_least") > 0, F.greatest(F.size("_least") - (WINDOW - 1), F.lit(1))).otherwise(0)
    return docs.withColumn(out, F.array_distinct(F.slice("_least", F.lit(1), windows))).drop(
        "_words", "_codes", "_whole", "_n", "_grams", "_packed", "_least"
    )


def shown(column: str) -> Column:
    """A fingerprint as text: hash:position of each chosen gram in the order of the text."""
    one = lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 32))), F.lit(":"), (F.lit(PLACES) - v.bitwiseAND(F.lit(PLACES))).cast("string"))
    return F.array_join(F.transform(column, one), " ")


def hashes(column: str) -> Column:
    return F.array_distinct(F.transform(column, lambda v: F.shiftright(v, 32)))


def likeness(a: str, b: str) -> Column:
    """Twice the hashes in both over the hashes of each."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def following_numbers(numbers: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(number, following) for distinct numbers; the last is followed by the first.

    Numbers are ordered within groups of 2^GROUP_BITS, and the first numbers of the groups follow from the order
    of the groups, found the same way. Of 56-bit block numbers at most 2^20 groups are left at the last level.
    """
    if not levels:
        order = Window.orderBy("number")
        first = F.first("number").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return numbers.withColumn("following", F.coalesce(F.lead("number").over(order), first))
    grouped = numbers.withColumn("group", F.shiftright("number", GROUP_BITS))
    ahead = grouped.withColumn("ahead", F.lead("number").over(Window.partitionBy("group").orderBy("number")))
    starts = grouped.groupBy("group").agg(F.min("number").alias("start"))
    groups = following_numbers(starts.select(F.col("group").alias("number")), levels - 1)
    after = groups.join(starts.withColumnRenamed("group", "following"), "following").select(F.col("number").alias("group"), "start")
    return ahead.join(after, "group").select("number", F.coalesce("ahead", "start").alias("following"))


def next_blocks(blocks: DataFrame) -> DataFrame:
    """(block, following) for the distinct numbers of `block`; the last is followed by the first."""
    return following_numbers(blocks.select(F.col("block").alias("number")).distinct()).withColumnRenamed("number", "block")


def with_successor(docs: DataFrame) -> DataFrame:
    """doc_id, text, its chosen grams, and text and grams of the next document."""
    keyed = docs.withColumn("block", F.shiftright("doc_id", BLOCK_BITS))
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    first = keyed.withColumn("place", F.row_number().over(order)).filter("place = 1")
    heads = chosen(first.select(F.col("block").alias("following"), F.col("text").alias("head_text")), "head_text", "head_chosen")
    heads = next_blocks(keyed).join(heads, "following").drop("following")
    dealt = chosen(keyed.repartition("block"), "text", "chosen")
    ahead = dealt.withColumns({"next_text": F.lead("text").over(order), "next_chosen": F.lead("chosen").over(order)})
    return ahead.join(heads, "block").select(
        "doc_id",
        "text",
        "chosen",
        F.coalesce("next_text", "head_text").alias("next_text"),
        F.coalesce("next_chosen", "head_chosen").alias("next_chosen"),
    )


def edited(text: str, following: str) -> Column:
    """The text with its last quarter of code points replaced by as many of the following one's first."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - quarter), F.substring(F.col(following), F.lit(1), quarter))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next document's are."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    placed = with_successor(own.filter("doc_id is not null"))
    loose = chosen(own.filter("doc_id is null"), "text", "chosen")
    loose = loose.withColumns({"next_text": F.lit(""), "next_chosen": F.array().cast("array<bigint>")})
    made = placed.unionByName(loose).withColumn("edited", edited("text", "next_text"))
    made = chosen(made, "edited", "edited_chosen").withColumns(
        {"a": hashes("chosen"), "b": hashes("edited_chosen"), "c": hashes("next_chosen")}
    )
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown("chosen").alias("fingerprint"),
        shown("edited_chosen").alias("edited_fingerprint"),
        likeness("a", "b").alias("near_edited"),
        likeness("a", "c").alias("near_next"),
    )
