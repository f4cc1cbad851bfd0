"""The prefix trie of conversations, grouped by digests of fixed blocks of turns.

Turns are numbered, and every BLOCK of them gets a digest; the digests of a conversation's blocks are chained. All
conversations with the same chain up to a block are one group. Where all of a group go on with the same block, its turns
are nodes of that one group and nothing more is looked at. Only where they go on differently (or some end inside the
block) are the turn boundaries inside the block refined, by chains of single turns.

A node is named by its smallest member and its depth. A conversation is the smallest member of a run of nodes on its
own path (none, if an earlier one says the same), and that run hangs on a node of a smaller conversation. So the trie is
a tree of paths: what a path adds to those above is summed by pointer jumping, in as many rounds as the logarithm of
its depth, and then along every path by running sums.

Nothing gathers a group: smallest members and counts are aggregated before the shuffle, frequent chains are joined
where their rows lie, running sums go over blocks first, and the ids that end at a node are joined in order by range
partitions before their digest is taken from the pieces. Chains are 128 bits: exclusive ors of two hashes of a turn's
place and of the SHA-256 of its role and text.

Defined cases: rows are in the order of turn (null first), role and text, and repeated rows are turns of their own; null
roles and texts count as empty; rows of a null conv_id belong to no conversation and are left out; a table without
conversations gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyglass.llm.common import join_spread
from tallyglass.plans.ordered import number_rows
from tallyglass.plans.staging import stage

#: Turns of a block are 2^3; blocks of a stretch of running sums 2^10; nodes of one 2^12.
BLOCK_BITS = 3
STRETCH_BITS = 10
NODE_BITS = 12
#: Conversations are rebuilt from the first turns of one in so many; the most turns taken, and one.
FAMILY, MOST_TAKEN = 5, 9
#: Ids joined to a piece.
PIECE_IDS = 1 << 14


def turns(conversations: DataFrame) -> DataFrame:
    """(c, i, digest, size) of every turn of every conversation, numbered from 0."""
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("c"), "turn", empty("role").alias("role"), empty("text").alias("text")).filter("c is not null")
    placed = number_rows(rows.withColumn("head", F.substring("text", 1, 32)), ["c", "turn", "role", "head"], "place", ["text"])
    starts = stage(placed.groupBy("c").agg(F.min("place").alias("start"), F.count("*").alias("n")), "starts")
    # the length in front keeps role and text apart
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    narrow = placed.select("c", "place", F.sha2(said, 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return join_spread(narrow, starts, ["c"], "n").select("c", (F.col("place") - F.col("start")).alias("i"), "digest", "size")


def rebuilt(own: DataFrame) -> DataFrame:
    """(c, i, digest, size) after each conversation took the first turns of the first one of its family."""
    lengths = stage(own.groupBy("c").agg((F.max("i") + 1).alias("n")), "lengths")
    plan = lengths.select(
        "c",
        "n",
        (F.col("c") - F.col("c") % FAMILY).alias("from"),
        (F.crc32(F.col("c").cast("string").cast("binary")) % MOST_TAKEN).alias("h"),
    )
    plan = plan.join(lengths.select(F.col("c").alias("from"), F.col("n").alias("theirs")), "from", "left")
    plan = stage(plan.withColumn("taken", F.least("h", F.coalesce("theirs", F.lit(0)))), "families")
    kept = join_spread(own, plan.select("c", "n", "h", "taken"), ["c"], "n").filter(F.col("i") >= F.col("h"))
    kept = kept.select("c", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "digest", "size")
    heads = own.filter(F.col("i") < MOST_TAKEN).withColumnRenamed("c", "from")
    given = heads.join(plan.select("c", "from", "taken"), "from").filter(F.col("i") < F.col("taken"))
    return kept.unionByName(given.select("c", "i", "digest", "size"))


def blocks(sequence: DataFrame) -> DataFrame:
    """(c, b, e, q1, q2, p1, p2, says) of every block of turns: its end, the chains up to its start and end, its turns.

    A turn says its depth, the chain up to it and its size.
    """
    hashed = sequence.select(
        "c",
        F.shiftright("i", BLOCK_BITS).alias("b"),
        F.struct(
            (F.col("i") + 1).alias("depth"),
            F.xxhash64(F.lit(1), "i", "digest").alias("x1"),
            F.xxhash64(F.lit(2), "digest", "i").alias("x2"),
            "size",
        ).alias("turn"),
    )
    rows = hashed.groupBy("c", "b").agg(
        F.max("turn.depth").alias("e"),
        F.bit_xor("turn.x1").alias("x1"),
        F.bit_xor("turn.x2").alias("x2"),
        F.sort_array(F.collect_list("turn")).alias("says"),
    )
    rows = stage(rows.withColumn("stretch", F.shiftright("b", STRETCH_BITS)), "blocks")
    stretches = rows.groupBy("c", "stretch").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    earlier = Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.select("c", "stretch", *[F.coalesce(F.bit_xor(y).over(earlier), F.lit(0)).alias(z) for y, z in (("y1", "z1"), ("y2", "z2"))])
    inside = Window.partitionBy("c", "stretch").orderBy("b")
    chained = rows.join(before, ["c", "stretch"]).withColumns(
        {f"p{k}": F.bit_xor(f"x{k}").over(inside).bitwiseXOR(F.col(f"z{k}")) for k in (1, 2)}
    )
    chained = chained.withColumns({f"q{k}": F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)})

    def chain(k: int, count):
        return F.aggregate(F.slice("says", 1, count), F.col(f"q{k}"), lambda a, t: a.bitwiseXOR(t[f"x{k}"]))

    say = lambda t, at: F.struct(t["depth"].alias("depth"), chain(1, at + 1).alias("t1"), chain(2, at + 1).alias("t2"), t["size"].alias("size"))
    return chained.select("c", "b", "e", "q1", "q2", "p1", "p2", F.transform("says", say).alias("says"))


def _grouped(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (m, d, n, size), and places (c, d, m): a depth of each conversation and that node's smallest member."""
    ways = ("e", "p1", "p2")
    groups = linked.groupBy("b", "q1", "q2").agg(
        F.count("*").alias("n"), F.min("c").alias("m"), *[F.min(w).alias(f"low_{w}") for w in ways], *[F.max(w).alias(f"high_{w}") for w in ways]
    )
    parted = ~(F.col("low_e").eqNullSafe(F.col("high_e")) & (F.col("low_p1") == F.col("high_p1")) & (F.col("low_p2") == F.col("high_p2")))
    groups = stage(groups.select("b", "q1", "q2", "m", "n", F.col("n").alias("members"), parted.alias("parted")), "groups")
    known = stage(join_spread(linked.drop("p1", "p2"), groups, ["b", "q1", "q2"], "n"), "known")

    said = known.filter("parted").select("c", F.inline("says"))
    inner = stage(said.groupBy("depth", "t1", "t2").agg(F.min("c").alias("m"), F.count("*").alias("n"), F.max("size").alias("size")), "refined")
    refined = join_spread(said.drop("size"), inner.drop("size"), ["depth", "t1", "t2"], "n").select("c", F.col("depth").alias("d"), "m")
    whole = known.filter("not parted")
    nodes = inner.select("m", F.col("depth").alias("d"), "n", "size").unionByName(
        whole.filter("c = m").select("m", F.col("members").alias("n"), F.inline("says")).select("m", F.col("depth").alias("d"), "n", "size")
    )
    return nodes, refined.unionByName(whole.select("c", F.col("e").alias("d"), "m"))


def _summed(paths: DataFrame) -> DataFrame:
    """(m, leaves, saved) of every path with all that hangs on it, from paths (m, up, leaves, saved)."""
    state = stage(paths, "paths")
    while state.filter("up is not null").limit(1).count():
        given = state.filter("up is not null").groupBy(F.col("up").alias("m")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("extra"), F.count("*").alias("n"))
        given = stage(given, "given")
        above = stage(given.join(state.select("m", F.col("up").alias("far")), "m").select(F.col("m").alias("up"), "far", "n"), "above")
        jumped = join_spread(state.filter("up is not null"), above, ["up"], "n").select("m", F.col("far").alias("up"), "leaves", "saved")
        rest = state.filter("up is null")
        state = jumped.unionByName(rest).join(given.drop("n"), "m", "left")
        total = [(F.col(c) + F.coalesce(x, F.lit(0))).alias(c) for c, x in (("leaves", "more"), ("saved", "extra"))]
        state = stage(state.select("m", "up", *total), "paths")
    return state.drop("up")


def _along(nodes: DataFrame) -> DataFrame:
    """Running sums of `leaves` and `saved` from the end of every path up to each node."""
    part = nodes.withColumn("part", F.shiftright("d", NODE_BITS))
    sums = part.groupBy("m", "part").agg(*[F.sum(c).alias(f"all_{c}") for c in ("leaves", "saved")])
    deeper = Window.partitionBy("m").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    below = sums.select("m", "part", *[F.coalesce(F.sum(f"all_{c}").over(deeper), F.lit(0)).alias(f"below_{c}") for c in ("leaves", "saved")])
    inside = Window.partitionBy("m", "part").orderBy(F.desc("d"))
    done = part.join(below, ["m", "part"]).withColumns({c: F.sum(c).over(inside) + F.col(f"below_{c}") for c in ("leaves", "saved")})
    return done.drop("part", "below_leaves", "below_saved")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of a node, in order, joined to pieces."""
    for batch in batches:
        out = []
        for (m, d), ids in batch.groupby(["m", "d"], sort=False)["c"]:
            listed = ids.tolist()
            out += [(m, d, listed[k], ",".join(map(str, listed[k : k + PIECE_IDS]))) for k in range(0, len(listed), PIECE_IDS)]
        yield pd.DataFrame(out, columns=["m", "d", "first", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of every node's pieces, which come in order."""
    here, hashed = None, None
    for batch in batches:
        out = []
        for m, d, ids in zip(batch["m"], batch["d"], batch["ids"], strict=True):
            if here == (m, d):
                hashed.update(b"," + ids.encode())
            else:
                if here:
                    out.append((*here, hashed.hexdigest()))
                here, hashed = (m, d), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["m", "d", "ends_sha256"])
    yield pd.DataFrame([(*here, hashed.hexdigest())] if here else [], columns=["m", "d", "ends_sha256"])


def ended(ends: DataFrame) -> DataFrame:
    """(m, d, ends_sha256) of the nodes at which conversations (c) end."""
    order = ["m", "d", "c"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInPandas(_pieces, "m long, d long, first long, ids string")
    return pieces.repartition("m", "d").sortWithinPartitions("m", "d", "first").mapInPandas(_digests, "m long, d long, ends_sha256 string")


def trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """One row for every node of the trie of the (rebuilt) conversations."""
    own = stage(turns(conversations), "turns")
    ids = own.select("c").distinct()
    sequence = rebuilt(own) if rebuild else own
    nodes, places = _grouped(stage(blocks(sequence), "linked"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = ids.agg(F.min("c").alias("m"), F.count("*").alias("n")).filter("n > 0").select("m", zero.alias("d"), "n", zero.alias("size"))
    nodes = stage(nodes.unionByName(top), "nodes")
    smallest = F.lit(ids.agg(F.min("c")).first()[0]).cast("long")
    places = places.unionByName(ids.select("c", zero.alias("d"), smallest.alias("m")))
    # where a conversation ends, and the deepest node on its path that isn't its own
    ranked = places.groupBy("c").agg(F.max(F.struct("d", "m")).alias("end"), F.max(F.when(F.col("m") != F.col("c"), F.struct("d", "m"))).alias("hang"))
    ranked = stage(ranked.select("c", F.col("end.m").alias("m"), F.col("end.d").alias("d"), F.col("hang.m").alias("up"), F.col("hang.d").alias("at")), "ranked")

    # an own path ends where its conversation does
    owners = ranked.filter("c = m").select("m", F.col("d").alias("last"), "up", "at")
    hung = owners.filter("up is not null").groupBy(F.col("up").alias("m"), F.col("at").alias("d")).agg(F.count("*").alias("hung"))
    childless = owners.join(hung, (owners.m == hung.m) & (owners.last == hung.d), "left_anti").select("m", F.lit(1).cast("long").alias("leaves"))
    saving = nodes.groupBy("m").agg(F.sum((F.col("n") - 1) * F.col("size")).alias("saved"))
    paths = owners.join(childless, "m", "left").join(saving, "m").select("m", "up", F.coalesce("leaves", F.lit(0).cast("long")).alias("leaves"), "saved")
    totals = _summed(paths)

    grafts = owners.filter("up is not null").join(totals, "m").groupBy(F.col("up").alias("m"), F.col("at").alias("d"))
    extra = grafts.agg(F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select("m", "d", "hung", "leaves", "saved", none.alias("up"), zero.alias("over"))
    starts = owners.filter("up is not null").select("m", (F.col("at") + 1).alias("d"), zero.alias("hung"), zero.alias("leaves"), zero.alias("saved"), "up", zero.alias("over"))
    lasts = owners.select("m", F.col("last").alias("d"), zero.alias("hung"), zero.alias("leaves"), zero.alias("saved"), none.alias("up"), F.lit(1).cast("long").alias("over"))
    facts = extra.unionByName(starts).unionByName(lasts).groupBy("m", "d").agg(*[F.sum(c).alias(c) for c in ("hung", "leaves", "saved", "over")], F.max("up").alias("up"))
    known = nodes.join(facts, ["m", "d"], "left")
    given = lambda c: F.coalesce(F.col(c), zero)
    known = known.select(
        "m",
        "d",
        "n",
        F.when(F.col("d") > 0, F.coalesce("up", "m")).alias("parent"),
        (given("hung") + 1 - given("over")).alias("children"),
        (given("leaves") + F.when((given("hung") == 0) & (given("over") == 1), 1).otherwise(0)).alias("leaves"),
        (given("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"),
    )
    done = _along(stage(known, "children")).join(ended(ranked.select("m", "d", "c")), ["m", "d"], "left")
    return done.select(
        F.col("m").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
