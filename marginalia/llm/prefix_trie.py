"""The trie of conversations' prefixes, with counts and repeated tokens of every subtree, by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. The member of least id owns
the node, and as it then owns every later node of its path that no smaller member shares, each conversation owns a suffix of
its path. Every node of a subtree has one owner among the subtree's members, so a subtree's sums are sums over members: the
tokens of what a member says from there on (occurrences) less those of the nodes it owns, its leaf if it owns one, and one child
where it owns the next node. One group-by of the prefixes gives them all, however deep the subtree.

Nothing gathers a node's members or a conversation's turns in one place: ordinals come from a range sort, running keys from
blocks of BLOCK turns, owners from a ranking whose limit is taken before the shuffle, and sums from partial aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import materialize, with_unique

#: Turns of a conversation, and consecutive ids, that are handled together.
BLOCK = 4096
SPACE = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "k1", "k2"]


def turns_of(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, i, said, tokens: a conversation's turns numbered from 1 in order of turn (null first), equal ones by role and then
    by the SHA-256 of the text. said tells turns apart by role and text, where null counts as empty."""
    words = F.coalesce(F.col(text), F.lit(""))
    part = rows.select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.sha2(words, 256).alias("digest"), F.regexp_count(words, F.lit(SPACE)).cast("long").alias("tokens"),
    ).where("conv is not null")
    part = materialize(part, "turns")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    # The number of a row grows within a partition in sorted order; its upper bits are the partition. A long conversation
    # takes as many partitions as it fills.
    ranged = part.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "digest"), 256)
    ranged = materialize(ranged.select("conv", "at", F.shiftright("at", 33).alias("part"), said.alias("said"), "tokens"), "ranged")
    parts = ranged.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return ranged.join(parts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("i"), "said", "tokens")


def spliced(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) whose first `head` turns (a column over conv, at most `most`) are those of conversation `base`.

    conversations: conv, depth (turns in all). turns: conv, depth (from 1), said, tokens. A base with fewer turns, or none,
    gives what it has; then follow the conversation's own turns after its first `head`. A base should serve few conversations.
    """
    lengths = turns.groupBy("conv").agg(F.count("*").alias("own"))
    of = lengths.select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    plan = lengths.withColumn("base", base).withColumn("head", head).join(of, "base", "left")
    taken = F.least(F.col("head"), F.coalesce("base_turns", F.lit(0)))
    plan = materialize(plan.select("conv", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("depth")), "plan")
    first = turns.where(F.col("i") <= most).select(F.col("conv").alias("base"), "i", "said", "tokens")
    heads = plan.where("taken > 0").select("conv", "base", "taken").join(first, "base").where("i <= taken")
    heads = heads.select("conv", F.col("i").alias("depth"), "said", "tokens")
    rest = turns.join(plan.select("conv", "head", "taken"), "conv").where("i > head")
    rest = rest.select("conv", (F.col("taken") + F.col("i") - F.col("head")).alias("depth"), "said", "tokens")
    return plan.select("conv", "depth"), heads.unionByName(rest)


def _paths(turns: DataFrame) -> DataFrame:
    """conv, depth, k1, k2 (the prefix's key), up1, up2 (its parent's), tokens, before (tokens of the turns before).

    A key is the exclusive or of hashes of the turns with their depths, in two lanes of 64 bits."""
    tag = [F.xxhash64(F.lit(seed), "depth", "said").alias(f"t{lane}") for lane, seed in ((1, "left"), (2, "right"))]
    tagged = turns.select("conv", "depth", "tokens", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), *tag)
    sums = [F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"), F.sum("tokens").alias("x3")]
    within = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = tagged.select(
        "conv", "depth", "block", "t1", "t2", "tokens", F.bit_xor("t1").over(within).alias("k1"), F.bit_xor("t2").over(within).alias("k2"),
        F.sum("tokens").over(within).alias("so_far"),
    )
    # Only conversations of over BLOCK turns have blocks before others.
    long = materialize(tagged.where("block > 0").select("conv").distinct(), "long")
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = tagged.join(long, "conv", "left_semi").groupBy("conv", "block").agg(*sums)
    blocks = blocks.select("conv", "block", *[f(f"x{n}").over(earlier).alias(f"x{n}") for n, f in ((1, F.bit_xor), (2, F.bit_xor), (3, F.sum))])
    run = run.join(materialize(blocks.where("block > 0"), "blocks"), ["conv", "block"], "left")
    k = [F.col(f"k{n}").bitwiseXOR(F.coalesce(f"x{n}", F.lit(0).cast("long"))) for n in (1, 2)]
    return run.select(
        "conv", "depth", k[0].alias("k1"), k[1].alias("k2"), k[0].bitwiseXOR(F.col("t1")).alias("up1"), k[1].bitwiseXOR(F.col("t2")).alias("up2"),
        "tokens", (F.col("so_far") - F.col("tokens") + F.coalesce("x3", F.lit(0))).alias("before"),
    )


def _end_digests(ends: DataFrame) -> DataFrame:
    """Node and ends_sha256 of conversations (conv, depth, k1, k2) by the node they end at.

    Ids are joined in runs of at most BLOCK before they are shuffled to their node, where the hash takes one run at a time."""
    run = ends.groupBy(*NODE, F.floor(F.col("conv") / BLOCK).alias("run")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    run = run.select(*NODE, "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("joined"))
    run = run.repartition(*NODE).sortWithinPartitions(*NODE, "run")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for b in batches:
            done = []
            for *node, joined in zip(*(b.column(n).to_pylist() for n in (0, 1, 2, 4)), strict=True):
                if node != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256(joined.encode())
                else:
                    state.update(b"," + joined.encode())
            if done:
                yield batch(done)
        if now is not None:
            yield batch([(*now, state.hexdigest())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=[*NODE, "ends_sha256"])

    ship(ends.sparkSession)
    return run.mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    convs: conv (unique), depth (its number of turns); turns: conv, depth (1, 2, ... without gaps), said, tokens. conv_id is the
    least member; the root has depth 0 and no turn. saved_tokens sums (members - 1) * tokens over the subtree; n_leaves counts
    its childless nodes, itself included; ends_sha256 hashes the ids that end here, ascending and comma-joined. Without
    conversations there are no nodes, not even a root.
    """
    convs = convs.select("conv", F.col("depth").cast("long").alias("ends"))
    paths = materialize(_paths(turns), "paths")
    smallest = Window.partitionBy(*NODE).orderBy("conv")
    owned = paths.withColumn("rank", F.row_number().over(smallest)).where("rank = 1").drop("rank")
    owned = materialize(owned, "owned")
    inner = owned.select((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")).distinct()
    leaves = owned.join(inner, NODE, "left_anti").select("conv", F.lit(1).alias("leaf"))
    suffix = owned.groupBy("conv").agg(F.min("depth").alias("owns"), F.min_by("before", "depth").alias("owns_before"))
    totals = paths.groupBy("conv").agg(F.sum("tokens").alias("total"))
    of = convs.join(totals, "conv", "left").join(suffix, "conv", "left").join(leaves, "conv", "left")
    of = of.select("conv", "ends", F.coalesce("total", F.lit(0)).alias("total"), "owns", "owns_before", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    of = materialize(of, "members")

    # The root is every conversation's prefix of no turns.
    root = of.select("conv", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in ("k1", "k2", "before")])
    member = paths.select("conv", "depth", "k1", "k2", "before").unionByName(root).join(of, "conv")
    repeated = F.greatest(F.coalesce(F.least("total", "owns_before"), F.col("total")) - F.col("before"), F.lit(0))
    next_owned = (F.col("depth") < F.col("ends")) & F.coalesce(F.col("depth") + 1 >= F.col("owns"), F.lit(False))
    nodes = member.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(next_owned.cast("long")).alias("n_children"),
        F.sum("leaf").cast("long").alias("n_leaves"), F.sum(repeated).alias("saved_tokens"),
    )
    # Nobody owns the root by a turn; it is a leaf if no conversation has one.
    nodes = nodes.withColumn("n_leaves", F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(F.col("n_leaves")).cast("long"))
    nodes = materialize(nodes, "nodes")

    # A node's parent is its owner's own, but for the first that each owner owns.
    first = owned.join(suffix.select("conv", F.col("owns").alias("depth")), ["conv", "depth"])
    first = first.select("depth", "k1", "k2", F.struct((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")).alias("parent"))
    first = materialize(first, "first")
    lead = first.groupBy("parent").agg(F.count("*").alias("rows"))
    held = nodes.select(F.struct(*NODE).alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(lead, "parent")
    led = with_unique(first, materialize(held, "held"), "parent", first.count()).select(*NODE, "parent_conv_id")
    ends = paths.select("conv", *NODE).unionByName(root.select("conv", *NODE)).join(of.select("conv", F.col("ends").alias("depth")), ["conv", "depth"])
    out = nodes.join(led, NODE, "left").join(_end_digests(ends), NODE, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
