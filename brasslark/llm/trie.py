"""Prefix trie of conversations, level by level, and what sharing prefixes saves.

Conversations are lists of turns; a node is a distinct sequence of first turns. Per depth the live conversations are grouped by
(parent node, next turn), and the group's smallest conv_id names the node. A conversation that is alone in its node is settled:
the rest of it is a chain of nodes of its own, which needs no grouping. From depth STRIDES on a level holds several depths,
twice as many each time up to STRIDE, so conversations that share hundreds of turns take tens of rounds; a level's group
is then (parent node, next turns). Afterwards levels are joined in reverse, and leaves and savings are summed up to the root.

Turns are compared by SHA-256 of role and text. Null roles and texts are empty; turns come in the order of turn (null first),
role, text; repeated rows are turns of their own; rows without conv_id belong to no conversation. No conversations make no trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasslark.llm.common import salted, saved, spread_join, word_count
from brasslark.operators.scans import placed

#: Depths that are levels of their own, and most depths of one level.
STRIDES, STRIDE = 4, 32
#: Ids put into one text on the way to a digest.
CHUNK = 4096


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, at, turn, tokens) per turn: its place from 1, the hash of role and text, the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("place"), role.alias("role"), text.alias("text"))
    own = placed(own, ["conv_id"], [F.col("place").asc_nulls_first(), F.col("role"), F.col("text")], "at")
    return own.select("conv_id", "at", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("turn"), word_count(F.col("text")).alias("tokens"))


def grafted(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first `heads` (at most `most`) turns of conversation `base`, then their own turns after as many. Both columns are of conv_id.

    Gives (conv_id, size) of every conversation and (conv_id, at, turn, tokens) of every rebuilt turn.
    """
    convs = saved(turns.groupBy("conv_id").agg(F.max("at").alias("own")).withColumn("base", base).withColumn("h", heads), "convs")
    first = turns.where(F.col("at") <= most).select(F.col("conv_id").alias("base"), "at", "turn", "tokens")
    taken = saved(convs.where("h > 0").select("conv_id", "base", "h").join(first, "base").where("at <= h").select("conv_id", "at", "turn", "tokens"), "heads")
    taken_n = taken.groupBy("conv_id").agg(F.max("at").alias("taken"))
    convs = convs.join(taken_n, "conv_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    convs = saved(convs.select("conv_id", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "convs")
    rest = turns.join(convs, "conv_id").where("at > h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("at"), "turn", "tokens")
    return convs.select("conv_id", "size"), saved(taken.union(rest), "rebuilt")


def _chained() -> Column:
    """Names the turns of a level up to this row: their hashes one after the other."""
    return F.array_join(F.collect_list("turn").over(Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "")


def _levels(turns: DataFrame, top: DataFrame) -> list[tuple[int, int, DataFrame]]:
    """(first depth, last depth, table) of each level, the root's first; top is its table.

    A table has (conv_id, at, node, n, above, tokens): each live conversation's node at each depth of the level, the
    conversations in it, the node before. A conversation that gets alone in a node has no row after it.
    """
    levels, depth, step = [(0, 0, top)], 0, 1
    while True:
        live = levels[-1][2].where((F.col("at") == depth) & (F.col("n") > 1)).select("conv_id", F.col("node").alias("parent"))
        block = turns.where((F.col("at") > depth) & (F.col("at") <= depth + step)).join(live, "conv_id")
        named = F.sha2(_chained(), 256) if step > 1 else F.col("turn")
        block = salted(block.select("conv_id", "at", "parent", named.alias("next"), "tokens"), "block")
        nodes = block.groupBy("parent", "at", "next").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"))
        met, own = spread_join(block, nodes, "parent", "at", "next"), Window.partitionBy("conv_id").orderBy("at")
        met = met.select("conv_id", "at", "node", "n", F.coalesce(F.lag("node").over(own), "parent").alias("above"), "tokens", F.lag("n").over(own).alias("before"))
        level = saved(met.where("before is null or before > 1").drop("before"), "level")
        if level.isEmpty():
            return levels
        levels.append((depth + 1, depth + step, level))
        depth += step
        step = 1 if depth < STRIDES else min(2 * step, STRIDE)


def _named(level: DataFrame) -> DataFrame:
    """The nodes of a table of paths, each in the row of the conversation that it is named by."""
    return level.where("conv_id = node").select("at", "node", "above", "n", "tokens")


def _rolled(levels: list[tuple[int, int, DataFrame]], single: DataFrame) -> DataFrame:
    """(at, node, n_leaves, saved_tokens) of all nodes; single has (at, node) of those that hold one leaf and no node of a level below."""
    out, below = None, None
    for first, last, level in reversed(levels):
        own = _named(level).join(single.withColumn("leaf", F.lit(1).cast("long")), ["at", "node"], "left")
        own = own.select("at", "node", "above", ((F.col("n") - 1) * F.col("tokens")).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
        if below is not None:
            own = own.join(below, ["at", "node"], "left").select("at", "node", "above", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaf") + F.coalesce("l", F.lit(0))).alias("leaf"))
        if last > first:  # a node's values also go to the nodes before it on the path of the conversation that names it
            after = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            path = level.select("conv_id", "at", "node", "above").join(own.select(F.col("node").alias("conv_id"), "at", "saved", "leaf"), ["conv_id", "at"], "left")
            path = path.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(after) for c in ("saved", "leaf")})
            own = path.groupBy("at", "node").agg(F.max(F.when(F.col("conv_id") == F.col("node"), F.col("above"))).alias("above"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
        own = saved(own, "rolled")
        below = own.where(F.col("at") == first).groupBy((F.col("at") - 1).alias("at"), F.col("above").alias("node")).agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
        total = own.select("at", "node", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        out = total if out is None else out.union(total)
    return out


def id_digests(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and ends_sha256: SHA-256 of a key's conv_ids in decimal, ascending, joined by commas.

    Tasks over ranges of (keys, conv_id) write CHUNK ids at a time into one text; a key's texts then stream through one
    digest in order, so no task holds a key's ids, however many.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, ids = [*keys, "first", "ids"], None, []

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in now), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, "conv_id")), strict=True):
                if ids and (row[:-1] != now or len(ids) == CHUNK):
                    yield chunk()
                    ids = []
                now = row[:-1]
                ids.append(row[-1])
        if ids:
            yield chunk()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def done(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in found], pa.int64()) for i in range(len(keys))), pa.array([h for _, h in found], pa.string())], [*keys, "ends_sha256"])

        for b in batches:
            found = []
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, "ids")), strict=True):
                if row[:-1] != now:
                    if now is not None:
                        found.append((now, sha.hexdigest()))
                    now, sha = row[:-1], hashlib.sha256(row[-1].encode())
                else:
                    sha.update(f",{row[-1]}".encode())
            if found:
                yield done(found)
        if now is not None:
            yield done([(now, sha.hexdigest())])

    schema = ", ".join(f"{k} long" for k in keys)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.select(*[F.col(k).cast("long").alias(k) for k in keys], "conv_id").repartitionByRange(n, *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    parts = parts.mapInArrow(texts, f"{schema}, first long, ids string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").select(*keys, "ids").mapInArrow(digest, f"{schema}, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs has (conv_id, size), also those without turns; turns (conv_id, at, turn, tokens) with at from 1 to size. Members of
    a node are the conversations that start with it; n_leaves and saved_tokens are over its subtree, itself included.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    top = convs.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"))  # one row
    top = convs.join(F.broadcast(top)).select("conv_id", zero.alias("at"), "node", "n", F.lit(None).cast("long").alias("above"), zero.alias("tokens"))
    levels = _levels(turns, saved(top, "level"))
    paths = reduce(DataFrame.union, (level for _, _, level in levels))

    reached = paths.groupBy("conv_id").agg(F.max("at").alias("at"), F.max_by("node", "at").alias("node"))
    reached = saved(convs.join(reached, "conv_id"), "reached")  # a conversation that goes on is alone in its node: what follows is its chain
    chains = turns.join(reached.where("size > at").select("conv_id", "size", F.col("at").alias("from")), "conv_id").where(F.col("at") > F.col("from"))

    named = _named(paths)
    kids = named.where("at > 0").groupBy((F.col("at") - 1).alias("at"), F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    more = reached.where("size > at").select("at", "node", one.alias("more"))
    nodes = named.join(kids, ["at", "node"], "left").join(more, ["at", "node"], "left")
    nodes = saved(nodes.select("at", "node", "above", "n", F.coalesce("kids", zero).alias("kids"), F.coalesce("more", zero).alias("more")), "nodes")
    sums = _rolled(levels, nodes.where("kids = 0").select("at", "node"))

    none = F.lit(hashlib.sha256(b"").hexdigest())
    ends = id_digests(reached.where("size = at").select("at", "node", "conv_id"), "at", "node")
    out = nodes.join(sums, ["at", "node"]).join(ends, ["at", "node"], "left").select(
        F.col("node").alias("conv_id"), F.col("at").alias("depth"), F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("kids") + F.col("more")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    last = F.col("at") == F.col("size")
    return out.union(
        chains.select(
            "conv_id", F.col("at").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
            zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none).alias("ends_sha256"),
        )
    )
