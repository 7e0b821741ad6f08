"""Merges of nodes that follow each other: who survives in the end, and which merges lead in a circle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasslark.sources.scratch import saved


def followed(merges: DataFrame) -> DataFrame:
    """loser, survivor, reason over merges (loser, survivor): ok with the last survivor of a chain, or cycle with NULL.

    A node that is to go into several goes into the smallest; a merge into itself is none. Every round doubles how far each
    node has been followed and writes what it has, so a chain of n merges takes log2 n rounds; who is still on the way
    after as many as all nodes need goes in a circle.
    """
    one = merges.where("loser <> survivor").groupBy("loser").agg(F.min("survivor").alias("survivor"))
    ended: list[DataFrame] = []
    way = saved(one, "merges")
    rounds = way.count().bit_length() + 2
    hop = way
    for _ in range(rounds):
        # who stands at a node that goes nowhere has arrived; the others go on as far as that node has come
        on = hop.select(F.col("loser").alias("_at"), F.col("survivor").alias("_next"))
        met = saved(way.join(on, F.col("survivor") == F.col("_at"), "left").select("loser", "survivor", "_next"), "merges")
        ended.append(met.where("_next is null").select("loser", "survivor"))
        way = met.where("_next is not null").select("loser", F.col("_next").alias("survivor"))
        if way.isEmpty():
            break
        # a node that has arrived stays a stop for those behind it
        hop = saved(way.unionByName(_reached(ended)), "merges")
    out = _reached(ended).withColumn("reason", F.lit("ok"))
    return out.unionByName(way.select("loser", F.lit(None).cast(out.schema["survivor"].dataType).alias("survivor"), F.lit("cycle").alias("reason")))


def _reached(ended: list[DataFrame]) -> DataFrame:
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out


def merged(edges: DataFrame, merges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges (src, rel, dst, mentions, confidence) after nodes are merged by merges (loser, survivor), chains to their end. Self loops go, equal edges add up.

    Nodes on a circle, and those that lead into one, stay as they are. tasks: how many the moved edges are dealt to (Spark's choice if None).
    """
    ends = followed(merges).where("reason = 'ok'")
    a, b = (ends.select(F.col("loser").alias(f"_{s}l"), F.col("survivor").alias(f"_{s}s")) for s in ("a", "b"))
    moved = edges.join(a, F.col("src") == F.col("_al"), "left").join(b, F.col("dst") == F.col("_bl"), "left")
    moved = moved.select(F.coalesce("_as", "src").alias("src"), "rel", F.coalesce("_bs", "dst").alias("dst"), "mentions", "confidence").where("src <> dst")
    if tasks:
        moved = moved.repartition(tasks, "src", "rel", "dst")
    return moved.groupBy("src", "rel", "dst").agg(F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"))


def plan(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, into, reason, survivor over wanted merges (node, into): ok with who survives in the end, or why not (same, node_missing, target_missing, cycle)."""
    known = nodes.select(F.col("name").alias("node"), F.lit(True).alias("has_node")).distinct()
    target = nodes.select(F.col("name").alias("into"), F.lit(True).alias("has_into")).distinct()
    j = wanted.join(known, "node", "left").join(target, "into", "left")
    reason = F.when(F.col("node") == F.col("into"), "same").when(F.col("has_node").isNull(), "node_missing").when(F.col("has_into").isNull(), "target_missing").otherwise("ok")
    j = saved(j.select("node", "into", reason.alias("reason")), "plan")
    ends = followed(j.where("reason = 'ok'").select(F.col("node").alias("loser"), F.col("into").alias("survivor")))
    j = j.join(ends.select(F.col("loser").alias("node"), "survivor", F.col("reason").alias("_end")), "node", "left")
    fine = F.col("reason") == "ok"
    return j.select("node", "into", F.when(fine, F.col("_end")).otherwise(F.col("reason")).alias("reason"), F.when(fine, F.col("survivor")).alias("survivor"))


def reconciled(before: DataFrame, after: DataFrame, merges: DataFrame) -> DataFrame:
    """nodes_before, nodes_after, merged, as_planned over the names (name) before and after: after = before - merged."""
    n = before.select("name").distinct().agg(F.count(F.lit(1)).alias("nodes_before")).join(after.select("name").distinct().agg(F.count(F.lit(1)).alias("nodes_after")))
    gone = followed(merges).where("reason = 'ok'").join(before.select(F.col("name").alias("loser")).distinct(), "loser").agg(F.count(F.lit(1)).alias("merged"))
    return n.join(gone).withColumn("as_planned", F.col("nodes_after") == F.col("nodes_before") - F.col("merged"))
