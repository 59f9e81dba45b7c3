"""Sharding by a weighted hash tree.

A row descends from the root to a shard.  At each node every child draws -ln(u) / weight, with u a hash of the row's key
and the child's name; the least draw wins, so a child gets its share by weight.  A draw depends on nothing but key, name
and weight.  When a child's weight rises or a child is added, only rows that it wins move, and they move into it; a node
whose children keep their weights keeps its rows in place.

A node weighs what its children weigh together, or, as a ``Node``, what it says.  There are two ways to grow.  Shards added
to the whole hang from the root, each with its own weight: they take rows from all others in proportion, and rows move into
them only; query op6 reports this one.  A ``Leaf`` put into a rack that keeps its weight takes rows from its rack alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import cut


class Node(NamedTuple):
    """Children under a weight that doesn't follow from theirs."""

    weight: float
    children: tuple


class Leaf(NamedTuple):
    """A shard with a number of its own; plain weights are shards numbered in order."""

    weight: float
    number: int



#: Regions of racks of shards: 3 * 2 * 4 shards of equal weight.
TREE = tuple(tuple(tuple(1.0 for _ in range(4)) for _ in range(2)) for _ in range(3))
#: Blocks of a shard whose slots are counted apart; a fixed number, so that a slot doesn't depend on the number of rows.
BLOCKS = 1024
#: Where each block begins is broadcast for trees of up to this many blocks; rows that stand for more are dealt out in stretches of STRETCH.
BROADCAST_ROWS, STRETCH = 1_000_000, 65_536


def _children(node) -> tuple | None:
    return node.children if isinstance(node, Node) else None if isinstance(node, (int, float, Leaf)) else tuple(node)


def _weight(node) -> float:
    if isinstance(node, (Node, Leaf)):
        return float(node.weight)
    return float(node) if isinstance(node, (int, float)) else sum(map(_weight, node))


def _numbers(node) -> int:
    """How many shards below the node are numbered in order."""
    below = _children(node)
    return sum(map(_numbers, below)) if below is not None else int(not isinstance(node, Leaf))


def _leaves(node) -> int:
    below = _children(node)
    return sum(map(_leaves, below)) if below is not None else 1


def _pick(key: Column, children, path: str, first: int) -> Column:
    """The shard below this node; the draws of a node are made only for rows that reach it."""
    draws, below, at = [], [], first
    for i, child in enumerate(children):
        inner = _children(child)
        if _weight(child) > 0:
            u = (F.pmod(F.xxhash64(key, F.lit(f"{path}/{i}")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
            draws.append(F.struct((-F.ln(u) / _weight(child)).alias("d"), F.lit(len(draws)).alias("i")))
            below.append(_pick(key, inner, f"{path}/{i}", at) if inner is not None else child.number if isinstance(child, Leaf) else at)
        at += _numbers(child)
    if len(draws) == 1:
        return below[0] if isinstance(below[0], Column) else F.lit(below[0])
    best = F.least(*draws)["i"]
    if not any(isinstance(x, Column) for x in below):
        return F.element_at(F.array(*map(F.lit, below)), best + 1)
    out = F.when(best == 0, below[0])
    for i, x in enumerate(below[1:], 1):
        out = out.when(best == i, x)
    return out


def shard_of(key: Column, tree=TREE, added=()) -> Column:
    """The shard number for a key; ``added`` lists the weights of shards added to the tree."""
    return _pick(key, (*tree, *added), "", 0).cast("int")


def shards(docs: DataFrame, tree=TREE, added=()) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; a null text has none and the crc32 of an empty one.  The key is doc_id as text,
    a null one the text 'null'; rows with one doc_id go to one shard.  Slots run from 0 without gaps in each shard, in the
    order of hashed block, doc_id, checksum and size; rows equal in these are interchangeable and are counted before they meet.  An empty table gives no rows;
    texts of any length are taken whole; other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        shard_of(key, tree, added).alias("shard"), shard_of(key, tree, (*added, 1.0)).alias("grown_shard"), F.pmod(F.xxhash64(key, F.crc32(F.coalesce(F.col("text"), F.lit("")))), F.lit(BLOCKS)).alias("block"),
    )
    # equal rows are one with a count, so no repeated document makes a block long
    equal = cut(rows.groupBy("shard", "block", "doc_id", "text_crc32", "size", "grown_shard").agg(F.count("*").alias("n")))
    # blocks keep a slot counter short: a shard's rows are dealt into hashed blocks that are numbered one after another
    before_row = F.sum("n").over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - F.col("n")
    counts = equal.groupBy("shard", "block").agg(F.sum("n").alias("n")).select(F.col("shard").alias("_shard"), F.col("block").alias("_block"), "n")
    before = counts.select("_shard", "_block", F.coalesce(F.sum("n").over(Window.partitionBy("_shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if _leaves((tree, added)) * BLOCKS <= BROADCAST_ROWS:
        before = F.broadcast(before)  # BLOCKS rows a shard at most
    placed = equal.withColumn("own", before_row).join(before, (F.col("shard") == F.col("_shard")) & (F.col("block") == F.col("_block")))
    at = F.col("before") + F.col("own")
    placed = placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard", at.alias("slot"), (at + F.col("n")).alias("end"))
    if equal.where(F.col("n") > STRETCH).take(1):
        # a row that stands for very many is dealt out in stretches, so that no task writes all of them
        stretched = placed.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("end") - 1, F.lit(STRETCH).cast("long"))))
        placed = stretched.withColumn("end", F.least(F.col("end"), F.col("slot") + STRETCH)).repartition("shard", "slot")
    out = placed.withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("end") - 1)))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
