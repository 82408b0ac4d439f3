"""Shortest paths on an undirected graph by joins: chains contracted, shortcuts, and rounds that write what improved.

Nodes with two neighbours that no search starts or ends at are taken out; the chains they form become edges (pointer
doubling, so a chain of n nodes takes log n rounds). Shortcuts join what is two, then four edges apart, so a search has
a quarter of the rounds. A round writes the labels it improved and nothing else. Paths are read from the labels: a
node's parent is the smallest neighbour on a shortest way, whatever chain or shortcut the search took.

Lengths count in millionths, as whole numbers, so sums don't depend on the order and equal lengths are equal.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowatlas.sources.store import shared_table

#: Parts of a unit of length; an edge of no length counts as one part, so that every step of a path adds some.
PARTS = 1_000_000
#: Most neighbours of a node that shortcuts of each level lead through; beyond them the edges themselves are used.
THROUGH = (8, 24)
#: Files of improved labels that are read together before they are merged into one.
MERGE = 6
#: Steps of the jumps by which paths are walked: 2, 4, 8.
JUMPS = 3


def _shortest(edges: DataFrame, *extra: str) -> DataFrame:
    """One row of (node, next): the shortest; of equal ones the one with the smallest ``extra``."""
    best = edges.groupBy("node", "next").agg(F.min(F.struct("w", *extra)).alias("_b"))
    return best.select("node", "next", *[F.col(f"_b.{c}").alias(c) for c in ("w", *extra)])


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, next, w) in either direction, from (node_lo, node_hi, length); no loops, the shortest of parallel edges."""
    w = F.greatest(F.round(F.col("length") * PARTS).cast("long"), F.lit(1)).alias("w")
    rows = edges.where(F.col("node_lo") != F.col("node_hi"))
    ways = [rows.select(F.col(a).alias("node"), F.col(b).alias("next"), w) for a, b in (("node_lo", "node_hi"), ("node_hi", "node_lo"))]
    return _shortest(ways[0].unionByName(ways[1]))


def contracted(arcs: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The core (node, next, w, last) and its chains' nodes (end, last, inner, place).

    ``arcs`` are both ways of every edge; nodes of ``keep`` (node) stay. ``last`` is the node before ``next`` on the way, the
    node itself where there is no chain. A chain is named by its end and last node; ``place`` counts its nodes from 0 at
    the end. Rings without any node that stays are left out: nothing leads to them.
    """
    plain = shared_table(arcs.groupBy("node").count().where("count = 2").select("node").join(keep.select("node").distinct(), "node", "left_anti"))
    mark = lambda c: plain.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}"))
    ways = arcs.join(mark("node"), "node", "left").join(mark("next"), "next", "left")
    ways = ways.select("node", "next", "w", F.coalesce("_node", F.lit(False)).alias("inner"), F.coalesce("_next", F.lit(False)).alias("open"))
    ways = shared_table(ways.select("*", F.col("next").alias("end"), F.col("node").alias("last"), F.lit(0).cast("long").alias("place")))
    straight = ways.where("not inner and not open")
    chained = ways.where("inner or open")
    rounds = plain.count().bit_length() + 1
    for _ in range(rounds):
        if chained.where("open").isEmpty():
            break
        # the way on from an end that is a chain's node: the one of its two that doesn't go back
        on = chained.where("inner").select(F.col("node").alias("end"), F.col("next").alias("_n"), F.col("w").alias("_w"), F.col("open").alias("_o"), F.col("end").alias("_e"), F.col("last").alias("_l"), F.col("place").alias("_p"))
        going = chained.where("open").join(on, "end").where(F.col("_n") != F.col("last"))
        moved = going.select("node", "next", (F.col("w") + F.col("_w")).alias("w"), "inner", F.col("_o").alias("open"), F.col("_e").alias("end"), F.col("_l").alias("last"), (F.col("place") + F.col("_p") + 1).alias("place"))
        chained = shared_table(chained.where("not open").unionByName(moved))
    done = chained.where("not open")
    ends = straight.unionByName(done.where("not inner")).where(F.col("node") != F.col("end"))
    core = _shortest(ends.select("node", F.col("end").alias("next"), "w", "last"), "last")
    return shared_table(core), done.where("inner").select("end", "last", F.col("node").alias("inner"), "place")


def with_shortcuts(core: DataFrame) -> DataFrame:
    """(node, next, w): the core's edges, and shortcuts through nodes of few neighbours, level by level."""
    edges = core.select("node", "next", "w")
    for most in THROUGH:
        few = edges.groupBy("node").count().where(F.col("count") <= most).select(F.col("node").alias("_mid"))
        first = edges.withColumnRenamed("next", "_mid").join(few, "_mid")
        second = edges.select(F.col("node").alias("_mid"), "next", F.col("w").alias("_w"))
        two = first.join(second, "_mid").where(F.col("node") != F.col("next")).select("node", "next", (F.col("w") + F.col("_w")).alias("w"))
        edges = shared_table(_shortest(edges.unionByName(two)))
    return edges


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _least(parts: list[DataFrame]) -> DataFrame:
    """The best label of each source and node; ``goal`` says whether the node is one of the source's targets."""
    return _union(parts).groupBy("source", "node", "goal").agg(F.min("d").alias("d"))


def labels(wanted: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(source, node, goal, d): distances from each source of ``wanted`` (source, target), final on all ways to its targets."""
    goals = wanted.select("source", F.col("target").alias("node"), F.lit(True).alias("_goal"))
    number = wanted.groupBy("source").agg(F.count(F.lit(1)).alias("_targets"))
    start = wanted.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("d")).distinct()
    marked = lambda rows: rows.join(goals, ["source", "node"], "left").select("source", "node", F.coalesce("_goal", F.lit(False)).alias("goal"), "d")
    frontier = shared_table(marked(start))
    known = [frontier]
    for done in count(1):
        # how far a source has to look: to its farthest target, once all of them are reached
        met = _least([k.where("goal") for k in known]).groupBy("source").agg(F.max("d").alias("_far"), F.count(F.lit(1)).alias("_met"))
        far = number.join(met, "source", "left").select("source", F.when(F.col("_met") == F.col("_targets"), F.col("_far")).alias("_far"))
        passed = frontier.join(edges, "node").select("source", F.col("next").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        passed = passed.groupBy("source", "node").agg(F.min("d").alias("d")).join(far, "source").where(F.col("_far").isNull() | (F.col("d") < F.col("_far")))
        before = _least(known).select("source", "node", F.col("d").alias("_d"))
        better = passed.join(before, ["source", "node"], "left").where(F.col("_d").isNull() | (F.col("d") < F.col("_d")))
        frontier = shared_table(marked(better.select("source", "node", "d")))
        if frontier.isEmpty():
            return shared_table(_least(known))
        if max_rounds is not None and done >= max_rounds:
            raise RuntimeError(f"shortest paths still open after {max_rounds} rounds")
        known.append(frontier)
        if len(known) > MERGE:
            known = [shared_table(_least(known))]


def _jumped(rows: DataFrame, jump: DataFrame) -> DataFrame:
    """``rows`` (source, target, at, step) moved by one jump; rows that arrive at the source are left out."""
    moved = rows.join(jump.withColumnRenamed("node", "at"), ["source", "at"])
    return moved.where(F.col("up") != F.col("source")).select("source", "target", F.col("up").alias("at"), "step")


def _walked(wanted: DataFrame, parents: DataFrame) -> DataFrame:
    """(source, target, at, step): the core's nodes on each way, counted from 0 at the target, without the source."""
    jumps = [parents.select("source", "node", F.col("parent").alias("up"))]
    for _ in range(JUMPS):
        ahead = jumps[-1].select("source", F.col("node").alias("up"), F.col("up").alias("_up"))
        jumps.append(shared_table(jumps[-1].join(ahead, ["source", "up"], "left").select("source", "node", F.coalesce("_up", "up").alias("up"))))
    spots = [shared_table(wanted.where(F.col("source") != F.col("target")).select("source", "target", F.col("target").alias("at"), F.lit(0).alias("step")))]
    while not spots[-1].isEmpty():
        spots.append(shared_table(_jumped(spots[-1], jumps[-1]).withColumn("step", F.col("step") + 2**JUMPS)))
    out = _union(spots)
    for k in reversed(range(JUMPS)):
        out = shared_table(out.unionByName(_jumped(out, jumps[k]).withColumn("step", F.col("step") + 2**k)))
    return out


def _spot(place: Column, node: Column) -> Column:
    """What sorts a way's nodes from source to target: steps to the target, then places in a chain."""
    return F.struct((-F.col("step")).alias("step"), place.cast("long").alias("place"), node.alias("node")).alias("_x")


def shortest_paths(pairs: DataFrame, edges: DataFrame, *, max_rounds: int | None = None) -> DataFrame:
    """(source, target, length, path) of each distinct pair (source, target); path as an array of nodes, both ends included.

    ``edges`` has node_lo, node_hi, length. One search per source serves all its targets, up to the farthest of them. Of
    equally short ways, the one whose nodes are smallest, seen from the target back. Unreachable targets, nodes that no
    edge has and pairs with a null drop out, but a node's way to itself is always there. Rounds go on until nothing
    improves; a search that is still open after ``max_rounds``, if given, is an error.
    """
    wanted = shared_table(pairs.select("source", "target").dropna().distinct())
    ends = wanted.select(F.col("source").alias("node")).unionByName(wanted.select(F.col("target").alias("node")))
    core, inner = contracted(shared_table(both_ways(edges)), ends)
    known = labels(wanted, with_shortcuts(core), max_rounds)
    near = core.join(known.select("source", "node", F.col("d").alias("_d")), "node").select("source", F.col("next").alias("_v"), (F.col("_d") + F.col("w")).alias("d"), "last", F.col("node").alias("_u"))
    best = near.withColumnRenamed("_v", "node").join(known.drop("goal"), ["source", "node", "d"]).groupBy("source", "node").agg(F.min(F.struct("last", "_u")).alias("_p"))
    parents = shared_table(best.select("source", "node", F.col("_p._u").alias("parent"), F.col("_p.last").alias("last")))
    reached = wanted.join(known.where("goal").select("source", F.col("node").alias("target"), "d"), ["source", "target"])
    spots = _walked(reached.select("source", "target"), parents).join(parents.select("source", F.col("node").alias("at"), "last"), ["source", "at"])
    whole = spots.select("source", "target", _spot(F.lit(0), F.col("at")))
    between = spots.join(inner.withColumnRenamed("end", "at"), ["at", "last"]).select("source", "target", _spot(-F.col("place") - 1, F.col("inner")))
    nodes = whole.unionByName(between).groupBy("source", "target").agg(F.array_sort(F.collect_list("_x")).alias("_x"))  # one way's nodes
    path = F.concat(F.array("source"), F.coalesce(F.col("_x.node"), F.array().cast(f"array<{wanted.schema['source'].dataType.simpleString()}>")))
    return reached.join(nodes, ["source", "target"], "left").select("source", "target", (F.col("d") / PARTS).alias("length"), path.alias("path"))
