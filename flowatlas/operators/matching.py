"""Matching car routes to a road graph: nearest nodes and shortest paths by joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.functions import geo
from flowatlas.operators.congestion import edge_keys
from flowatlas.operators.paths import shortest_paths
from flowatlas.sources.store import shared_checkpoint


def undirected(edges: DataFrame) -> DataFrame:
    """(node_lo, node_hi, length): the shortest of the parallel edges in either direction, by the graph's date if there is one."""
    ends = [F.least("origin", "destination").alias("node_lo"), F.greatest("origin", "destination").alias("node_hi")]
    return edges.groupBy(*ends, *edge_keys(edges)[2:]).agg(F.min("length").alias("length"))


def nearest_nodes(points: DataFrame, nodes: DataFrame, *, cell_degrees: float = 0.005) -> DataFrame:
    """``points`` (lon, lat and their own columns) with node_id of the nearest node by great-circle distance; of equal ones the smallest.

    Nodes are binned by their unit vectors in cubes, so poles and the antimeridian are like all other places. A point
    looks at its cube and the 26 around it: whatever lies outside is at least a cube's side away, as the chord goes.
    Points whose best node may be farther look again in cubes twice as large, until these span the globe; no point is
    left out unless it has no coordinates or there is no node at all. ``cell_degrees`` is the side of the first cubes;
    where nodes are dense they start smaller.
    """
    columns = points.columns
    todo = shared_checkpoint(points.where("lon is not null and lat is not null").withColumn("_p", F.monotonically_increasing_id()))
    # of nodes at one place only the smallest can win
    placed = shared_checkpoint(nodes.groupBy(F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).agg(F.min("node_id").alias("node_id")))
    n_nodes = placed.count()
    done, side = None, _first_side(placed, math.radians(cell_degrees))
    while True:
        spots, few = todo.select("_p", "lon", "lat"), placed
        if todo.count() < n_nodes:
            best = _nearest(_spread(_binned(spots, "lon", "lat", side)), _binned(few, "_lon", "_lat", side), ["_p", "lon", "lat"])
        else:  # a point meets all its nodes in its own cube, so nothing but points and nodes is sent
            best = _nearest(_binned(spots, "lon", "lat", side), _spread(_binned(few, "_lon", "_lat", side)), ["_p", "lon", "lat", *CUBE])
        joined = shared_checkpoint(todo.join(best, "_p", "left"))
        chord = 2 * F.sin(F.col("_d") / (2 * geo.EARTH_M))
        last = side >= 2  # three cubes in each direction hold the whole sphere
        sure = F.lit(last) | F.coalesce(chord <= side * (1 - 1e-9), F.lit(False))
        ready = joined.where(sure & F.col("_d").isNotNull())
        done = ready if done is None else done.unionByName(ready)
        todo = joined.where(~sure).drop("_d", "node_id")
        if last or todo.isEmpty():
            return done.select(*columns, "node_id")
        side *= 2


#: A cube of unit vectors; nodes of the fullest cube up to which the first cubes aren't halved, and the least side, some 6 cm.
CUBE, FULL, LEAST = ["_x", "_y", "_z"], 32, 1e-8


def _first_side(nodes: DataFrame, side: float) -> float:
    """``side`` halved until no cube is too full, so that points among many nodes meet few of them."""
    while side > LEAST:
        fullest = _binned(nodes, "_lon", "_lat", side).groupBy(*CUBE).count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= FULL:
            break
        side /= 2
    return side


def _binned(rows: DataFrame, lon: str, lat: str, side: float) -> DataFrame:
    """``rows`` with the cube they lie in."""
    return rows.withColumns({c: F.floor(v / side) for c, v in zip(CUBE, geo.unit_vector(F.col(lon), F.col(lat)))})


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` in their cube and the 26 around it."""
    for c in CUBE:
        rows = rows.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    return rows


def _nearest(points: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(_p, _d, node_id): the nearest node in a point's cubes, of equal ones the smallest.

    The least distance is found first, then the nodes at it: minima of plain numbers need no sort of all pairs.
    """
    distance = geo.haversine(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    least = points.join(nodes, CUBE).groupBy(*keys).agg(F.min(distance).alias("_d"))
    if "_x" not in keys:
        least = points.join(least, keys)
    return least.join(nodes, CUBE).where(distance == F.col("_d")).groupBy("_p", "_d").agg(F.min("node_id").alias("node_id"))


def match_legs(steps: DataFrame, nodes: DataFrame, edges: DataFrame, *, matched: DataFrame | None = None, **options) -> DataFrame:
    """(leg_key, osm_nodes): the route of each leg through its step points, joints not repeated.

    ``steps`` has leg_key, step, lon, lat: from, steps and to in order. Pairs of nodes shared by many legs are searched
    once. Legs of ``matched`` (leg_key, osm_nodes) are not searched again; their routes are returned as they are.
    """
    if matched is not None:
        steps = steps.join(matched.select("leg_key"), "leg_key", "left_anti")
    placed = shared_checkpoint(nearest_nodes(steps, nodes))
    order = Window.partitionBy("leg_key").orderBy("step")
    pairs = placed.withColumn("target", F.lead("node_id").over(order)).where("target is not null").select("leg_key", "step", F.col("node_id").alias("source"), "target")
    paths = shortest_paths(pairs.select("source", "target"), edges, **options)
    parts = pairs.join(paths, ["source", "target"]).groupBy("leg_key").agg(F.array_sort(F.collect_list(F.struct("step", "path"))).alias("_parts"))  # a leg's few steps
    whole = F.aggregate("_parts", F.array().cast("array<bigint>"), lambda route, p: F.concat(route, F.when(F.size(route) == 0, p["path"]).otherwise(F.slice(p["path"], F.lit(2), F.greatest(F.size(p["path"]) - 1, F.lit(0))))))
    routes = parts.select("leg_key", whole.alias("osm_nodes"))
    return routes if matched is None else routes.unionByName(matched.select("leg_key", "osm_nodes"))


def edge_metadata(used: DataFrame, edges: DataFrame) -> DataFrame:
    """Metadata of used edges (origin, destination, directed) without geometry, by undirected key and the graph's date."""
    keys = edge_keys(used, edges)
    ends = [F.least("origin", "destination").alias("node_lo"), F.greatest("origin", "destination").alias("node_hi")]
    return edges.drop("geometry").join(used.select(*ends, *keys[2:]).distinct(), keys)
