"""Edge usage, congestion and delays of matched car routes.

Road graphs change with time. Where routes and edge metadata have a column ``graph_date``, edges are told apart by it in
usage, factors, delays and metadata, so that a simulation meets the graph of its own date only. If just one side has it,
that is an error, as graphs of several dates would be mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LANES, MOTO_CAP = 2, 0.7


def edge_keys(*tables: DataFrame) -> list[str]:
    """What tells edges apart: both nodes, and the date of the graph if the tables have one."""
    dated = {"graph_date" in t.columns for t in tables}
    if len(dated) > 1:
        raise ValueError("graph_date must be a column of all tables or of none")
    return ["node_lo", "node_hi", *(["graph_date"] if dated == {True} else [])]


def first_car_routes(legs: DataFrame) -> DataFrame:
    """The matched legs of each commuter's first car route.

    ``legs`` has vc_id, option_id, option_ord, itinerary_ord, leg_seq and osm_nodes (array or null). The first itinerary
    with any matched leg, options and itineraries in order, is taken with all its matched legs.
    """
    matched = legs.where(F.col("osm_nodes").isNotNull())
    first = matched.groupBy("vc_id").agg(F.min(F.struct("option_ord", "itinerary_ord")).alias("_first"))
    return matched.join(first, "vc_id").where(F.struct("option_ord", "itinerary_ord") == F.col("_first")).drop("_first")


def edges_of(nodes: Column) -> Column:
    """Consecutive node pairs of a route as an array of (node_lo, node_hi), undirected."""
    n = F.greatest(F.size(nodes) - 1, F.lit(0))
    return F.zip_with(F.slice(nodes, F.lit(1), n), F.slice(nodes, F.lit(2), n), lambda a, b: F.struct(F.least(a, b).alias("node_lo"), F.greatest(a, b).alias("node_hi")))


def route_edges(routes: DataFrame) -> DataFrame:
    """A row per traversed edge: the columns of ``routes`` but osm_nodes, and node_lo, node_hi."""
    kept = [c for c in routes.columns if c != "osm_nodes"]
    return routes.select(*kept, F.explode(edges_of(F.col("osm_nodes"))).alias("_e")).select(*kept, "_e.node_lo", "_e.node_hi")


def edge_usage(routes: DataFrame, *, vehicles_per_journey: float = 1.0, mask: DataFrame | None = None) -> DataFrame:
    """node_lo, node_hi, usage: traversals times vehicles per journey, of the commuters in ``mask`` (vc_id) if given."""
    if mask is not None:
        routes = routes.join(mask, "vc_id", "left_semi")
    return route_edges(routes).groupBy(*edge_keys(routes)).agg((F.count(F.lit(1)) * F.lit(float(vehicles_per_journey))).alias("usage"))


def lanes_of(lanes: Column) -> Column:
    """First lane value as a number; 2 when missing, unreadable or 0."""
    number = F.try_element_at(lanes, F.lit(1)).try_cast("int")
    return F.when(number.isNull() | (number == 0), DEFAULT_LANES).otherwise(number)


def congestion_factors(usage: DataFrame, edges: DataFrame) -> DataFrame:
    """node_lo, node_hi, usage, factor in (0, 1]: lanes by usage, at most 1. Edges without metadata drop out."""
    road = F.col("usage") / lanes_of(F.col("lanes"))
    factor = F.least(F.lit(1.0), 1 / F.when(road == 0, 1.0).otherwise(road))
    keys = edge_keys(usage, edges)
    return usage.join(edges, keys).select(*keys, "usage", factor.alias("factor"))


def missing_edges(usage: DataFrame, edges: DataFrame) -> DataFrame:
    """Used edges without metadata."""
    return usage.join(edges, edge_keys(usage, edges), "left_anti")


def leg_delays(routes: DataFrame, edges: DataFrame, factors: DataFrame, travellers: DataFrame, *, moto_rule: str = "cap", cap: float = MOTO_CAP) -> DataFrame:
    """vc_id, option_id, leg_seq, factor, delay in seconds of each leg of the first car routes.

    The leg's factor is the length-weighted mean over its edges; edges without usage count 1, a leg of length 0 has no
    delay. Motorcycle owners' factor is held at ``cap`` from above ("cap") or below ("floor").
    """
    edge = edge_keys(routes, edges, factors)
    length = edges.select(*edge, "length").join(factors.select(*edge, "factor"), edge, "left")
    keys = ["vc_id", "option_id", "leg_seq", "departure", "arrival"]
    sums = route_edges(routes.select(*keys, *edge[2:], "osm_nodes")).join(length, edge).groupBy(*keys).agg(F.sum(F.coalesce("factor", F.lit(1.0)) * F.col("length")).alias("_fl"), F.sum("length").alias("_l"))
    joined = sums.join(travellers.select("vc_id", "moto"), "vc_id", "left")
    mean = F.coalesce(F.try_divide(F.col("_fl"), F.col("_l")), F.lit(1.0))
    held = F.least(F.col("factor"), F.lit(cap)) if moto_rule == "cap" else F.greatest(F.col("factor"), F.lit(cap))
    joined = joined.withColumn("factor", mean).withColumn("factor", F.when((F.coalesce("moto", F.lit(0)) != 0) & (F.col("_l") > 0), held).otherwise(F.col("factor")))
    planned = F.timestamp_diff("SECOND", F.col("departure"), F.col("arrival"))
    return joined.select("vc_id", "option_id", "leg_seq", "factor", (planned / F.col("factor") - planned).alias("delay"))


def option_delays(delays: DataFrame) -> DataFrame:
    return delays.groupBy("option_id").agg(F.sum("delay").alias("delay"))


def delay_distribution(routes: DataFrame, edges: DataFrame, travellers: DataFrame, factors: list[float], *, citizens: float, results: int, bin_seconds: float = 60.0) -> DataFrame:
    """vehicle_factor, bin, options: delays per option, binned, for several vehicle factors.

    Traversals are counted once; each vehicle factor (a literal list) scales them to citizens / results * factor.
    """
    spark = routes.sparkSession
    counts = edge_usage(routes)
    scaled = counts.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(float(f)).alias("vehicle_factor"), F.lit(citizens / max(results, 1) * f).alias("vehicles")) for f in factors])))
    road = F.col("usage") * F.col("_s.vehicles") / lanes_of(F.col("lanes"))
    edge = edge_keys(routes, edges)
    table = scaled.join(edges, edge).select(F.col("_s.vehicle_factor").alias("vehicle_factor"), *edge, "length", F.least(F.lit(1.0), 1 / F.when(road == 0, 1.0).otherwise(road)).alias("factor"))
    keys = ["vehicle_factor", "vc_id", "option_id", "leg_seq", "departure", "arrival"]
    sums = route_edges(routes.select("vc_id", "option_id", "leg_seq", "departure", "arrival", *edge[2:], "osm_nodes")).join(table, edge).groupBy(*keys).agg(F.sum(F.col("factor") * F.col("length")).alias("_fl"), F.sum("length").alias("_l"))
    mean = F.coalesce(F.try_divide(F.col("_fl"), F.col("_l")), F.lit(1.0))
    legs = sums.join(travellers.select("vc_id", "moto"), "vc_id", "left").withColumn("_f", F.when((F.coalesce("moto", F.lit(0)) != 0) & (F.col("_l") > 0), F.least(mean, F.lit(MOTO_CAP))).otherwise(mean))
    planned = F.timestamp_diff("SECOND", F.col("departure"), F.col("arrival"))
    options = legs.groupBy("vehicle_factor", "option_id").agg(F.sum(planned / F.col("_f") - planned).alias("delay"))
    return options.groupBy("vehicle_factor", F.floor(F.round(F.col("delay"), 4) / bin_seconds).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("options"))


def used_edges(routes: DataFrame) -> DataFrame:
    """The different directed edges: origin, destination, and the graph's date if routes have one."""
    n = F.greatest(F.size("osm_nodes") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("osm_nodes", F.lit(1), n), F.slice("osm_nodes", F.lit(2), n), lambda a, b: F.struct(a.alias("origin"), b.alias("destination")))
    dated = edge_keys(routes)[2:]
    return routes.select(*dated, F.explode(pairs).alias("e")).select("e.*", *dated).distinct()


def used_nodes(edges: DataFrame, nodes: DataFrame, lo: str = "node_lo", hi: str = "node_hi") -> DataFrame:
    """Metadata of the nodes at either end of the edges."""
    dated = edge_keys(edges, nodes)[2:]
    used = edges.select(*dated, F.explode(F.array(lo, hi)).alias("node_id")).distinct()
    return nodes.join(used, ["node_id", *dated])
