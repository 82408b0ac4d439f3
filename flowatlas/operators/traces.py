"""Traces: ordered points of a travel option, clipping, runs of one mode, and statistics.

A trace row is (option_id, seq, lon, lat, ts, mode, is_leg_start); ``seq`` carries the order and starts at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.functions.geo import haversine

RAIL = ("train", "gondola", "watercraft")
MEASURES = ("car_meters", "rail_meters", "bus_meters", "walk_meters", "car_passengers", "rail_passengers", "bus_passengers", "walkers")


def trace_points(legs: DataFrame) -> DataFrame:
    """Points of all legs in order.

    ``legs`` has option_id, leg_seq, mode, departure, arrival, origin and destination (struct lon, lat), stopovers (array
    of struct lon, lat, arrival, departure, or null), and may have polyline (array of struct lon, lat, decoded) with
    departure_delay and arrival_delay. In this order: a polyline gives its points at evenly spread real-time times;
    without stopovers origin and destination stand if both are located; else every located stopover stands at its
    departure, or else arrival. The leg start is the point of index 0, so an unlocated first stopover leaves none.
    """
    point = lambda idx, lon, lat, ts: F.struct(idx.cast("int").alias("idx"), lon.alias("lon"), lat.alias("lat"), ts.alias("ts"))
    ends = F.array(point(F.lit(0), F.col("origin.lon"), F.col("origin.lat"), F.col("departure")), point(F.lit(1), F.col("destination.lon"), F.col("destination.lat"), F.col("arrival")))
    both = F.col("origin.lon").isNotNull() & F.col("origin.lat").isNotNull() & F.col("destination.lon").isNotNull() & F.col("destination.lat").isNotNull()
    stops = F.transform("stopovers", lambda s, i: point(i, s["lon"], s["lat"], F.coalesce(s["departure"], s["arrival"])))
    stops = F.filter(stops, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    points = F.when(F.coalesce(F.size("stopovers"), F.lit(0)) > 0, stops).when(both, ends)
    if "polyline" in legs.columns:
        begin = F.timestamp_add("SECOND", F.coalesce("departure_delay", F.lit(0)), F.col("departure"))
        end = F.timestamp_add("SECOND", F.coalesce("arrival_delay", F.lit(0)), F.col("arrival"))
        whole, n = F.timestamp_diff("SECOND", begin, end), F.size("polyline")
        line = F.transform("polyline", lambda p, i: point(i, p["lon"], p["lat"], F.timestamp_add("SECOND", F.floor(whole * i / F.greatest(n - 1, F.lit(1))).cast("int"), begin)))
        points = F.when(F.coalesce(n, F.lit(0)) > 0, line).otherwise(points)
    rows = legs.select("option_id", "leg_seq", "mode", F.explode(points).alias("p"))
    order = Window.partitionBy("option_id").orderBy("leg_seq", "p.idx")
    return rows.select("option_id", (F.row_number().over(order) - 1).alias("seq"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), F.col("p.ts").alias("ts"), "mode", (F.col("p.idx") == 0).alias("is_leg_start"))


def with_carry(points: DataFrame, keep: Column, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``points`` where ``keep``, with the start of a leg carried to the next kept point of its trace.

    A dropped leg start is handed on across legs. ``last_start`` is found over the full trace, the previous kept point
    among kept ones; with ``keys``, kept points are told apart by them too.
    """
    full = Window.partitionBy("option_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kept = Window.partitionBy("option_id", *(keys or [])).orderBy("seq")
    if "_last_start" not in points.columns:
        points = points.withColumn("_last_start", F.max(F.when(F.col("is_leg_start"), F.col("seq"))).over(full))
    rows = points.where(keep).withColumn("_before", F.lag("seq").over(kept))
    start = F.col("is_leg_start") | (F.coalesce("_last_start", F.lit(-1)) > F.coalesce("_before", F.lit(-1)))
    return rows.withColumn("is_leg_start", start).drop("_last_start", "_before")


def pair_measures(points: DataFrame, keys: list[str]) -> DataFrame:
    """The eight measures of each group of ``keys``: neighbouring points of one mode add metres, leg starts passengers."""
    order = Window.partitionBy(*keys).orderBy("seq")
    ahead = lambda c: F.lead(c).over(order)
    rows = points.withColumn("_lon", ahead("lon")).withColumn("_lat", ahead("lat")).withColumn("_mode", ahead("mode"))
    pairs = rows.where(F.col("mode") == F.col("_mode")).withColumn("_m", haversine(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")))
    groups = {"car": F.col("mode") == "car", "rail": F.col("mode").isin(*RAIL), "bus": F.col("mode") == "bus", "walk": F.col("mode") == "walking"}
    meters = [F.sum(F.when(of, F.col("_m")).otherwise(0.0)).alias(f"{name}_meters") for name, of in groups.items()]
    people = [F.sum(F.when(of & F.col("is_leg_start"), 1).otherwise(0)).alias("walkers" if name == "walk" else f"{name}_passengers") for name, of in groups.items()]
    return pairs.groupBy(*keys).agg(*meters, *people)


def trace_stats(points: DataFrame) -> DataFrame:
    """The eight measures of each option that has two neighbouring points of one mode."""
    return pair_measures(points, ["option_id"])


def leg_stats(legs: DataFrame) -> DataFrame:
    """The eight measures per option from stopover chains (or origin to destination), one passenger a leg."""
    stops = F.filter(F.coalesce("stopovers", F.array().cast("array<struct<lon:double,lat:double>>") if "stopovers" not in legs.columns else F.col("stopovers")), lambda s: s["lon"].isNotNull() & s["lat"].isNotNull())
    chain = F.when(F.coalesce(F.size("stopovers"), F.lit(0)) > 0, F.transform(stops, lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat")))).otherwise(F.array(F.struct(F.col("origin.lon").alias("lon"), F.col("origin.lat").alias("lat")), F.struct(F.col("destination.lon").alias("lon"), F.col("destination.lat").alias("lat"))))
    steps = F.zip_with(F.slice("_chain", F.lit(1), F.greatest(F.size("_chain") - 1, F.lit(0))), F.slice("_chain", F.lit(2), F.greatest(F.size("_chain") - 1, F.lit(0))), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    rows = legs.withColumn("_chain", chain).withColumn("_m", F.aggregate(steps, F.lit(0.0), lambda s, d: s + F.coalesce(d, F.lit(0.0))))
    groups = {"car": F.col("mode") == "car", "rail": F.col("mode").isin(*RAIL), "bus": F.col("mode") == "bus", "walk": F.col("mode") == "walking"}
    meters = [F.sum(F.when(of, F.col("_m")).otherwise(0.0)).alias(f"{name}_meters") for name, of in groups.items()]
    people = [F.sum(F.when(of, 1).otherwise(0)).alias("walkers" if name == "walk" else f"{name}_passengers") for name, of in groups.items()]
    return rows.groupBy("option_id").agg(*meters, *people)


def merge_stats(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The sums of all eight measures; zeros for no rows when there are no keys."""
    return stats.groupBy(*(keys or [])).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("double" if "meters" in m else "long").alias(m) for m in MEASURES])


def modal_shares(stats: DataFrame) -> DataFrame:
    """``stats`` with the share of each mode: sum of metres times sum of passengers, 0 for no travel at all."""
    pm = {name: F.col(f"{name}_meters") * F.col("walkers" if name == "walk" else f"{name}_passengers") for name in ("car", "rail", "bus", "walk")}
    total = sum(pm.values(), F.lit(0.0))
    return stats.withColumns({f"{name}_share": F.when(total > 0, p / total).otherwise(0.0) for name, p in pm.items()})


def transit_share(stats: DataFrame) -> DataFrame:
    """``stats`` with the transit share: rail and bus together against cars."""
    transit = (F.col("rail_meters") + F.col("bus_meters")) * (F.col("rail_passengers") + F.col("bus_passengers"))
    car = F.col("car_meters") * F.col("car_passengers")
    return stats.withColumn("transit_share", F.when(transit + car > 0, transit / (transit + car)).otherwise(0.0))


def mode_runs(points: DataFrame) -> DataFrame:
    """Runs of one mode in a trace: option_id, run, mode, n_points, first_seq, meters; a change starts at the new point."""
    order = Window.partitionBy("option_id").orderBy("seq")
    rows = points.withColumn("_new", F.when(F.lag("mode").over(order).eqNullSafe(F.col("mode")), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("_new").over(order) - 1)
    inside = Window.partitionBy("option_id", "run").orderBy("seq")
    rows = rows.withColumn("_m", haversine(F.lag("lon").over(inside), F.lag("lat").over(inside), F.col("lon"), F.col("lat")))
    return rows.groupBy("option_id", "run").agg(F.min("mode").alias("mode"), F.count(F.lit(1)).alias("n_points"), F.min("seq").alias("first_seq"), F.coalesce(F.sum("_m"), F.lit(0.0)).alias("meters"))


def lines_by_mode(points: DataFrame) -> DataFrame:
    """option_id, run, mode and the run's line as an array of points in order."""
    order = Window.partitionBy("option_id").orderBy("seq")
    rows = points.withColumn("_new", F.when(F.lag("mode").over(order).eqNullSafe(F.col("mode")), 0).otherwise(1)).withColumn("run", F.sum("_new").over(order) - 1)
    return rows.groupBy("option_id", "run").agg(F.min("mode").alias("mode"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))
