"""Synthetic commuters by reproducible weighted draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowatlas.functions import geo
from flowatlas.functions.draws import Salt, uniform
from flowatlas.functions.prefix import EXACT, running_sums
from flowatlas.sources.store import shared_table

#: Least distance in metres for a car or motorcycle; use of a utility vehicle; parking chance where it isn't modelled.
MIN_DISTANCE, UTILITY_USE, PLAIN_PARKING = 3000.0, 0.95, 0.9


def weights_cdf(events: DataFrame, group: list[str], event: str, weight: str, *, reference_thresholds: bool = False) -> DataFrame:
    """``group``, ``event``, cum_lo, cum_hi: intervals (cum_lo, cum_hi] of each event, ordered by share, then event.

    A share is the weight over the group's exact sum as a double, so weights whose shares don't differ are ordered by
    event. The last interval ends at 1. ``reference_thresholds`` gives the thresholds p0, 2 p0, 2 p0 + p1, ... instead. Weights
    count to 12 decimal places and are added exactly, in ranges, whatever the size of a group.
    """
    heavy = events.where(F.col(weight) > 0).select(*group, event, weight)
    whole = F.sum(F.col(weight).cast(EXACT)).cast("double").alias("_whole")
    if group:
        sums = heavy.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(whole)  # a row for a group
        shared = heavy.join(sums, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])
    else:
        shared = heavy.join(F.broadcast(heavy.agg(whole)))  # one row
    shared = shared.select(*heavy.columns, (F.col(weight) / F.col("_whole")).alias("_share"))
    rows = running_sums(shared, group, ["_share", event], weight)
    least, total = F.coalesce(F.col("_least"), F.lit(0)), F.col("_total").cast("double")
    part = lambda x: F.least(x.cast("double") / total, F.lit(1.0))
    last = F.col("_before") + F.col("_value") >= F.col("_total")
    if reference_thresholds:
        smallest = rows.groupBy(*group).agg(F.min("_value").alias("_least"))
        rows = rows.join(smallest, group) if group else rows.join(F.broadcast(smallest))  # one row without groups
        up, down = least + F.col("_before"), F.when(F.col("_previous").isNull(), 0).otherwise(least + F.col("_before") - F.col("_previous"))
    else:
        up, down = F.col("_before") + F.col("_value"), F.col("_before")
    found = rows.select(*group, event, part(down).alias("cum_lo"), F.when(last, 1.0).otherwise(part(up)).alias("cum_hi")).where("cum_hi > cum_lo")
    return shared_table(found)  # it is used more than once, and draws needn't plan it anew


def weighted_choice(rows: DataFrame, cdf: DataFrame, group: list[str], u: Column, *, keep: bool = False) -> DataFrame:
    """``rows`` with the event whose interval holds ``u``: intervals are spread over slots, so it is an equi-join.

    A group has at least as many slots as events, so a draw meets some two intervals on average, however many there are.
    Rows whose group has no events drop out, or with ``keep`` have a null event.
    """
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.count(F.lit(1))))).cast("long").alias("_slots")
    if group:
        sizes = cdf.groupBy(*group).agg(size)  # a row for a group
        cdf, rows = cdf.join(sizes, group), rows.join(sizes, group, "left" if keep else "inner")
    else:
        slots = cdf.agg(F.greatest(size, F.lit(1))).first()[0]
        cdf, rows = cdf.withColumn("_slots", F.lit(slots)), rows.withColumn("_slots", F.lit(slots))
    at = lambda c: F.floor(c * F.col("_slots"))
    slots = cdf.withColumn("_slot", F.explode(F.sequence(at(F.col("cum_lo")), F.least(at(F.col("cum_hi")), F.col("_slots") - 1)))).drop("_slots")
    drawn = rows.withColumn("_u", u).withColumn("_slot", at(F.col("_u"))).drop("_slots")
    hit = ((F.col("_u") > F.col("cum_lo")) | ((F.col("_u") == 0) & (F.col("cum_lo") == 0))) & (F.col("_u") <= F.col("cum_hi"))
    if not keep:
        return drawn.join(slots, [*group, "_slot"]).where(hit).drop("_u", "_slot", "cum_lo", "cum_hi")
    named = slots.withColumnsRenamed({c: f"_of_{c}" for c in [*group, "_slot"]})
    same = hit
    for c in [*group, "_slot"]:
        same = same & (F.col(c) == F.col(f"_of_{c}"))
    return drawn.join(named, same, "left").drop("_u", "_slot", "cum_lo", "cum_hi", *[f"_of_{c}" for c in [*group, "_slot"]])


def point_in_cell(cell: Column, key: Column, salts: tuple[int, int, int], seed: int) -> tuple[Column, Column]:
    """Projected x and y of a uniform point in the hexagon: one of six equal triangles, then two draws folded into it."""
    side = F.floor(uniform(key, salts[0], seed) * 6)
    u, v = uniform(key, salts[1], seed), uniform(key, salts[2], seed)
    folded = u + v > 1
    a, b = F.when(folded, 1 - u).otherwise(u), F.when(folded, 1 - v).otherwise(v)
    turn = lambda k: F.lit(math.pi / 6) + k * F.lit(math.pi / 3)
    x = geo.centre_x(cell) + geo.SIDE * (a * F.cos(turn(side)) + b * F.cos(turn(side + 1)))
    y = geo.centre_y(cell) + geo.SIDE * (a * F.sin(turn(side)) + b * F.sin(turn(side + 1)))
    return x, y


def homes(commuters: DataFrame, tiles: DataFrame, seed: int = 0) -> DataFrame:
    """``commuters`` (vc_id) with origin_cell by population, its region, and a point in it."""
    cdf = weights_cdf(tiles.select("cell", "population"), [], "cell", "population")
    drawn = weighted_choice(commuters, cdf, [], uniform(F.col("vc_id"), Salt.HOME, seed)).withColumnRenamed("cell", "origin_cell")
    x, y = point_in_cell(F.col("origin_cell"), F.col("vc_id"), (Salt.HOME_SIDE, Salt.HOME_U, Salt.HOME_V), seed)
    placed = drawn.withColumn("origin_lon", geo.unproject_lon(x)).withColumn("origin_lat", geo.unproject_lat(y))
    return placed.join(tiles.select(F.col("cell").alias("origin_cell"), "region"), "origin_cell")


def attributes(commuters: DataFrame, shares: DataFrame, rates: DataFrame, types: DataFrame, seed: int = 0) -> DataFrame:
    """``commuters`` (vc_id, region) with age, employed and employment_type by the region's shares.

    ``shares`` (region, age, weight), ``rates`` (region, age, rate in percent), ``types`` (region, employment_type, weight).
    Under 20 nobody is employed; employment_type is null for those who aren't. Nobody drops out: age and employment_type
    are null where the region has no shares of them.
    """
    aged = weighted_choice(commuters, weights_cdf(shares, ["region"], "age", "weight"), ["region"], uniform(F.col("vc_id"), Salt.AGE, seed), keep=True)
    employed = (F.col("age") != "under_20") & (uniform(F.col("vc_id"), Salt.EMPLOYED, seed) * 100 <= F.coalesce("rate", F.lit(0.0)))
    working = aged.join(rates, ["region", "age"], "left").withColumn("employed", F.coalesce(employed, F.lit(False))).drop("rate")
    typed = weighted_choice(working, weights_cdf(types, ["region"], "employment_type", "weight"), ["region"], uniform(F.col("vc_id"), Salt.EMPLOYMENT, seed), keep=True)
    return typed.withColumn("employment_type", F.when(F.col("employed"), F.col("employment_type")))


def destinations(commuters: DataFrame, tiles: DataFrame, interests: list[str], seed: int = 0) -> DataFrame:
    """``commuters`` (vc_id, age, employment_type) with destination_cell and its point: education under 20, work by type.

    All others have none. ``tiles`` has the area of each interest (education, work_<type>).
    """
    long = tiles.unpivot("cell", interests, "interest", "area")
    interest = F.when(F.col("age") == "under_20", "education").when(F.col("employment_type").isNotNull(), F.concat(F.lit("work_"), F.col("employment_type")))
    rows = commuters.withColumn("interest", interest)
    drawn = weighted_choice(rows.where("interest is not null").select("vc_id", "interest"), weights_cdf(long, ["interest"], "cell", "area"), ["interest"], uniform(F.col("vc_id"), Salt.WORK, seed))
    x, y = point_in_cell(F.col("cell"), F.col("vc_id"), (Salt.WORK_SIDE, Salt.WORK_U, Salt.WORK_V), seed)
    placed = drawn.select("vc_id", F.col("cell").alias("destination_cell"), geo.unproject_lon(x).alias("destination_lon"), geo.unproject_lat(y).alias("destination_lat"))
    return rows.drop("interest").join(placed, "vc_id", "left")


def vehicle_count(p: Column, key: Column, salt: int, seed: int = 0) -> Column:
    """Vehicles owned by a probability or mean p: above 2 an even draw from 2 to ceil(p), above 1 one or two, else one or none."""
    u = uniform(key, salt, seed)
    many = (2 + F.floor(u * (F.ceil(p) - 1))).cast("int")
    return F.when(p > 2, many).when(p > 1, F.when(u < p - 1, 2).otherwise(1)).otherwise(F.when(u < p, 1))


def vehicles(commuters: DataFrame, means: DataFrame, weights: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``commuters`` (vc_id, age, region, origin_cell) with car, moto, utilities; none under 20.

    ``means`` (region, vehicle_car, vehicle_moto, vehicle_utilities); ``weights`` (cell, car_weight, moto_weight) of home
    parking, if it counts.
    """
    rows = commuters.join(means, "region", "left")
    if weights is not None:
        rows = rows.join(weights.withColumnRenamed("cell", "origin_cell"), "origin_cell", "left")
    adult = F.col("age") != "under_20"
    for name, salt in (("car", Salt.CAR), ("moto", Salt.MOTO), ("utilities", Salt.UTILITIES)):
        p = F.col(f"vehicle_{name}")
        if weights is not None and name != "utilities":
            p = p * F.coalesce(F.col(f"{name}_weight"), F.lit(1.0))
        rows = rows.withColumn(name, F.when(adult, vehicle_count(p, F.col("vc_id"), salt, seed)))
    return rows.drop("vehicle_car", "vehicle_moto", "vehicle_utilities", "car_weight", "moto_weight")


def vehicle_usage(commuters: DataFrame, parking: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``commuters`` (vc_id, car, moto, utilities, distance, destination_cell) with usage; the later rule wins.

    Car, then motorcycle: owned, far enough, and a draw below the parking chance at the destination. A utility vehicle
    is used with its own chance, whatever else.
    """
    rows = commuters
    if parking is not None:
        rows = rows.join(parking.select(F.col("cell").alias("destination_cell"), "parking_destination_car", "parking_destination_moto"), "destination_cell", "left")
    chance = {v: F.coalesce(F.col(f"parking_destination_{v}"), F.lit(0.0)) if parking is not None else F.lit(PLAIN_PARKING) for v in ("car", "moto")}
    drives = {v: (F.coalesce(F.col(v), F.lit(0)) > 0) & (F.col("distance") > MIN_DISTANCE) & (uniform(F.col("vc_id"), salt, seed) < chance[v]) for v, salt in (("car", Salt.USE_CAR), ("moto", Salt.USE_MOTO))}
    utility = (F.coalesce(F.col("utilities"), F.lit(0)) > 0) & (uniform(F.col("vc_id"), Salt.USE_UTILITIES, seed) < UTILITY_USE)
    return rows.withColumn("usage", F.when(utility, "utilities").when(drives["moto"], "moto").when(drives["car"], "car")).drop("parking_destination_car", "parking_destination_moto")


def generate(spark: SparkSession, n: int, *, sim_id: str, tiles: DataFrame, shares: DataFrame, rates: DataFrame, types: DataFrame, means: DataFrame, interests: list[str], weights: DataFrame | None = None, parking: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """n commuters of a simulation with all attributes; the same for any number of partitions."""
    rows = spark.range(n).withColumnRenamed("id", "vc_id").withColumn("sim_id", F.lit(sim_id))
    rows = shared_table(attributes(homes(rows, tiles, seed), shares, rates, types, seed))
    rows = destinations(rows, tiles, interests, seed)
    rows = vehicles(rows, means, weights, seed).withColumn("distance", geo.planar_distance(F.col("origin_lon"), F.col("origin_lat"), F.col("destination_lon"), F.col("destination_lat")))
    return vehicle_usage(rows, parking, seed)
