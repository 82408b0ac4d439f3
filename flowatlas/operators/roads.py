"""Roads cut at tile borders, their lengths, and random points on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.functions import geo
from flowatlas.functions.draws import Salt, uniform
from flowatlas.operators.sampling import weighted_choice, weights_cdf


def road_pieces(vertices: DataFrame) -> DataFrame:
    """``vertices`` (road_id, idx, lon, lat, cell) with piece: runs of consecutive vertices of a road in one tile."""
    order = Window.partitionBy("road_id", "cell").orderBy("idx")
    return vertices.withColumn("piece", F.col("idx") - F.row_number().over(order))


def piece_lengths(pieces: DataFrame) -> DataFrame:
    """(road_id, cell, piece, n_points, length, share): projected metres rounded to 2 (1 for a point), share within the tile."""
    order = Window.partitionBy("road_id", "cell", "piece").orderBy("idx")
    x, y = geo.project_x(F.col("lon")), geo.project_y(F.col("lat"))
    steps = pieces.withColumn("_x", x).withColumn("_y", y)
    steps = steps.withColumn("_d", F.hypot(F.col("_x") - F.lag("_x").over(order), F.col("_y") - F.lag("_y").over(order)))
    sums = steps.groupBy("road_id", "cell", "piece").agg(F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("_l"))
    sums = sums.withColumn("length", F.when(F.col("n_points") == 1, 1.0).otherwise(F.round("_l", 2))).drop("_l")
    return sums.withColumn("share", F.try_divide(F.col("length"), F.sum("length").over(Window.partitionBy("cell"))))


def points_along(pieces: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """``rows`` (with road_id, cell, piece) with the projected x and y at the fraction ``at`` of the piece's length."""
    keys = ["road_id", "cell", "piece"]
    order = Window.partitionBy(*keys).orderBy("idx")
    steps = pieces.select(*keys, "idx", geo.project_x(F.col("lon")).alias("_x"), geo.project_y(F.col("lat")).alias("_y"))
    steps = steps.withColumn("_x2", F.lead("_x").over(order)).withColumn("_y2", F.lead("_y").over(order))
    steps = steps.withColumn("_l", F.coalesce(F.hypot(F.col("_x2") - F.col("_x"), F.col("_y2") - F.col("_y")), F.lit(0.0)))
    steps = steps.withColumn("_to", F.sum("_l").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_whole", F.sum("_l").over(Window.partitionBy(*keys))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # every vertex begins a segment but the last one, which stands alone only in a one-point piece
    segments = steps.where(F.col("_x2").isNotNull() | (F.col("_n") == 1)).withColumn("_from", F.col("_to") - F.col("_l"))
    named = rows.withColumn("_key", F.monotonically_increasing_id() if "vc_id" not in rows.columns else F.col("vc_id")).withColumn("_at", at)
    joined = named.join(segments, keys).where((F.col("_at") * F.col("_whole") >= F.col("_from")) & ((F.col("_at") * F.col("_whole") <= F.col("_to")) | (F.col("_n") == 1)))
    part = F.coalesce(F.try_divide(F.col("_at") * F.col("_whole") - F.col("_from"), F.col("_l")), F.lit(0.0))
    placed = joined.withColumn("x", F.col("_x") + part * F.coalesce(F.col("_x2") - F.col("_x"), F.lit(0.0))).withColumn("y", F.col("_y") + part * F.coalesce(F.col("_y2") - F.col("_y"), F.lit(0.0)))
    first = placed.withColumn("_first", F.row_number().over(Window.partitionBy("_key").orderBy("idx"))).where("_first = 1")
    return first.select(*rows.columns, "x", "y")


def points_on_roads(rows: DataFrame, pieces: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (vc_id, cell) with a random point on a road piece of the cell, pieces drawn by length."""
    lengths = piece_lengths(pieces).withColumn("name", F.concat_ws("/", "road_id", "piece"))
    cdf = weights_cdf(lengths, ["cell"], "name", "length")
    drawn = weighted_choice(rows, cdf, ["cell"], uniform(F.col("vc_id"), Salt.ROAD, seed))
    named = drawn.join(lengths.select("cell", "name", "road_id", "piece"), ["cell", "name"]).drop("name")
    return points_along(pieces, named, uniform(F.col("vc_id"), Salt.ROAD_AT, seed))
