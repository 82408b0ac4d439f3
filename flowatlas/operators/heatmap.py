"""Modal shares per hexagon cell, with points shared across cell borders, and colour scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.functions.geo import cell_of
from flowatlas.operators.traces import MEASURES, merge_stats, modal_shares, pair_measures, with_carry


def cell_points(points: DataFrame, cell: Column | None = None) -> DataFrame:
    """Trace points once per cell they count in: their own and those of the points before and after them.

    Leg starts are carried within each (trace, cell). The row count is at most three times that of the points.
    """
    order = Window.partitionBy("option_id").orderBy("seq")
    start = F.max(F.when(F.col("is_leg_start"), F.col("seq"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = points.withColumn("_own", cell_of(F.col("lon"), F.col("lat")) if cell is None else cell)
    rows = rows.withColumn("_near", F.array_compact(F.array("_own", F.lag("_own").over(order), F.lead("_own").over(order)))).withColumn("_last_start", start)
    rows = rows.withColumn("cell", F.explode(F.array_distinct("_near"))).drop("_own", "_near")
    return with_carry(rows, F.lit(True), ["cell"])


def modal_heatmap(points: DataFrame, cell: Column | None = None) -> DataFrame:
    """cell, the eight measures and the four shares; cells where all measures are 0 are left out."""
    per_trace = pair_measures(cell_points(points, cell), ["option_id", "cell"])
    merged = merge_stats(per_trace, ["cell"])
    return modal_shares(merged.where(F.greatest(*[F.col(m).cast("double") for m in MEASURES]) > 0))


def heat_scale(values: DataFrame, column: str) -> DataFrame:
    """``values`` with by_max (x / max) and by_range ((x - min) / (max - min)); 0 where the divisor is 0."""
    ends = values.agg(F.max(column).alias("_max"), F.min(column).alias("_min"))
    x = F.col(column)
    scaled = values.join(F.broadcast(ends))  # one row
    return scaled.withColumn("by_max", F.coalesce(F.try_divide(x, F.col("_max")), F.lit(0.0))).withColumn("by_range", F.coalesce(F.try_divide(x - F.col("_min"), F.col("_max") - F.col("_min")), F.lit(0.0))).drop("_max", "_min")
