"""Whole-simulation results: shares end to end, clipped shares, convergence curves, walking histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.operators.traces import MEASURES, merge_stats, modal_shares, trace_points, trace_stats, transit_share, with_carry


def selected_stats(selection: DataFrame, legs: DataFrame, *, inside: Column | None = None) -> DataFrame:
    """The eight measures per chosen option, of the part of its trace where ``inside`` (over lon and lat) if given."""
    points = trace_points(legs.join(selection.select("option_id"), "option_id", "left_semi"))
    return trace_stats(points if inside is None else with_carry(points, inside))


def simulation_stats(selection: DataFrame, legs: DataFrame, *, inside: Column | None = None, max_count: int | None = None) -> DataFrame:
    """One row: measures, modal shares and transit share of all chosen options, or of the first ``max_count`` commuters'."""
    if max_count is not None:
        selection = first_commuters(selection, max_count)
    return transit_share(modal_shares(merge_stats(selected_stats(selection, legs, inside=inside))))


def first_commuters(commuters: DataFrame, n: int) -> DataFrame:
    """The first n commuters by id."""
    return commuters.orderBy("vc_id").limit(n)


def numbered(rows: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """``rows`` with index from 1 in the order of an integer key: totals per key range, then a window inside a range."""
    rows = rows.withColumn("_chunk", F.floor(F.col(key) / width))
    starts = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_chunk").orderBy(key)
    return rows.join(starts, "_chunk").withColumn("index", F.col("_start") + F.row_number().over(inside)).drop("_chunk", "_start")


def convergence(stats: DataFrame, total: int, steps: int = 100) -> DataFrame:
    """step, n_commuters and the shares over the first n rows of ``stats`` (index, the eight measures; null for none).

    n is 1, 1 + s, 1 + 2s, ...; s is total div steps. With fewer rows than steps every prefix is the first row.
    """
    s = total // steps
    step = F.greatest(F.ceil((F.col("index") - 1) / s), F.lit(0)) if s else F.when(F.col("index") == 1, 0).otherwise(steps)
    sums = stats.withColumn("step", step.cast("long")).where(F.col("step") < steps).groupBy("step").agg(*[F.sum(m).alias(m) for m in MEASURES])
    every = stats.sparkSession.range(steps).withColumnRenamed("id", "step").join(sums, "step", "left")
    upto = Window.orderBy("step")  # one row per step
    summed = every.select("step", (1 + F.col("step") * s).alias("n_commuters"), *[F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(m) for m in MEASURES])
    return transit_share(modal_shares(summed))


def histogram(values: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """bin, low, high, n: equal bins from the least to the largest value, the last one closed."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")).withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    rows = values.join(F.broadcast(ends))  # one row
    at = F.when(F.col("_w") == 0, 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / F.nullif("_w", F.lit(0.0))), F.lit(bins - 1)))
    counted = rows.groupBy(at.cast("long").alias("bin"), "_lo", "_w").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n")
