"""Delay statistics per operator, random delays of transit legs, and their way along a journey."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.functions.draws import Salt, uniform
from flowatlas.functions.predicates import percent
from flowatlas.sources.store import shared_checkpoint

TRANSIT = ("train", "bus", "watercraft", "aircraft", "gondola")
#: Width in minutes of the last bin; rows up to which the operators' rates and bins are broadcast.
LAST_BIN, ROWS = 5, 100_000


def delay_bins(rows: DataFrame) -> DataFrame:
    """(operator, bin, start, end, weight, cum_lo, cum_hi) from labelled percentages (operator, label, percent).

    Bins are sorted by their start; weights are shares of the operator's bins. Missing percentages count 0.
    """
    bins = rows.where(~F.col("label").isin("cancelled", "substituted")).select(F.lower("operator").alias("operator"), F.regexp_extract("label", "^([0-9]+)", 1).try_cast("int").alias("start"), percent(F.col("percent")).alias("_w"))
    order = Window.partitionBy("operator").orderBy("start")
    whole = F.sum("_w").over(Window.partitionBy("operator"))
    shares = bins.withColumn("weight", F.try_divide(F.col("_w"), whole)).withColumn("bin", (F.row_number().over(order) - 1).cast("int")).withColumn("end", F.coalesce(F.lead("start").over(order), F.col("start") + LAST_BIN))
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = shares.withColumn("_up", upto).withColumn("cum_lo", F.coalesce(F.lag("_up").over(order), F.lit(0.0))).withColumn("cum_hi", F.when(F.lead("start").over(order).isNull(), 1.0).otherwise(F.col("_up")))
    return cut.select("operator", "bin", "start", "end", "weight", "cum_lo", "cum_hi")


def operator_rates(rows: DataFrame) -> DataFrame:
    """(operator, cancelled_percent, substituted_percent)."""
    of = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, percent(F.col("percent")))), F.lit(0.0))
    return rows.groupBy(F.lower("operator").alias("operator")).agg(of("cancelled").alias("cancelled_percent"), of("substituted").alias("substituted_percent"))


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` of operators, worked out once, and broadcast unless there are too many."""
    kept = shared_checkpoint(rows)
    return F.broadcast(kept) if kept.count() <= ROWS else kept


def draw_delays(legs: DataFrame, bins: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """``legs`` (leg_key, operator) with cancelled and delay in minutes; unknown operators are ``average``.

    A bin is drawn by weight, then a whole minute evenly in it. Cancelled legs have no delay.
    """
    known = _small(rates.select(F.col("operator").alias("_known"), "cancelled_percent"))
    named = legs.withColumn("_op", F.lower("operator")).join(known, F.col("_op") == F.col("_known"), "left")
    named = named.withColumn("_op", F.when(F.col("_known").isNull(), "average").otherwise(F.col("_op"))).drop("_known", "cancelled_percent")
    rated = named.join(known.withColumnRenamed("_known", "_op"), "_op")
    # the draw is a column of its own, not to be taken anew for each bin; its bin is the first whose end isn't below it
    rated = rated.withColumn("_u", uniform(F.col("leg_key"), Salt.DELAY_BIN, seed))
    before = Window.partitionBy("operator").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = bins.select(F.col("operator").alias("_op"), "start", "end", "cum_hi", F.coalesce(F.max("cum_hi").over(before), F.lit(-1.0)).alias("_lo"))
    drawn = rated.join(_small(ends), "_op").where((F.col("_u") > F.col("_lo")) & (F.col("_u") <= F.col("cum_hi")))
    cancelled = uniform(F.col("leg_key"), Salt.DELAY, seed) * 100 < F.col("cancelled_percent")
    v = uniform(F.col("leg_key"), Salt.DELAY_MINUTE, seed)
    minute = (F.col("start") + F.floor(v * (F.col("end") - F.col("start")))).cast("int")
    return drawn.withColumn("cancelled", cancelled).withColumn("delay", F.when(~cancelled, minute)).select(*legs.columns, "cancelled", "delay")


def propagate(legs: DataFrame, *, delayed_arrival: bool = False) -> DataFrame:
    """``legs`` (option_id, leg_seq, mode, departure, arrival, cancelled, delay) with current_delay and reached.

    A transit leg's delay also holds for the walking and driving after it. A connection is missed when the delayed
    departure is before the previous leg's arrival (as planned, or as delayed), or cancelled; from the first failure on
    no leg is reached.
    """
    order = Window.partitionBy("option_id").orderBy("leg_seq")
    transit = F.col("mode").isin(*TRANSIT)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = legs.withColumn("current_delay", F.coalesce(F.last(F.when(transit & ~F.col("cancelled"), F.col("delay")), ignorenulls=True).over(upto), F.lit(0)))
    before = F.lag("arrival").over(order)
    if delayed_arrival:
        before = F.timestamp_add("SECOND", (F.lag("current_delay").over(order) * 60).cast("int"), before)
    real = F.timestamp_add("SECOND", (F.col("delay") * 60).cast("int"), F.col("departure"))
    rows = rows.withColumn("_failed", transit & (F.col("cancelled") | F.coalesce(real < before, F.lit(False))))
    return rows.withColumn("reached", ~F.max("_failed").over(upto)).drop("_failed")
