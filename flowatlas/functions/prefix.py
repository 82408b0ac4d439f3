"""Exact running sums over groups of any size, without a task that sees a whole group.

Rows are dealt out in sorted ranges. Inside a range a window adds up; what the ranges before it hold of the same group
is put together from sums over blocks of 1, 2, 4, ... ranges: the blocks named by the binary digits of the range's
number cover just the ranges before it. So every step is an equi-join or a grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.sources.store import shared_checkpoint

#: Numbers are added as decimals, so that a sum doesn't depend on the order: 12 digits behind the point, 14 before it.
EXACT = "decimal(26,12)"
SUM = "decimal(36,12)"


def _before(parts: DataFrame, ranges: int) -> DataFrame:
    """(_g, _range, _offset, _high): sum and last row of a group's parts in the ranges before each of its ranges."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(ranges - 1, 1).bit_length() - 1)))
    spread = parts.withColumn("_level", levels).withColumn("_block", F.expr("shiftright(_range, _level)"))
    blocks = spread.groupBy("_g", "_level", "_block").agg(F.sum("_sum").cast(SUM).alias("_s"), F.max("_high").alias("_h"))
    asked = spread.where("_block % 2 = 1").select("_g", "_range", "_level", (F.col("_block") - 1).alias("_block"))
    found = asked.join(blocks, ["_g", "_level", "_block"])
    return found.groupBy("_g", "_range").agg(F.sum("_s").cast(SUM).alias("_offset"), F.max("_h").alias("_high"))


def running_sums(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with the decimals _before (sum of ``value`` over the group's rows before), _total and _previous.

    ``order`` tells the rows of a group apart; _previous is the value of the row before, null on a group's first. Nulls of a group column are a group. Values count to 12 decimal places.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_v", F.col(value).cast(EXACT)).withColumn("_g", F.struct(F.lit(0).alias("_0"), *group))
    dealt = shared_checkpoint(keyed.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy("_g", "_range").agg(F.sum("_v").cast(SUM).alias("_sum"), F.max(F.struct(*order, "_v")).alias("_high"))
    totals = parts.groupBy("_g").agg(F.sum("_sum").cast(SUM).alias("_total"), F.count(F.lit(1)).alias("_parts"))
    several = parts.join(totals.where("_parts > 1").select("_g"), "_g", "left_semi")  # at most two rows a range
    inside = Window.partitionBy("_g", "_range").orderBy(*order)
    added = dealt.withColumn("_sum", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_lag", F.lag("_v").over(inside))
    joined = added.join(_before(several, ranges), ["_g", "_range"], "left").join(totals.drop("_parts"), "_g")
    before = (F.coalesce("_offset", F.lit(0).cast(SUM)) + F.col("_sum") - F.col("_v")).cast(SUM)
    return joined.select(*rows.columns, before.alias("_before"), "_total", F.coalesce("_lag", "_high._v").alias("_previous"), F.col("_v").alias("_value"))
