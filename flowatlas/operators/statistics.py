"""Cleaning of official statistics: regions, categories, shares, imputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Age codes of the three groups, sectors of the employment types, and vehicle codes.
AGE_GROUPS = {
    "under_20": ("Y_LT5", "Y5-9", "Y10-14", "Y15-19"),
    "between_20_64": ("Y20-24", "Y25-29", "Y30-34", "Y35-39", "Y40-44", "Y45-49", "Y50-54", "Y55-59", "Y60-64"),
    "over_64": ("Y65-69", "Y70-74", "Y75-79", "Y80-84", "Y85-89", "Y_GE90"),
}
SECTORS = ("A", "B-E", "F", "G-I", "J", "K", "L", "M_N", "O-Q", "R-U")
EMPLOYMENT_TYPES = {"agricultural": ("A",), "industrial": ("B-E", "F"), "commercial": ("G-I", "L", "R-U"), "office": ("J", "K", "M_N"), "social": ("O-Q",)}
VEHICLES = ("CAR", "MOTO", "SPE", "BUS_TOT", "LOR", "TRC", "UTL")


def nuts2_of(nuts3: Column) -> Column:
    return F.substring(nuts3, F.lit(1), F.greatest(F.length(nuts3) - 1, F.lit(0)))


def filter_year(rows: DataFrame, year: int) -> DataFrame:
    return rows.where(F.col("year") == year)


def finest_regions(rows: DataFrame, geo: str = "geo") -> DataFrame:
    """Rows of the finest region level up to five characters, with ``precision`` (code length less 2)."""
    short = rows.where(F.length(geo) <= 5)
    finest = short.agg(F.max(F.length(geo)).alias("_length"))
    return short.join(F.broadcast(finest), F.length(geo) == F.col("_length")).withColumn("precision", F.col("_length") - 2).drop("_length")


def unavailable_regions(rows: DataFrame, wanted: DataFrame, year: int, geo: str = "geo") -> DataFrame:
    """Wanted regions (geo) that the data lacks for the year; empty means that all is there."""
    return wanted.join(filter_year(rows, year).select(F.col(geo)).distinct(), geo, "left_anti")


def row_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as shares of their sum in each row; 0 where the sum is 0."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return rows.withColumn("_total", total).withColumns({c: F.coalesce(F.try_divide(F.col(c), F.col("_total")), F.lit(0.0)) for c in columns}).drop("_total")


def column_share(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the column's share of the whole column."""
    total = rows.agg(F.sum(column).alias("_total"))
    return rows.join(F.broadcast(total)).withColumn(name, F.try_divide(F.col(column), F.col("_total"))).drop("_total")  # one row


def age_groups(rows: DataFrame) -> DataFrame:
    """geo and the three groups' totals, of regions that have rows of all three."""
    of = {g: F.col("age").isin(*codes) for g, codes in AGE_GROUPS.items()}
    sums = rows.groupBy("geo").agg(*[F.sum(F.when(c, F.col("value"))).alias(f"age_{g}") for g, c in of.items()])
    return sums.dropna("any", subset=[f"age_{g}" for g in of])


def employment_rate(rows: DataFrame) -> DataFrame:
    """nuts2 and the rates of the two working age groups (columns age in between_20_64, over_64), both present."""
    sums = rows.groupBy("geo").agg(*[F.sum(F.when(F.col("age") == g, F.col("value"))).alias(f"employment_rate_{g}") for g in ("between_20_64", "over_64")])
    return sums.dropna("any")


def employment_types(rows: DataFrame, *, missing: str = "drop") -> DataFrame:
    """geo and the shares of five employment types, from ten sectors' counts (columns geo, sector, value).

    Regions with a missing sector are dropped, or with ``missing="mean"`` the sector gets its mean share among complete
    regions times the region's total over the sectors that are there.
    """
    names = [f"s{i}" for i in range(len(SECTORS))]
    wide = rows.groupBy("geo").agg(*[F.sum(F.when(F.col("sector") == s, F.col("value"))).alias(n) for s, n in zip(SECTORS, names)])
    complete = row_shares(wide.dropna("any"), names)
    if missing == "drop":
        filled = complete
    else:
        means = complete.agg(*[F.avg(n).alias(f"_{n}") for n in names])  # one row
        there = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
        filled = row_shares(wide.withColumn("_there", there).join(F.broadcast(means)).select("geo", *[F.coalesce(F.col(n).cast("double"), F.col(f"_{n}") * F.col("_there")).alias(n) for n in names]), names)
    place = dict(zip(SECTORS, names))
    return filled.select("geo", *[sum((F.col(place[s]) for s in group), F.lit(0.0)).alias(f"employment_type_{t}") for t, group in EMPLOYMENT_TYPES.items()])


def motorization(rows: DataFrame, ages: DataFrame, *, missing: str = "keep") -> DataFrame:
    """nuts2 and vehicles per resident over 20 (columns geo, vehicle, value; ages by NUTS-3 from age_groups).

    Several rows of a vehicle and region count once, by the largest. Lorries and tractors make trucks, null if either is.
    """
    wide = rows.groupBy("geo").agg(*[F.max(F.when(F.col("vehicle") == v, F.col("value"))).alias(v) for v in VEHICLES])
    over = ages.groupBy(nuts2_of(F.col("geo")).alias("geo")).agg(F.sum(F.col("age_between_20_64") + F.col("age_over_64")).alias("_adults"))
    if missing == "mean":
        means = wide.agg(*[F.avg(v).alias(f"_{v}") for v in VEHICLES])
        wide = wide.join(F.broadcast(means)).select("geo", *[F.coalesce(F.col(v).cast("double"), F.col(f"_{v}")).alias(v) for v in VEHICLES])
    per = lambda x: F.try_divide(x, F.col("_adults"))
    return wide.join(over, "geo").select("geo", per(F.col("CAR")).alias("vehicle_car"), per(F.col("MOTO")).alias("vehicle_moto"), per(F.col("SPE")).alias("vehicle_special"), per(F.col("BUS_TOT")).alias("vehicle_bus"), per(F.col("LOR") + F.col("TRC")).alias("vehicle_truck"), per(F.col("UTL")).alias("vehicle_utilities"))


def mean_by_region(rows: DataFrame) -> DataFrame:
    return rows.groupBy("geo").agg(F.avg("value").alias("value"))


def rows_per_year(rows: DataFrame) -> DataFrame:
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("geo").alias("n_regions"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def region_profile(regions: DataFrame, nuts3: list[DataFrame], nuts2: list[DataFrame]) -> DataFrame:
    """``regions`` (nuts3) with statistics of its own level and of its NUTS-2 parent, fanned out to all children."""
    out = regions
    for stats in nuts3:
        out = out.join(stats.withColumnRenamed("geo", "nuts3"), "nuts3", "left")
    out = out.withColumn("_nuts2", nuts2_of(F.col("nuts3")))
    for stats in nuts2:
        out = out.join(stats.withColumnRenamed("geo", "_nuts2"), "_nuts2", "left")
    return out.drop("_nuts2")


#: Cleaner per dataset name.
CLEANERS: dict[str, Callable[..., DataFrame]] = {"age": age_groups, "employment_rate": employment_rate, "employment_type": employment_types, "motorization": motorization, "income": mean_by_region}


def clean(name: str, rows: DataFrame, **tables) -> DataFrame:
    """The dataset's cleaner applied to its rows."""
    return CLEANERS[name](rows, **tables)
