"""Statistics CSV, timetable text tables and the population grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SDMX = "STRUCTURE string, STRUCTURE_ID string, freq string, unit string, sex string, age string, nace_r2 string, wstatus string, vehicle string, geo string, TIME_PERIOD int, OBS_VALUE double, OBS_FLAG string"


def read_statistics(spark: SparkSession, path: str, columns: list[str], *, year: int | None = None, regions: list[str] | None = None, **categories: list[str]) -> DataFrame:
    """Rows of an SDMX CSV with the listed columns in file order; year, regions and category values filter them."""
    kinds = {c.strip().split()[0]: c.strip() for c in SDMX.split(",")}
    rows = spark.read.schema(", ".join(kinds[c] for c in columns)).option("header", True).csv(path)
    if year is not None:
        rows = rows.where(F.col("TIME_PERIOD") == year)
    if regions is not None:
        rows = rows.where(F.col("geo").isin(regions))
    for column, values in categories.items():
        rows = rows.where(F.col(column).isin(values))
    return rows.withColumnsRenamed({"TIME_PERIOD": "year", "OBS_VALUE": "value"})


def read_feed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A timetable table, all columns as strings."""
    return spark.read.option("header", True).option("inferSchema", False).csv(f"{folder}/{table}.txt")


def read_population(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Grid rows (lon, lat, population, ...) inside the bounding box lon0, lat0, lon1, lat1; the filter is pushed down."""
    return spark.read.parquet(path).where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
