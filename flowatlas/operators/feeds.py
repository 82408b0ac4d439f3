"""Timetable feeds: repair of references, missing fields, choice of a dated link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repair_transfers(transfers: DataFrame, stops: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Transfers whose stops exist and whose trips and routes exist or are null; columns may be absent."""
    out = transfers
    for column in ("from_stop_id", "to_stop_id"):
        out = out.join(stops.select(F.col("stop_id").alias(column)).distinct(), column, "left_semi")
    for column, table, key in (("from_trip_id", trips, "trip_id"), ("to_trip_id", trips, "trip_id"), ("from_route_id", routes, "route_id"), ("to_route_id", routes, "route_id")):
        if column in out.columns:
            known = table.select(F.col(key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
            out = out.join(known, F.col(column) == F.col("_key"), "left").where(F.col(column).isNull() | F.col("_hit")).drop("_key", "_hit")
    return out.select(transfers.columns)


def fill_agency_url(agency: DataFrame) -> DataFrame:
    """Agencies with ``-`` for a missing url; the column is added when absent."""
    if "agency_url" not in agency.columns:
        return agency.withColumn("agency_url", F.lit("-"))
    return agency.withColumn("agency_url", F.coalesce("agency_url", F.lit("-")))


def _with_targets(links: DataFrame, targets: list[str]) -> DataFrame:
    """``links`` once per target date; the targets are a short literal list, so nothing is joined."""
    return links.withColumn("target", F.explode(F.array(*[F.lit(t).cast("date") for t in targets])))


def nearest_links(links: DataFrame, targets: list[str]) -> DataFrame:
    """(place, target, link): the link nearest to each target date on either side, the first (``ord``) of equals.

    ``links`` has place, date, ord, link; ``targets`` are dates as text.
    """
    nearest = F.min_by("link", F.struct(F.abs(F.datediff("date", "target")), F.col("ord")))
    return _with_targets(links, targets).groupBy("place", "target").agg(nearest.alias("link"))


def latest_links(links: DataFrame, targets: list[str]) -> DataFrame:
    """(provider, target, link): the latest link not after the target; providers without one drop out; the first of equals."""
    past = _with_targets(links, targets).where(F.col("date").cast("date") <= F.col("target"))
    return past.groupBy("provider", "target").agg(F.min_by("link", F.struct(F.datediff("target", "date"), F.col("ord"))).alias("link"))
