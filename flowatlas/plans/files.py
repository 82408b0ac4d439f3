"""Queries that write derived tables as files and read them back by the library's readers, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowatlas.operators import heatmap, traces
from flowatlas.plans import mobility
from flowatlas.plans.fixtures import Tables
from flowatlas.sources import journeys, store, tables

QUERIES, SQL = {}, {}
#: Simulations that the commuters are dealt to; the year and the box that are read; what a statistics document tells.
SIMULATIONS, YEAR, BOX, META = ("s0", "s1", "s2"), 2021, (5.42, 51.42, 5.50, 51.48), {"city": "Eindhoven"}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        SQL[f.__name__] = sql
        return f

    return add


def _folder(t: Tables) -> str:
    """A new folder where driver and executors share files; it goes when the checkpoints are cleared."""
    return f"{store.shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("SELECT 's' || CAST(vc_id % 3 AS VARCHAR) AS sim_id, option_id, vc_id FROM fx_options")
def route_results(t: Tables) -> DataFrame:
    """The results of every simulation, each read from its own partition."""
    path = _folder(t)
    store.write_simulation(t.options.select("option_id", "vc_id", F.concat(F.lit("s"), F.col("vc_id") % 3).alias("sim_id")), path)
    return journeys.union_options([journeys.read_results(t.spark, path, sim) for sim in SIMULATIONS])


@query(f"SELECT geo, age, CAST(year AS INTEGER) AS year, value FROM fx_age WHERE year = {YEAR}")
def statistics_rows(t: Tables) -> DataFrame:
    """One year of a statistics CSV."""
    path = _folder(t)
    t.age.select("geo", "age", F.col("year").alias("TIME_PERIOD"), F.col("value").alias("OBS_VALUE")).write.option("header", True).csv(path)
    return tables.read_statistics(t.spark, path, ["geo", "age", "TIME_PERIOD", "OBS_VALUE"], year=YEAR)


@query("SELECT * FROM fx_transfers")
def feed_table(t: Tables) -> DataFrame:
    """A timetable table as text; an empty field is null."""
    folder = _folder(t)
    t.transfers.write.option("header", True).csv(f"{folder}/transfers.txt")
    return tables.read_feed(t.spark, folder, "transfers")


@query(f"SELECT round(olon, 6) AS lon, round(olat, 6) AS lat, count(*) AS population FROM fx_commuters WHERE olon BETWEEN {BOX[0]}e0 AND {BOX[2]}e0 AND olat BETWEEN {BOX[1]}e0 AND {BOX[3]}e0 GROUP BY olon, olat")
def population_grid(t: Tables) -> DataFrame:
    """The people at each point of a box."""
    path = _folder(t)
    t.commuters.groupBy(F.col("olon").alias("lon"), F.col("olat").alias("lat")).agg(F.count(F.lit(1)).alias("population")).write.parquet(path)
    return mobility.rounded(tables.read_population(t.spark, path, BOX))


@query(f"SELECT m.*, 's1' AS sim_id, '{META['city']}' AS city FROM ({mobility.SQL['modal_shares']}) m")
def stats_document(t: Tables) -> DataFrame:
    """Modal shares as a JSON document with its simulation and meta."""
    path, stats = _folder(t), mobility.modal_shares(t)
    store.write_stats(stats, path, sim_id="s1", meta=META)
    written = t.spark.read.schema(", ".join(f"{c} {kind}" for c, kind in [*stats.dtypes, ("sim_id", "string"), ("meta", "map<string,string>")])).json(path)
    return written.withColumn("city", F.col("meta")["city"]).drop("meta")


@query(f"SELECT cell, car_share, rail_share, bus_share, walk_share FROM ({mobility.SQL['modal_heatmap']}) m")
def heatmap_document(t: Tables) -> DataFrame:
    """The heatmap as rows of a cell and its shares."""
    path = _folder(t)
    store.write_heatmap(heatmap.modal_heatmap(traces.trace_points(t.nested_legs())), path)
    return mobility.rounded(t.spark.read.parquet(path))


LINE = "string_agg(CAST(CAST(round(lon * 1000) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(lat * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY seq) AS line"


@query("SELECT option_id, CAST(run AS BIGINT) AS run, mode, line FROM (" + mobility.RUNS.format(k="option_id", o="seq", t="fx_trace", first=LINE) + ") r")
def mode_lines(t: Tables) -> DataFrame:
    """Each run's line, as thousandths of degrees."""
    lines = traces.lines_by_mode(traces.trace_points(t.nested_legs()))
    at = lambda c: F.round(c * 1000).cast("long").cast("string")
    return lines.select("option_id", F.col("run").cast("long").alias("run"), "mode", F.array_join(F.transform("line", lambda p: F.concat_ws(" ", at(p["lon"]), at(p["lat"]))), ",").alias("line"))
