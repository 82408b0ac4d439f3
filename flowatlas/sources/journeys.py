"""Journey documents and router responses as flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowatlas.functions.predicates import known_mode, read_time, router_mode

LOCATION = "struct<longitude:double,latitude:double>"
PLACE = f"struct<type:string,id:string,name:string,location:{LOCATION},station:struct<id:string,name:string,location:{LOCATION}>>"
#: Places may be a struct or a bare string, so they're read as text first.
LEG = "struct<origin:string,destination:string,departure:string,arrival:string,departureDelay:int,arrivalDelay:int,mode:string,operator:string,stopovers:array<struct<stop:string,arrival:string,departure:string>>,polyline:string>"
JOURNEY = f"struct<legs:array<{LEG}>>"
ROUTER_PLACE = "struct<name:string,lat:double,lon:double,departureTime:bigint,arrivalTime:bigint,stop:struct<gtfsId:string>>"
ROUTER = f"struct<data:struct<plan:struct<itineraries:array<struct<startTime:bigint,endTime:bigint,legs:array<struct<mode:string,startTime:bigint,endTime:bigint,agency:struct<id:string,name:string>,`from`:{ROUTER_PLACE},to:{ROUTER_PLACE},intermediatePlaces:array<{ROUTER_PLACE}>,legGeometry:struct<points:string>>>>>>>>"


def read_place(text: Column) -> Column:
    """A place from its JSON text, or from a bare string that is its id and name."""
    whole = F.from_json(text, PLACE)
    bare = F.struct(F.lit("station").alias("type"), text.alias("id"), text.alias("name"), F.lit(None).cast(LOCATION).alias("location"), F.lit(None).cast(f"struct<id:string,name:string,location:{LOCATION}>").alias("station"))
    return F.when(F.ltrim(text).startswith("{"), whole).when(text.isNotNull(), bare.cast(PLACE))


def location_of(place: Column) -> Column:
    """A place's own location, else its station's."""
    return F.coalesce(place["location"], place["station"]["location"])


def read_journeys(docs: DataFrame, column: str = "journey") -> DataFrame:
    """option_id and each leg of its journey JSON: leg_seq, mode, departure, arrival, delays, operator, origin, destination,
    stopovers (lon, lat, arrival, departure), polyline (text)."""
    legs = docs.select("option_id", F.posexplode(F.from_json(column, JOURNEY)["legs"]).alias("leg_seq", "l"))
    spot = lambda place: F.struct(location_of(place)["longitude"].alias("lon"), location_of(place)["latitude"].alias("lat"))
    stops = F.transform("l.stopovers", lambda s: F.struct(location_of(read_place(s["stop"]))["longitude"].alias("lon"), location_of(read_place(s["stop"]))["latitude"].alias("lat"), read_time(s["arrival"]).cast("timestamp_ntz").alias("arrival"), read_time(s["departure"]).cast("timestamp_ntz").alias("departure")))
    name = F.when(F.ltrim("l.operator").startswith("{"), F.get_json_object("l.operator", "$.name")).otherwise(F.col("l.operator"))
    return legs.select(
        "option_id", "leg_seq", known_mode(F.col("l.mode")).alias("mode"), read_time(F.col("l.departure")).cast("timestamp_ntz").alias("departure"), read_time(F.col("l.arrival")).cast("timestamp_ntz").alias("arrival"),
        F.col("l.departureDelay").alias("departure_delay"), F.col("l.arrivalDelay").alias("arrival_delay"), name.alias("operator"), spot(read_place(F.col("l.origin"))).alias("origin"), spot(read_place(F.col("l.destination"))).alias("destination"),
        stops.alias("stopovers"), F.col("l.polyline").alias("polyline"), read_place(F.col("l.origin"))["name"].alias("origin_name"),
    )


def read_router(docs: DataFrame, column: str = "response") -> DataFrame:
    """(response_id, itinerary, leg_seq, mode, departure, arrival, operator, stop_names, points, polyline) of router JSON.

    Stopovers are from, the intermediate places and to; a mode that the table lacks is the empty string.
    """
    legs = docs.select("response_id", F.posexplode(F.from_json(column, ROUTER)["data"]["plan"]["itineraries"]).alias("itinerary", "i")).select("response_id", "itinerary", F.posexplode("i.legs").alias("leg_seq", "l"))
    places = F.concat(F.array("l.from"), F.coalesce(F.col("l.intermediatePlaces"), F.array().cast(f"array<{ROUTER_PLACE}>")), F.array("l.to"))
    time = lambda ms: F.timestamp_millis(ms)
    stops = F.transform(places, lambda p: F.struct(p["name"].alias("name"), p["lon"].alias("lon"), p["lat"].alias("lat"), time(p["arrivalTime"]).alias("arrival"), time(p["departureTime"]).alias("departure")))
    return legs.select("response_id", "itinerary", "leg_seq", router_mode(F.col("l.mode")).alias("mode"), time(F.col("l.startTime")).alias("departure"), time(F.col("l.endTime")).alias("arrival"), F.col("l.agency.name").alias("operator"), stops.alias("stopovers"), F.col("l.legGeometry.points").alias("polyline"))


def union_options(tables: list[DataFrame]) -> DataFrame:
    """The options of several mode combinations together; None entries are skipped."""
    there = [t for t in tables if t is not None]
    out = there[0]
    for t in there[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_results(spark: SparkSession, path: str, sim_id: str, fmt: str = "parquet") -> DataFrame:
    """Route results of one simulation, by partition where the data is partitioned."""
    return spark.read.format(fmt).load(path).where(F.col("sim_id") == sim_id)
