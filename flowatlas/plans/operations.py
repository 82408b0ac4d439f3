"""Queries on feeds, delays, matching, documents and router responses, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowatlas.functions.polyline import decode_polyline
from flowatlas.functions.predicates import is_number
from flowatlas.operators import congestion, delays, feeds, matching, traces
from flowatlas.plans.fixtures import TARGETS, Tables
from flowatlas.plans.mobility import rounded
from flowatlas.sources import journeys, store

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT * FROM fx_transfers WHERE from_stop_id IN (SELECT stop_id FROM fx_stops_gtfs) AND to_stop_id IN (SELECT stop_id FROM fx_stops_gtfs) AND (from_trip_id IS NULL OR from_trip_id IN (SELECT trip_id FROM fx_trips)) AND (to_route_id IS NULL OR to_route_id IN (SELECT route_id FROM fx_routes_gtfs))")
def transfer_repair(t: Tables) -> DataFrame:
    return feeds.repair_transfers(t.transfers, t.stops_gtfs, t.trips, t.routes_gtfs)


@query("SELECT s_suppkey AS agency_id, CASE WHEN s_suppkey % 4 = 0 THEN '-' ELSE 'https://' || s_name END AS agency_url FROM supplier")
def agency_fill(t: Tables) -> DataFrame:
    agency = t.base("supplier").select(F.col("s_suppkey").alias("agency_id"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("https://"), "s_name")).alias("agency_url"))
    return feeds.fill_agency_url(agency)


@query("SELECT place, CAST(target AS VARCHAR) AS target, arg_min(link, (abs(date_diff('day', CAST(date AS DATE), target)), ord)) AS link FROM fx_links CROSS JOIN fx_targets GROUP BY place, fx_targets.target")
def nearest_link(t: Tables) -> DataFrame:
    return feeds.nearest_links(t.links, list(TARGETS)).withColumn("target", F.col("target").cast("string"))


@query("SELECT provider, CAST(target AS VARCHAR) AS target, arg_min(link, (date_diff('day', CAST(date AS DATE), target), ord)) AS link FROM fx_links CROSS JOIN fx_targets WHERE CAST(date AS DATE) <= target GROUP BY provider, fx_targets.target")
def latest_link(t: Tables) -> DataFrame:
    return feeds.latest_links(t.links, list(TARGETS)).withColumn("target", F.col("target").cast("string"))


BINS = """bins AS (SELECT lower(operator) AS operator, CAST(regexp_extract(label, '^([0-9]+)', 1) AS INTEGER) AS start, coalesce(try_cast(replace(percent, '%', '') AS DOUBLE), 0) AS w FROM fx_delay_rows WHERE label NOT IN ('cancelled', 'substituted')),
shares AS (SELECT *, w / sum(w) OVER (PARTITION BY operator) AS weight, CAST(row_number() OVER o - 1 AS INTEGER) AS bin, coalesce(lead(start) OVER o, start + 5) AS "end" FROM bins WINDOW o AS (PARTITION BY operator ORDER BY start)),
ups AS (SELECT *, sum(weight) OVER (PARTITION BY operator ORDER BY start ROWS UNBOUNDED PRECEDING) AS up FROM shares),
cut AS (SELECT *, coalesce(lag(up) OVER o, 0) AS cum_lo, CASE WHEN lead(start) OVER o IS NULL THEN 1e0 ELSE up END AS cum_hi FROM ups WINDOW o AS (PARTITION BY operator ORDER BY start)),
rates AS (SELECT lower(operator) AS operator, coalesce(sum(CASE WHEN label = 'cancelled' THEN coalesce(try_cast(replace(percent, '%', '') AS DOUBLE), 0) END), 0) AS cancelled_percent FROM fx_delay_rows GROUP BY 1),
drawn AS (SELECT l.*, u0 * 100 < r.cancelled_percent AS cancelled, CASE WHEN NOT u0 * 100 < r.cancelled_percent THEN CAST(c.start + floor(u2 * (c."end" - c.start)) AS INTEGER) END AS delay FROM (SELECT u.*, CASE WHEN lower(operator) IN (SELECT operator FROM rates) THEN lower(operator) ELSE 'average' END AS op FROM fx_u_bin u) l JOIN rates r ON l.op = r.operator JOIN cut c ON l.op = c.operator AND (u1 > cum_lo OR u1 <= 0 AND bin = 0) AND u1 <= cum_hi)"""


@query(f'WITH {BINS} SELECT operator, bin, start, "end", round(weight, 9) AS weight, round(cum_lo, 9) AS cum_lo, round(cum_hi, 9) AS cum_hi FROM cut')
def delay_bins(t: Tables) -> DataFrame:
    return rounded(delays.delay_bins(t.delay_rows), 9)


def _draws(t: Tables) -> DataFrame:
    return delays.draw_delays(t.leg_keys, delays.delay_bins(t.delay_rows), delays.operator_rates(t.delay_rows))


@query(f"WITH {BINS} SELECT leg_key, cancelled, delay FROM drawn")
def delay_draw(t: Tables) -> DataFrame:
    return _draws(t).select("leg_key", "cancelled", "delay")


TRANSIT = "mode IN ('train', 'bus', 'watercraft', 'aircraft', 'gondola')"


@query(f"""WITH {BINS}, f AS (SELECT *, {TRANSIT} AND (cancelled OR coalesce(departure + to_minutes(delay) < lag(arrival) OVER (PARTITION BY option_id ORDER BY leg_seq), false)) AS failed, CASE WHEN {TRANSIT} AND NOT cancelled THEN delay END AS own FROM drawn)
SELECT option_id, CAST(leg_seq AS INTEGER) AS leg_seq, coalesce(last_value(own IGNORE NULLS) OVER w, 0) AS current_delay, NOT bool_or(failed) OVER w AS reached FROM f WINDOW w AS (PARTITION BY option_id ORDER BY leg_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def delay_propagation(t: Tables) -> DataFrame:
    return delays.propagate(_draws(t)).select("option_id", F.col("leg_seq").cast("int").alias("leg_seq"), "current_delay", "reached")


def _steps(t: Tables) -> DataFrame:
    """From, two steps and to of car legs."""
    at = lambda k, a, b, n: ((F.col("pk") * a + F.col("sk") * b + k * 11) % n)
    legs = t.legs.where("mode = 'car'").select((F.col("option_id") * 16 + F.col("leg_seq")).alias("leg_key"), "pk", "sk", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step"))
    return legs.select("leg_key", "step", (5.4003 + at(F.col("step"), 7, 3, 140) * 0.001).alias("lon"), (51.4004 + at(F.col("step"), 5, 11, 90) * 0.001).alias("lat"))


STEPS = "steps AS (SELECT option_id * 16 + leg_seq AS leg_key, step, 5.4003e0 + ((pk * 7 + sk * 3 + step * 11) % 140) * 0.001e0 AS lon, 51.4004e0 + ((pk * 5 + sk * 11 + step * 11) % 90) * 0.001e0 AS lat FROM fx_legs, unnest(range(0, 4)) AS s(step) WHERE mode = 'car')"
NEAR = """places AS (SELECT DISTINCT lon, lat FROM steps), near AS (SELECT p.lon, p.lat, arg_min(n.node_id, (2 * 6371000e0 * asin(sqrt(pow(sin((radians(n.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(n.lat)) * pow(sin((radians(n.lon) - radians(p.lon)) / 2), 2))), n.node_id)) AS node_id FROM places p CROSS JOIN fx_graph_nodes n GROUP BY 1, 2)"""


@query(f"WITH {STEPS}, {NEAR} SELECT leg_key, CAST(step AS INTEGER) AS step, node_id FROM steps s JOIN near n ON s.lon = n.lon AND s.lat = n.lat")
def nearest_node(t: Tables) -> DataFrame:
    return matching.nearest_nodes(_steps(t), t.graph_nodes).select("leg_key", "step", "node_id")


@query(f"""WITH {STEPS}, {NEAR}, hops AS (SELECT leg_key, node_id AS source, lead(node_id) OVER (PARTITION BY leg_key ORDER BY step) AS target FROM steps s JOIN near n ON s.lon = n.lon AND s.lat = n.lat), wanted AS (SELECT DISTINCT source, target FROM hops WHERE target IS NOT NULL)
SELECT source, target FROM wanted""")
def matching_pairs(t: Tables) -> DataFrame:
    placed = matching.nearest_nodes(_steps(t), t.graph_nodes)
    order = Window.partitionBy("leg_key").orderBy("step")
    return placed.withColumn("target", F.lead("node_id").over(order)).where("target is not null").select(F.col("node_id").alias("source"), "target").distinct()


@query("""SELECT point_id, arg_min(node_id, (2 * 6371000e0 * asin(least(sqrt(pow(sin((radians(n.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(n.lat)) * pow(sin((radians(n.lon) - radians(p.lon)) / 2), 2)), 1e0)), node_id)) AS node_id
FROM fx_globe_points p CROSS JOIN fx_globe_nodes n GROUP BY point_id""")
def nearest_on_globe(t: Tables) -> DataFrame:
    """Nearest nodes across the antimeridian and at the poles, few and far between."""
    return matching.nearest_nodes(t.globe_points, t.globe_nodes, cell_degrees=1.0).select("point_id", "node_id")


#: Edges are 300 to 499 long and any two nodes of the 30 by 20 grid are at most 48 edges apart: no shortest path has more edges.
LONGEST = 48 * 499 // 300 + 1


def _distances() -> str:
    """CTEs up to the distances of all pairs, by relaxing all edges as often as a shortest path can have edges."""
    rounds = ["d0 AS (SELECT DISTINCT source, source AS node, 0e0 AS dist FROM wanted)"]
    for k in range(1, LONGEST + 1):
        rounds.append(f"d{k} AS MATERIALIZED (SELECT source, node, min(dist) AS dist FROM (SELECT * FROM d{k - 1} UNION ALL SELECT source, after, dist + length FROM d{k - 1} JOIN roads ON node = before) r GROUP BY 1, 2)")
    return f"""{STEPS}, {NEAR}, hops AS (SELECT leg_key, step, node_id AS source, lead(node_id) OVER (PARTITION BY leg_key ORDER BY step) AS target FROM steps s JOIN near n ON s.lon = n.lon AND s.lat = n.lat), wanted AS MATERIALIZED (SELECT DISTINCT source, target FROM hops WHERE target IS NOT NULL),
roads AS MATERIALIZED (SELECT node_lo AS before, node_hi AS after, length FROM fx_graph UNION ALL SELECT node_hi, node_lo, length FROM fx_graph), {', '.join(rounds)}"""


@query(f"WITH {_distances()} SELECT w.source, w.target, dist AS length, dist AS walked FROM wanted w JOIN d{LONGEST} d ON w.source = d.source AND w.target = d.node")
def path_lengths(t: Tables) -> DataFrame:
    """Each pair's distance, and the sum of the edges of its path."""
    pairs = matching_pairs(t)
    paths = store.shared_checkpoint(matching.shortest_paths(pairs, t.graph))
    edges = congestion.route_edges(paths.select("source", "target", F.col("path").alias("osm_nodes")))
    walked = edges.join(t.graph, ["node_lo", "node_hi"]).groupBy("source", "target").agg(F.sum("length").alias("walked"))
    return paths.select("source", "target", "length").join(walked, ["source", "target"], "left").withColumn("walked", F.coalesce("walked", F.lit(0.0)))


@query(f"""WITH RECURSIVE {_distances()}, parents AS MATERIALIZED (SELECT d.source, d.node, min(before) AS parent FROM d{LONGEST} d JOIN roads ON node = after JOIN d{LONGEST} b ON b.source = d.source AND b.node = before WHERE b.dist + length = d.dist GROUP BY 1, 2),
walk AS (SELECT source, target, target AS spot, 0 AS back FROM wanted UNION ALL SELECT w.source, target, parent, back + 1 FROM walk w JOIN parents p ON w.source = p.source AND spot = p.node),
spots AS (SELECT leg_key, step, spot, back, back = max(back) OVER (PARTITION BY leg_key, step) AS joint, step = min(step) OVER (PARTITION BY leg_key) AS opens FROM hops h JOIN walk w ON h.source = w.source AND h.target = w.target)
SELECT leg_key, string_agg(CAST(spot AS VARCHAR), ',' ORDER BY step, back DESC) AS osm_nodes FROM spots WHERE opens OR NOT joint GROUP BY leg_key""")
def route_matching(t: Tables) -> DataFrame:
    """The whole route of every car leg: each node the smallest one that lies on a shortest way."""
    matched = matching.match_legs(_steps(t), t.graph_nodes, t.graph)
    return matched.select("leg_key", F.array_join(F.transform("osm_nodes", lambda n: n.cast("string")), ",").alias("osm_nodes"))


@query("SELECT least(a, b) AS node_lo, greatest(a, b) AS node_hi, min(len) AS length FROM (SELECT node AS a, after AS b, 50e0 + (node * 31 + after * 17) % 400 AS len FROM (SELECT node, lead(node) OVER (PARTITION BY option_id, leg_seq ORDER BY i) AS after FROM fx_route_nodes) p WHERE after IS NOT NULL) q GROUP BY 1, 2")
def undirected_graph(t: Tables) -> DataFrame:
    edges = congestion.used_edges(t.routes().where("osm_nodes is not null"))
    return matching.undirected(edges.withColumn("length", (50 + (F.col("origin") * 31 + F.col("destination") * 17) % 400).cast("double")))


@query("SELECT e.node_lo, e.node_hi, e.length FROM fx_edges e")
def edge_metadata(t: Tables) -> DataFrame:
    used = congestion.used_edges(t.routes().where("osm_nodes is not null"))
    return matching.edge_metadata(used, t.edge_table().withColumn("geometry", F.lit("LINESTRING EMPTY"))).select("node_lo", "node_hi", "length")


@query("""WITH old AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 4 <> 1), new AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS segment, c_acctbal * 2 AS balance FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(o.id, n.id) AS id, o.name, CASE WHEN n.id IS NOT NULL THEN n.balance ELSE o.balance END AS balance, n.segment FROM old o FULL JOIN new n ON o.id = n.id""")
def upsert(t: Tables) -> DataFrame:
    c = t.base("customer")
    old = c.where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).alias("segment"), (F.col("c_acctbal") * 2).alias("balance"))
    return store.upsert(old, new, "id").select("id", "name", "balance", "segment")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def keyed_lookup(t: Tables) -> DataFrame:
    ids = t.base("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return store.search(t.base("customer"), "c_nationkey", ids, ["c_custkey", "c_name"]).withColumnsRenamed({"c_custkey": "id", "c_name": "name"})


@query("SELECT c_custkey AS id, 'new' AS kind, c_acctbal * 2 AS balance FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'old', c_acctbal FROM customer WHERE c_custkey % 4 <> 1 AND c_custkey % 3 <> 0")
def replace_documents(t: Tables) -> DataFrame:
    c = t.base("customer")
    pick = lambda kind, factor: [F.col("c_custkey").alias("id"), F.lit(kind).alias("kind"), (F.col("c_acctbal") * factor).alias("balance")]
    return store.replace(c.where("c_custkey % 4 <> 1").select(pick("old", 1)), c.where("c_custkey % 3 = 0").select(pick("new", 2)), "id")


@query("SELECT cell, education, work_office, work_social, work_office + work_social AS work FROM fx_tiles")
def flatten_year(t: Tables) -> DataFrame:
    work = F.struct(F.col("work_office").alias("office"), F.col("work_social").alias("social"), (F.col("work_office") + F.col("work_social")).alias("total"))
    docs = t.tiles.select("cell", F.struct("education", work.alias("work")).alias("2020"))
    flat = store.flatten_year(docs, "2020", ["work"], {"work_total": "work"})
    return flat.select("cell", "education", "work_office", "work_social", "work")


@query("SELECT cell, work_office + work_social AS total, parking FROM (SELECT *, population / 2 AS parking FROM fx_tiles) x")
def nest_year(t: Tables) -> DataFrame:
    rows = t.tiles.select("cell", "work_office", "work_social", (F.col("population") / 2).alias("parking_car"))
    nested = store.nest_year(rows, "cell", "2020", ["work", "parking"])
    return nested.select("cell", (F.col("2020.work.office") + F.col("2020.work.social")).alias("total"), F.col("2020.parking.car").alias("parking"))


@query("SELECT vc_id, 's2' AS sim_id, 's1' AS created_from_sim_id, vc_id AS created_from_vc_id, '2024-06-01' AS sim_date FROM fx_commuters WHERE vc_id % 2 = 1 UNION ALL SELECT vc_id, 's1', NULL, NULL, '2024-05-01' FROM fx_commuters WHERE vc_id % 2 = 1")
def clone_simulation(t: Tables) -> DataFrame:
    rows = t.commuters.select("vc_id", F.concat(F.lit("s"), F.col("vc_id") % 2).alias("sim_id"), F.lit("2024-05-01").alias("sim_date"))
    cloned = store.clone_simulation(rows, "s1", "s2", new_date="2024-06-01").drop("created_by")
    return store.drop_results(rows, "s0").unionByName(cloned, allowMissingColumns=True).select("vc_id", "sim_id", "created_from_sim_id", "created_from_vc_id", "sim_date")


@query("SELECT o.option_id, coalesce(c.age, 'old') AS age FROM fx_options o LEFT JOIN (SELECT * FROM fx_commuters WHERE vc_id % 5 <> 0) c ON o.vc_id = c.vc_id")
def refresh_travellers(t: Tables) -> DataFrame:
    results = t.options.select("option_id", "vc_id", F.lit("s1").alias("sim_id"), F.struct(F.lit("old").alias("age")).alias("traveller"))
    commuters = t.commuters.where("vc_id % 5 <> 0").select("vc_id", F.lit("s1").alias("sim_id"), F.struct("age").alias("traveller"))
    return store.refresh_travellers(results, commuters).select("option_id", F.col("traveller.age").alias("age"))


@query("SELECT vc_id, age FROM fx_commuters WHERE vc_id % 3 <> 0")
def backlog(t: Tables) -> DataFrame:
    jobs = t.commuters.where("vc_id % 3 = 0").select("vc_id")
    return store.without_job(t.commuters, jobs, ["vc_id"]).select("vc_id", "age")


@query("SELECT option_id, CAST(leg_seq AS INTEGER) AS leg_seq, CASE WHEN mode = 'gondola' THEN '' ELSE mode END AS mode, departure, arrival, operator, CAST(CASE WHEN pk % 5 = 0 THEN 2 ELSE 3 END AS INTEGER) AS n_stops FROM fx_legs")
def router_response(t: Tables) -> DataFrame:
    """Responses made of all options, as text, and read again."""
    ms = lambda c: (F.unix_millis(F.col(c).cast("timestamp")))
    names = F.create_map(*[F.lit(x) for kv in {"walking": "WALK", "car": "CAR", "bus": "BUS", "train": "RAIL", "bicycle": "BICYCLE", "gondola": "GONDOLA"}.items() for x in kv])
    place = lambda k: F.struct(F.concat(F.lit("p"), F.col("pk"), F.lit(f"-{k}")).alias("name"), F.lit(51.4).alias("lat"), F.lit(5.4).alias("lon"), ms("departure").alias("departureTime"), ms("arrival").alias("arrivalTime"))
    leg = F.struct("leg_seq", F.struct(names[F.col("mode")].alias("mode"), ms("departure").alias("startTime"), ms("arrival").alias("endTime"), F.struct(F.lit("a").alias("id"), F.col("operator").alias("name")).alias("agency"), place(0).alias("from"), place(9).alias("to"), F.when(F.col("pk") % 5 != 0, F.array(place(1))).alias("intermediatePlaces")).alias("leg"))
    legs = t.legs.groupBy("option_id").agg(F.array_sort(F.collect_list(leg), lambda a, b: (a["leg_seq"] - b["leg_seq"]).cast("int")).alias("legs"))
    itinerary = F.struct(F.transform("legs", lambda x: x["leg"]).alias("legs"))
    docs = legs.select(F.col("option_id").alias("response_id"), F.to_json(F.struct(F.struct(F.struct(F.array(itinerary).alias("itineraries")).alias("plan")).alias("data"))).alias("response"))
    read = journeys.read_router(docs)
    return read.select(F.col("response_id").alias("option_id"), "leg_seq", "mode", F.col("departure").cast("timestamp_ntz").alias("departure"), F.col("arrival").cast("timestamp_ntz").alias("arrival"), "operator", F.size("stopovers").alias("n_stops"))


@query("SELECT option_id, CAST(leg_seq AS INTEGER) AS leg_seq, mode, departure, arrival, departure_delay, operator, CASE WHEN sk % 19 = 0 THEN 'S' || CAST(sk AS VARCHAR) ELSE 'origin' END AS origin_name, CASE WHEN sk % 19 <> 0 THEN round(5.40e0 + ((pk * 7 + sk * 3) % 160) * 0.001e0, 6) END AS lon FROM fx_legs")
def journey_json(t: Tables) -> DataFrame:
    """Journeys made of all options, as text with bare-string places among them, and read again."""
    spot = F.to_json(F.struct(F.lit("location").alias("type"), F.lit("origin").alias("name"), F.struct((5.40 + ((F.col("pk") * 7 + F.col("sk") * 3) % 160) * 0.001).alias("longitude"), F.lit(51.4).alias("latitude")).alias("location")))
    origin = F.when(F.col("sk") % 19 == 0, F.concat(F.lit("S"), F.col("sk"))).otherwise(spot)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    leg = F.struct("leg_seq", F.struct(origin.alias("origin"), iso("departure").alias("departure"), iso("arrival").alias("arrival"), F.col("departure_delay").alias("departureDelay"), "mode", F.to_json(F.struct(F.col("operator").alias("name"))).alias("operator")).alias("leg"))
    legs = t.legs.groupBy("option_id").agg(F.array_sort(F.collect_list(leg), lambda a, b: (a["leg_seq"] - b["leg_seq"]).cast("int")).alias("legs"))
    docs = legs.select("option_id", F.to_json(F.struct(F.transform("legs", lambda x: x["leg"]).alias("legs"))).alias("journey"))
    read = journeys.read_journeys(docs)
    return rounded(read.select("option_id", "leg_seq", "mode", "departure", "arrival", "departure_delay", "operator", "origin_name", F.col("origin.lon").alias("lon")))


@query("SELECT option_id, vc_id, 'WALK' AS modes FROM fx_options WHERE option_id % 2 = 0 UNION ALL SELECT option_id, vc_id, 'CAR' FROM fx_options WHERE option_id % 3 = 0")
def option_union(t: Tables) -> DataFrame:
    pick = lambda n, mode: t.options.where(F.col("option_id") % n == 0).select("option_id", "vc_id", F.lit(mode).alias("modes"))
    return journeys.union_options([pick(2, "WALK"), None, pick(3, "CAR")])


@query("SELECT c_custkey AS id, regexp_matches(CAST(c_custkey AS VARCHAR), '^[0-9]+$') AS numeric_id, regexp_matches(c_name, '^[0-9]+$') AS numeric_name FROM customer")
def number_test(t: Tables) -> DataFrame:
    return t.base("customer").select(F.col("c_custkey").alias("id"), is_number(F.col("c_custkey").cast("string")).alias("numeric_id"), is_number(F.col("c_name")).alias("numeric_name"))


#: Two encoded lines, of three points and of one; legs take one by their part key.
LINES = {"_p~iF~ps|U_ulLnnqC_mqNvxq`@": [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)], "_p~iF~ps|U": [(-120.2, 38.5)]}


def _line_sql() -> str:
    (three, one) = LINES.values()
    points = " UNION ALL ".join([f"SELECT *, {i} AS i, 3 AS n, {x}e0 AS lon, {y}e0 AS lat FROM l WHERE pk % 2 = 0" for i, (x, y) in enumerate(three)] + [f"SELECT *, 0 AS i, 1 AS n, {one[0][0]}e0 AS lon, {one[0][1]}e0 AS lat FROM l WHERE pk % 2 = 1"])
    return f"""WITH l AS (SELECT *, departure + to_seconds(coalesce(departure_delay, 0)) AS b, arrival + to_seconds(coalesce(arrival_delay, 0)) AS e FROM fx_legs), p AS ({points})
SELECT option_id, CAST(row_number() OVER (PARTITION BY option_id ORDER BY leg_seq, i) - 1 AS INTEGER) AS seq, round(lon, 5) AS lon, round(lat, 5) AS lat, b + to_seconds(CAST(floor(date_diff('second', b, e) * i / greatest(n - 1, 1)) AS BIGINT)) AS ts, i = 0 AS is_leg_start FROM p"""


@query(_line_sql())
def polyline_trace(t: Tables) -> DataFrame:
    line = F.when(F.col("pk") % 2 == 0, list(LINES)[0]).otherwise(list(LINES)[1])
    legs = t.nested_legs().withColumn("polyline", decode_polyline(line))
    return rounded(traces.trace_points(legs).drop("mode"), 5)
