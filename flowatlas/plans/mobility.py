"""Queries on choices, traces, shares, heatmaps and congestion, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowatlas.functions import geo, predicates
from flowatlas.operators import choice, congestion, feedback, heatmap, matching, places, shares, traces
from flowatlas.plans.fixtures import RING, VEHICLE_FACTORS, Tables
from flowatlas.sources.store import shared_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    return df.select(*[F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _commuters(t: Tables) -> DataFrame:
    return t.commuters.withColumn("has_vehicle", predicates.has_motor_vehicle("car", "moto", "utilities"))


def _selection(t: Tables, **options) -> DataFrame:
    return choice.decide(t.options, choice.option_facts(t.legs), _commuters(t), **options)


HAV = "2 * 6371000e0 * atan2(sqrt({a}), sqrt(1 - ({a})))".replace("{a}", "pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)")
CHOSEN = """chosen AS (SELECT o.vc_id, arg_min(o.option_id, (coalesce(f.duration, 0), o.opt_ord)) AS option_id FROM fx_options o LEFT JOIN fx_facts f ON o.option_id = f.option_id JOIN fx_commuters c ON o.vc_id = c.vc_id
WHERE c.usage IS NOT NULL OR NOT coalesce(f.has_car, false) GROUP BY o.vc_id)"""
MEASURE = """sum(CASE WHEN mode = 'car' THEN m ELSE 0 END) AS car_meters, sum(CASE WHEN mode IN ('train', 'gondola', 'watercraft') THEN m ELSE 0 END) AS rail_meters, sum(CASE WHEN mode = 'bus' THEN m ELSE 0 END) AS bus_meters, sum(CASE WHEN mode = 'walking' THEN m ELSE 0 END) AS walk_meters,
CAST(sum(CASE WHEN mode = 'car' AND is_leg_start THEN 1 ELSE 0 END) AS BIGINT) AS car_passengers, CAST(sum(CASE WHEN mode IN ('train', 'gondola', 'watercraft') AND is_leg_start THEN 1 ELSE 0 END) AS BIGINT) AS rail_passengers, CAST(sum(CASE WHEN mode = 'bus' AND is_leg_start THEN 1 ELSE 0 END) AS BIGINT) AS bus_passengers, CAST(sum(CASE WHEN mode = 'walking' AND is_leg_start THEN 1 ELSE 0 END) AS BIGINT) AS walkers"""
M8 = [*traces.MEASURES]


def pairs(source: str, by: str = "option_id") -> str:
    """SQL of neighbouring points of one mode with their distance m."""
    return f"SELECT {by}, mode, is_leg_start, {HAV} AS m FROM (SELECT {by}, mode, is_leg_start, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(mode) OVER w AS mode2 FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY seq)) p WHERE mode = mode2"


def share_columns(alias: str = "") -> str:
    pm = {k: f"{alias}{k}_meters * {alias}{'walkers' if k == 'walk' else k + '_passengers'}" for k in ("car", "rail", "bus", "walk")}
    total = " + ".join(pm.values())
    return ", ".join(f"round(CASE WHEN {total} > 0 THEN ({p}) / ({total}) ELSE 0e0 END, 6) AS {k}_share" for k, p in pm.items())


def measures(digits: int = 2) -> str:
    return ", ".join(f"round({m}, {digits}) AS {m}" if "meters" in m else m for m in M8)


SUMS = ", ".join(f"coalesce(sum({m}), 0) AS {m}" if "meters" in m else f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in M8)
TRANSIT = "round(CASE WHEN (rail_meters + bus_meters) * (rail_passengers + bus_passengers) + car_meters * car_passengers > 0 THEN (rail_meters + bus_meters) * (rail_passengers + bus_passengers) / ((rail_meters + bus_meters) * (rail_passengers + bus_passengers) + car_meters * car_passengers) ELSE 0e0 END, 6) AS transit_share"
INSIDE = " AND ".join([f"lon BETWEEN {min(p[0] for p in RING)}e0 AND {max(p[0] for p in RING)}e0", f"lat BETWEEN {min(p[1] for p in RING)}e0 AND {max(p[1] for p in RING)}e0"]) + " AND (" + " + ".join(
    f"CASE WHEN ({y1}e0 > lat) <> ({y2}e0 > lat) AND lon < ({x2}e0 - {x1}e0) * (lat - {y1}e0) / ({y2}e0 - {y1}e0) + {x1}e0 THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1])) + ") % 2 = 1"
CLIPPED = f"""marked AS (SELECT *, max(CASE WHEN is_leg_start THEN seq END) OVER (PARTITION BY option_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_start FROM fx_trace),
clipped AS (SELECT option_id, seq, lon, lat, ts, mode, is_leg_start OR coalesce(last_start, -1) > coalesce(lag(seq) OVER (PARTITION BY option_id ORDER BY seq), -1) AS is_leg_start FROM marked WHERE {INSIDE})"""


@query(f"WITH {CHOSEN}, p AS ({pairs('(SELECT t.* FROM fx_trace t SEMI JOIN chosen c ON t.option_id = c.option_id)')}), s AS (SELECT {MEASURE} FROM p), z AS (SELECT {SUMS} FROM s) SELECT {measures()}, {share_columns()}, {TRANSIT} FROM z")
def modal_shares(t: Tables) -> DataFrame:
    return rounded(shares.simulation_stats(_selection(t), t.nested_legs()), **{m: 2 for m in M8})


@query(f"WITH {CHOSEN}, p AS ({pairs('(SELECT t.* FROM fx_trace t SEMI JOIN chosen c ON t.option_id = c.option_id)')}), s AS (SELECT {MEASURE} FROM p), z AS (SELECT {SUMS} FROM s) SELECT {TRANSIT} FROM z")
def transit_share(t: Tables) -> DataFrame:
    stats = traces.transit_share(traces.merge_stats(shares.selected_stats(_selection(t), t.nested_legs())))
    return rounded(stats.select("transit_share"))


@query(f"WITH {CHOSEN}, few AS (SELECT * FROM chosen ORDER BY vc_id LIMIT 700), p AS ({pairs('(SELECT t.* FROM fx_trace t SEMI JOIN few c ON t.option_id = c.option_id)')}), s AS (SELECT {MEASURE} FROM p), z AS (SELECT {SUMS} FROM s) SELECT {measures()}, {share_columns()}, {TRANSIT} FROM z")
def first_shares(t: Tables) -> DataFrame:
    """Modal shares of the first 700 commuters' choices; the limit is the feature."""
    return rounded(shares.simulation_stats(_selection(t), t.nested_legs(), max_count=700), **{m: 2 for m in M8})


@query(f"WITH {CHOSEN} SELECT c.vc_id, c.option_id, f.has_car, f.duration FROM chosen c LEFT JOIN fx_facts f ON c.option_id = f.option_id")
def choose_option(t: Tables) -> DataFrame:
    return _selection(t).join(choice.option_facts(t.legs), "option_id", "left").select("vc_id", "option_id", "has_car", "duration")


@query(f"""WITH users AS (SELECT c.vc_id, c.usage IS NOT NULL OR (NOT owns AND u18 < 0.2) OR ((owns OR u18 < 0.2) AND u19 < 0.3) AS uses FROM (SELECT *, greatest(coalesce(car, 0), coalesce(moto, 0), coalesce(utilities, 0)) > 0 AS owns FROM fx_commuters) c JOIN fx_draws d ON c.vc_id = d.vc_id)
SELECT o.vc_id, arg_min(o.option_id, (coalesce(f.duration, 0), o.opt_ord)) AS option_id FROM fx_options o LEFT JOIN fx_facts f ON o.option_id = f.option_id JOIN users u ON o.vc_id = u.vc_id WHERE uses OR NOT coalesce(f.has_car, false) GROUP BY o.vc_id""")
def choose_with_overrides(t: Tables) -> DataFrame:
    return _selection(t, own=0.2, use=0.3)


@query("SELECT option_id, CAST(seq AS INTEGER) AS seq, round(lon, 6) AS lon, round(lat, 6) AS lat, ts, mode, is_leg_start FROM fx_trace")
def trace_points(t: Tables) -> DataFrame:
    return rounded(traces.trace_points(t.nested_legs()))


@query(f"WITH p AS ({pairs('fx_trace')}), s AS (SELECT option_id, {MEASURE} FROM p GROUP BY option_id) SELECT option_id, {measures(3)} FROM s")
def trace_stats(t: Tables) -> DataFrame:
    return rounded(traces.trace_stats(traces.trace_points(t.nested_legs())), 3)


@query(f"""WITH located AS (SELECT *, idx = 0 AS z FROM fx_stops WHERE NOT unlocated), steps AS (SELECT option_id, leg_seq, mode, {HAV} AS m FROM (SELECT option_id, leg_seq, mode, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM located WINDOW w AS (PARTITION BY option_id, leg_seq ORDER BY idx)) q),
legs AS (SELECT l.option_id, l.mode, true AS is_leg_start, coalesce(s.m, 0) AS m FROM fx_legs l LEFT JOIN (SELECT option_id, leg_seq, sum(m) AS m FROM steps GROUP BY 1, 2) s ON l.option_id = s.option_id AND l.leg_seq = s.leg_seq), s AS (SELECT option_id, {MEASURE} FROM legs GROUP BY option_id) SELECT option_id, {measures(3)} FROM s""")
def leg_stats(t: Tables) -> DataFrame:
    return rounded(traces.leg_stats(t.nested_legs()), 3)


@query(f"WITH {CLIPPED} SELECT option_id, CAST(seq AS INTEGER) AS seq, round(lon, 6) AS lon, round(lat, 6) AS lat, ts, mode, is_leg_start FROM clipped")
def clip_trace(t: Tables) -> DataFrame:
    return rounded(traces.with_carry(traces.trace_points(t.nested_legs()), geo.in_ring(F.col("lon"), F.col("lat"), RING)))


@query(f"WITH {CHOSEN}, {CLIPPED}, p AS ({pairs('(SELECT t.* FROM clipped t SEMI JOIN chosen c ON t.option_id = c.option_id)')}), s AS (SELECT {MEASURE} FROM p), z AS (SELECT {SUMS} FROM s) SELECT {measures()}, {share_columns()}, {TRANSIT} FROM z")
def clipped_shares(t: Tables) -> DataFrame:
    return rounded(shares.simulation_stats(_selection(t), t.nested_legs(), inside=geo.in_ring(F.col("lon"), F.col("lat"), RING)), **{m: 2 for m in M8})


PLACED = """ring_edges AS (SELECT place_id, part, x AS xa, y AS ya, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xb, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yb FROM fx_place_vertices WINDOW w AS (PARTITION BY place_id, part, ring ORDER BY i)),
spots AS (SELECT DISTINCT lon, lat FROM fx_trace), hits AS (SELECT place_id, part, lon, lat FROM spots JOIN ring_edges ON (ya > lat) <> (yb > lat) AND lon < (xb - xa) * (lat - ya) / (yb - ya) + xa GROUP BY ALL HAVING count(*) % 2 = 1),
placed AS (SELECT t.*, h.place_id FROM fx_trace t JOIN (SELECT DISTINCT place_id, lon, lat FROM hits) h ON t.lon = h.lon AND t.lat = h.lat)"""


@query(f"WITH {PLACED} SELECT option_id, CAST(seq AS INTEGER) AS seq, place_id FROM placed")
def points_in_places(t: Tables) -> DataFrame:
    """Every trace point with the places, of several parts with holes, that it lies in."""
    index = places.cover_index(places.rings_of(t.place_vertices))
    return places.points_in_places(traces.trace_points(t.nested_legs()), index, ["option_id", "seq"]).select("option_id", "seq", "place_id")


@query(f"""WITH {PLACED}, marked AS (SELECT option_id, seq, max(CASE WHEN is_leg_start THEN seq END) OVER (PARTITION BY option_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_start FROM fx_trace),
carried AS (SELECT p.option_id, p.place_id, p.seq, lon, lat, mode, is_leg_start OR coalesce(last_start, -1) > coalesce(lag(p.seq) OVER (PARTITION BY p.option_id, place_id ORDER BY p.seq), -1) AS is_leg_start FROM placed p JOIN marked m ON p.option_id = m.option_id AND p.seq = m.seq),
p AS ({pairs('carried', 'option_id, place_id')}), z AS (SELECT place_id, {MEASURE} FROM p GROUP BY place_id) SELECT place_id, {measures()}, {share_columns()} FROM z""")
def place_shares(t: Tables) -> DataFrame:
    """Modal shares of all traces clipped to each place."""
    index = places.cover_index(places.rings_of(t.place_vertices))
    return rounded(places.shares_by_place(traces.trace_points(t.nested_legs()), index), **{m: 2 for m in M8})


def celled(source: str, lon: str = "lon", lat: str = "lat") -> str:
    """SQL that adds ``cell`` to a table of points."""
    s = f"sin(radians({lat}))"
    x = f"radians({lon}) * {geo.A * geo.K0!r}e0"
    y = f"{1 - geo.E2!r}e0 * ({s} / (1 - {geo.E2!r}e0 * {s} * {s}) - {1 / (2 * geo.E1)!r}e0 * ln((1 - {geo.E1!r}e0 * {s}) / (1 + {geo.E1!r}e0 * {s}))) * {geo.A / (2 * geo.K0)!r}e0"
    return cube_cells(f"SELECT *, {x} AS x_, {y} AS y_ FROM {source}")


def cube_cells(projected: str) -> str:
    return f"""SELECT * EXCLUDE (x_, y_, q_, r_, rq, rr, rs, dq, dr, ds), (CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) + {geo.OFFSET}) * {geo.SPAN} + CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) + {geo.OFFSET} AS cell FROM (
SELECT *, abs(rq - q_) AS dq, abs(rr - r_) AS dr, abs(rs + q_ + r_) AS ds FROM (SELECT *, round_even(q_, 0) AS rq, round_even(r_, 0) AS rr, round_even(-q_ - r_, 0) AS rs FROM (
SELECT *, (x_ * {3 ** 0.5 / 3!r}e0 - y_ / 3) / {geo.SIDE!r}e0 AS q_, y_ * {2 / 3!r}e0 / {geo.SIDE!r}e0 AS r_ FROM ({projected}) a) b) c) d"""


@query(f"WITH c AS ({celled('fx_trace')}) SELECT option_id, CAST(seq AS INTEGER) AS seq, cell FROM c")
def cell_of_point(t: Tables) -> DataFrame:
    points = traces.trace_points(t.nested_legs())
    return points.select("option_id", "seq", geo.cell_of(F.col("lon"), F.col("lat")).alias("cell"))


HEAT = f"""c AS ({celled('fx_trace')}), near AS (SELECT *, cell AS own, lag(cell) OVER w AS c0, lead(cell) OVER w AS c1, max(CASE WHEN is_leg_start THEN seq END) OVER (PARTITION BY option_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_start FROM c WINDOW w AS (PARTITION BY option_id ORDER BY seq)),
spread AS (SELECT DISTINCT option_id, seq, lon, lat, mode, is_leg_start, last_start, near_cell FROM (SELECT *, unnest([own, c0, c1]) AS near_cell FROM near) q WHERE near_cell IS NOT NULL),
carried AS (SELECT option_id, near_cell AS cell, seq, lon, lat, mode, is_leg_start OR coalesce(last_start, -1) > coalesce(lag(seq) OVER (PARTITION BY option_id, near_cell ORDER BY seq), -1) AS is_leg_start FROM spread),
p AS ({pairs('carried', 'option_id, cell')}), s AS (SELECT cell, {MEASURE} FROM p GROUP BY cell), z AS (SELECT * FROM s WHERE greatest({', '.join(f'CAST({m} AS DOUBLE)' for m in M8)}) > 0)"""


@query(f"WITH {HEAT} SELECT cell, {measures()}, {share_columns()} FROM z")
def modal_heatmap(t: Tables) -> DataFrame:
    return rounded(heatmap.modal_heatmap(traces.trace_points(t.nested_legs())), **{m: 2 for m in M8})


@query(f"WITH {HEAT}, v AS (SELECT cell, {share_columns()} FROM z) SELECT cell, car_share, round(coalesce(car_share / nullif(max(car_share) OVER (), 0), 0), 5) AS by_max, round(coalesce((car_share - min(car_share) OVER ()) / nullif(max(car_share) OVER () - min(car_share) OVER (), 0), 0), 5) AS by_range FROM v")
def heat_scale(t: Tables) -> DataFrame:
    values = heatmap.modal_heatmap(traces.trace_points(t.nested_legs())).select("cell", F.round("car_share", 6).alias("car_share"))
    return rounded(heatmap.heat_scale(values, "car_share"), 5, car_share=6)


RUNS = """SELECT {k}, run, min(mode) AS mode, count(*) AS n_points, {first} FROM (SELECT *, sum(fresh) OVER (PARTITION BY {k} ORDER BY {o}) - 1 AS run FROM (SELECT *, CASE WHEN lag(mode) OVER (PARTITION BY {k} ORDER BY {o}) IS NOT DISTINCT FROM mode THEN 0 ELSE 1 END AS fresh FROM {t}) a) b GROUP BY {k}, run"""


@query("SELECT option_id, CAST(run AS BIGINT) AS run, mode, n_points, first_seq FROM (" + RUNS.format(k="option_id", o="seq", t="fx_trace", first="CAST(min(seq) AS INTEGER) AS first_seq") + ") r")
def mode_runs(t: Tables) -> DataFrame:
    return traces.mode_runs(traces.trace_points(t.nested_legs())).drop("meters")


@query("SELECT user_id, CAST(run AS BIGINT) AS run, mode, n_points FROM (" + RUNS.format(k="user_id", o="ts, event_id", t="(SELECT *, event_type AS mode FROM events)", first="min(ts) AS first_seq") + ") r")
def event_runs(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    points = t.base("events").select(F.col("user_id").alias("option_id"), (F.row_number().over(order) - 1).alias("seq"), F.col("event_type").alias("mode"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return traces.mode_runs(points).select(F.col("option_id").alias("user_id"), "run", "mode", "n_points")


def _curve(decided: bool) -> str:
    number = "row_number() OVER (ORDER BY vc_id)"
    base = f"SELECT vc_id, option_id, {number} AS i FROM chosen" if decided else f"SELECT a.vc_id, c.option_id, row_number() OVER (ORDER BY a.vc_id) AS i FROM (SELECT DISTINCT vc_id FROM fx_options) a LEFT JOIN chosen c ON a.vc_id = c.vc_id"
    return f"""WITH {CHOSEN}, p AS ({pairs('(SELECT t.* FROM fx_trace t SEMI JOIN chosen c ON t.option_id = c.option_id)')}), s AS (SELECT option_id, {MEASURE} FROM p GROUP BY option_id), n AS ({base}), total AS (SELECT count(DISTINCT vc_id) // 100 AS s FROM fx_options),
k AS (SELECT i AS step FROM range(0, 100) r(i)), z AS (SELECT k.step, 1 + k.step * total.s AS n_commuters, {SUMS} FROM k CROSS JOIN total LEFT JOIN n ON n.i <= 1 + k.step * total.s LEFT JOIN s ON n.option_id = s.option_id GROUP BY 1, 2)
SELECT step, n_commuters, {share_columns() + ', ' + TRANSIT} FROM z"""


def _convergence(t: Tables, decided: bool) -> DataFrame:
    chosen = _selection(t)
    stats = shares.selected_stats(chosen, t.nested_legs())
    commuters = t.options.select("vc_id").distinct()
    rows = chosen if decided else commuters.join(chosen, "vc_id", "left")
    indexed = shares.numbered(rows, "vc_id").join(stats, "option_id", "left")
    curve = shares.convergence(indexed, commuters.count())
    return rounded(curve.drop(*M8))


@query(_curve(True))
def convergence(t: Tables) -> DataFrame:
    return _convergence(t, True)


@query(_curve(False))
def transit_convergence(t: Tables) -> DataFrame:
    return _convergence(t, False)


@query(f"""WITH {CHOSEN}, p AS ({pairs('(SELECT t.* FROM fx_trace t SEMI JOIN chosen c ON t.option_id = c.option_id)')}), s AS (SELECT option_id, round(sum(CASE WHEN mode = 'walking' THEN m ELSE 0 END), 3) AS w FROM p GROUP BY option_id), e AS (SELECT min(w) AS lo, (max(w) - min(w)) / 100 AS wd FROM s)
SELECT bin, round(lo + bin * wd, 3) AS low, round(lo + (bin + 1) * wd, 3) AS high, count(*) AS n FROM (SELECT CAST(CASE WHEN wd = 0 THEN 0 ELSE least(floor((w - lo) / wd), 99) END AS BIGINT) AS bin, lo, wd FROM s CROSS JOIN e) b GROUP BY bin, lo, wd""")
def walk_histogram(t: Tables) -> DataFrame:
    stats = shares.selected_stats(_selection(t), t.nested_legs()).select(F.round("walk_meters", 3).alias("walk_meters"))
    return rounded(shares.histogram(stats, "walk_meters"), 3)


FIRST = """picked AS (SELECT vc_id, min(opt_ord) AS opt_ord FROM fx_route_nodes GROUP BY vc_id), car AS (SELECT n.* FROM fx_route_nodes n JOIN picked p ON n.vc_id = p.vc_id AND n.opt_ord = p.opt_ord),
hops AS (SELECT *, least(node, after) AS node_lo, greatest(node, after) AS node_hi FROM (SELECT *, lead(node) OVER (PARTITION BY option_id, leg_seq ORDER BY i) AS after FROM car) h WHERE after IS NOT NULL),
used AS (SELECT node_lo, node_hi, count(*) * 0.5e0 AS usage FROM hops GROUP BY 1, 2)"""
LANES = "CASE WHEN coalesce(try_cast(lane AS INTEGER), 0) = 0 THEN 2 ELSE try_cast(lane AS INTEGER) END"
FACTORS = f"factors AS (SELECT u.node_lo, u.node_hi, usage, least(1e0, 1 / CASE WHEN usage = 0 THEN 1 ELSE usage / ({LANES}) END) AS factor FROM used u JOIN fx_edges e ON u.node_lo = e.node_lo AND u.node_hi = e.node_hi)"
DELAYS = """sums AS (SELECT h.vc_id, h.option_id, h.leg_seq, h.departure, h.arrival, sum(coalesce(f.factor, 1) * e.length) / sum(e.length) AS f FROM hops h JOIN fx_edges e ON h.node_lo = e.node_lo AND h.node_hi = e.node_hi LEFT JOIN factors f ON h.node_lo = f.node_lo AND h.node_hi = f.node_hi GROUP BY ALL),
delays AS (SELECT vc_id, option_id, leg_seq, factor, date_diff('second', departure, arrival) / factor - date_diff('second', departure, arrival) AS delay FROM (SELECT s.*, CASE WHEN coalesce(c.moto, 0) <> 0 THEN least(f, 0.7e0) ELSE f END AS factor FROM sums s LEFT JOIN fx_commuters c ON s.vc_id = c.vc_id) x)"""


def _first(t: Tables) -> DataFrame:
    """The first car routes, written once for all that is made of them."""
    return shared_table(congestion.first_car_routes(t.routes()))


def _factors(routes: DataFrame, edges: DataFrame) -> DataFrame:
    return congestion.congestion_factors(congestion.edge_usage(routes, vehicles_per_journey=0.5), edges)


@query(f"WITH {FIRST} SELECT DISTINCT vc_id, option_id, CAST(leg_seq AS BIGINT) AS leg_seq, CAST(count(*) AS INTEGER) AS n_nodes FROM car GROUP BY vc_id, option_id, leg_seq")
def first_car_route(t: Tables) -> DataFrame:
    return congestion.first_car_routes(t.routes()).select("vc_id", "option_id", F.col("leg_seq").cast("long").alias("leg_seq"), F.size("osm_nodes").alias("n_nodes"))


@query(f"WITH {FIRST} SELECT * FROM used")
def edge_usage(t: Tables) -> DataFrame:
    return congestion.edge_usage(congestion.first_car_routes(t.routes()), vehicles_per_journey=0.5)


@query(f"WITH {FIRST}, {FACTORS} SELECT node_lo, node_hi, usage, round(factor, 6) AS factor FROM factors")
def congestion_factor(t: Tables) -> DataFrame:
    return rounded(_factors(_first(t), t.edge_table()))


@query(f"WITH {FIRST}, {FACTORS}, {DELAYS} SELECT vc_id, option_id, CAST(leg_seq AS BIGINT) AS leg_seq, round(factor, 6) AS factor, round(delay, 4) AS delay FROM delays")
def leg_delay(t: Tables) -> DataFrame:
    routes, edges = _first(t), shared_table(t.edge_table())
    return rounded(congestion.leg_delays(routes, edges, _factors(routes, edges), t.commuters).withColumn("leg_seq", F.col("leg_seq").cast("long")), delay=4)


@query(f"WITH {FIRST}, {FACTORS}, {DELAYS} SELECT option_id, round(sum(delay), 3) AS delay FROM delays GROUP BY option_id")
def option_delay(t: Tables) -> DataFrame:
    routes, edges = _first(t), shared_table(t.edge_table())
    return rounded(congestion.option_delays(congestion.leg_delays(routes, edges, _factors(routes, edges), t.commuters)), 3)


def _dated(sql: str) -> str:
    """The SQL of usage, factors and delays with the graph's date in every key."""
    for a, b in (
        ("SELECT *, least(node, after)", "SELECT *, CASE WHEN vc_id % 2 = 0 THEN '2021-01-01' ELSE '2024-01-01' END AS graph_date, least(node, after)"),
        ("used AS (SELECT node_lo, node_hi, count(*) * 0.5e0 AS usage FROM hops GROUP BY 1, 2)", "used AS (SELECT node_lo, node_hi, graph_date, count(*) * 0.5e0 AS usage FROM hops GROUP BY 1, 2, 3)"),
        ("SELECT u.node_lo, u.node_hi, usage", "SELECT u.node_lo, u.node_hi, u.graph_date, usage"),
        ("ON u.node_lo = e.node_lo", "ON u.graph_date = e.graph_date AND u.node_lo = e.node_lo"),
        ("ON h.node_lo = e.node_lo", "ON h.graph_date = e.graph_date AND h.node_lo = e.node_lo"),
        ("ON h.node_lo = f.node_lo", "ON h.graph_date = f.graph_date AND h.node_lo = f.node_lo"),
        ("fx_edges", "fx_dated_edges"),
    ):
        sql = sql.replace(a, b)
    return sql


@query(_dated(f"WITH {FIRST}, {FACTORS} SELECT node_lo, node_hi, graph_date, usage, round(factor, 6) AS factor FROM factors"))
def dated_factor(t: Tables) -> DataFrame:
    """Congestion of each edge of the graphs of two dates, by the routes of the simulations of that date."""
    usage = congestion.edge_usage(congestion.first_car_routes(t.dated_routes()), vehicles_per_journey=0.5)
    return rounded(congestion.congestion_factors(usage, t.dated_edge_table()))


@query(_dated(f"WITH {FIRST}, {FACTORS}, {DELAYS} SELECT option_id, round(sum(delay), 3) AS delay FROM delays GROUP BY option_id"))
def dated_delay(t: Tables) -> DataFrame:
    """Delay of each option on the graph of its simulation's date."""
    routes, edges = shared_table(congestion.first_car_routes(t.dated_routes())), shared_table(t.dated_edge_table())
    return rounded(congestion.option_delays(congestion.leg_delays(routes, edges, _factors(routes, edges), t.commuters)), 3)


@query("""WITH hops AS (SELECT least(node, after) AS node_lo, greatest(node, after) AS node_hi, CASE WHEN vc_id % 2 = 0 THEN '2021-01-01' ELSE '2024-01-01' END AS graph_date FROM (SELECT vc_id, node, lead(node) OVER (PARTITION BY option_id, leg_seq ORDER BY i) AS after FROM fx_route_nodes) h WHERE after IS NOT NULL)
SELECT e.node_lo, e.node_hi, e.graph_date, e.length FROM fx_dated_edges e SEMI JOIN hops h ON e.node_lo = h.node_lo AND e.node_hi = h.node_hi AND e.graph_date = h.graph_date""")
def dated_metadata(t: Tables) -> DataFrame:
    """Metadata of the edges that simulations of either date use, from the graph of that date."""
    used = congestion.used_edges(t.dated_routes().where("osm_nodes is not null"))
    return matching.edge_metadata(used, t.dated_edge_table()).select("node_lo", "node_hi", "graph_date", "length")


CITIZENS = 1000.0


@query(f"""WITH {FIRST}, v AS (SELECT f, {CITIZENS}e0 / (SELECT count(DISTINCT vc_id) FROM fx_route_nodes) * f AS per FROM (VALUES {', '.join(f'({f}e0)' for f in VEHICLE_FACTORS)}) x(f)), counts AS (SELECT node_lo, node_hi, count(*) * 1e0 AS n FROM hops GROUP BY 1, 2),
fx AS (SELECT v.f, c.node_lo, c.node_hi, length, least(1e0, 1 / CASE WHEN n * per / ({LANES}) = 0 THEN 1 ELSE n * per / ({LANES}) END) AS factor FROM counts c JOIN fx_edges e ON c.node_lo = e.node_lo AND c.node_hi = e.node_hi CROSS JOIN v),
sums AS (SELECT fx.f AS vf, h.vc_id, h.option_id, h.leg_seq, h.departure, h.arrival, sum(fx.factor * fx.length) / sum(fx.length) AS m FROM hops h JOIN fx ON h.node_lo = fx.node_lo AND h.node_hi = fx.node_hi GROUP BY ALL),
o AS (SELECT vf, option_id, sum(date_diff('second', departure, arrival) / g - date_diff('second', departure, arrival)) AS delay FROM (SELECT s.*, CASE WHEN coalesce(c.moto, 0) <> 0 THEN least(m, 0.7e0) ELSE m END AS g FROM sums s LEFT JOIN fx_commuters c ON s.vc_id = c.vc_id) y GROUP BY 1, 2)
SELECT vf AS vehicle_factor, CAST(floor(round(delay, 4) / 60) AS BIGINT) AS bin, count(*) AS options FROM o GROUP BY 1, 2""")
def delay_distribution(t: Tables) -> DataFrame:
    routes = _first(t)
    results = routes.select("vc_id").distinct().count()
    return congestion.delay_distribution(routes, t.edge_table(), t.commuters, list(VEHICLE_FACTORS), citizens=CITIZENS, results=results)


@query("SELECT DISTINCT node AS origin, after AS destination, CAST(least(node, after) AS VARCHAR) || '-' || CAST(greatest(node, after) AS VARCHAR) || '-2024-01-01' AS edge_id FROM (SELECT node, lead(node) OVER (PARTITION BY option_id, leg_seq ORDER BY i) AS after FROM fx_route_nodes) p WHERE after IS NOT NULL")
def used_edges(t: Tables) -> DataFrame:
    edges = congestion.used_edges(t.routes().where("osm_nodes is not null"))
    return edges.withColumn("edge_id", predicates.edge_key(F.least("origin", "destination"), F.greatest("origin", "destination"), F.lit("2024-01-01")))


@query("SELECT node_id, round(lon, 6) AS lon, round(lat, 6) AS lat, CAST(node_id AS VARCHAR) || '-2024-01-01' AS node_key FROM fx_graph_nodes WHERE node_id IN (SELECT node FROM fx_route_nodes)")
def used_nodes(t: Tables) -> DataFrame:
    edges = congestion.used_edges(t.routes().where("osm_nodes is not null"))
    return rounded(congestion.used_nodes(edges, t.graph_nodes, "origin", "destination")).withColumn("node_key", predicates.node_key(F.col("node_id"), F.lit("2024-01-01")))


@query("SELECT vc_id, olon IS NOT NULL AND dlon IS NOT NULL AS routable, greatest(coalesce(car, 0), coalesce(moto, 0), coalesce(utilities, 0)) > 0 AS has_vehicle, coalesce(moto, 0) <> 0 AS has_moto, usage IS NOT NULL AS would_use, TIMESTAMP '2024-05-01 08:00:00' AS departure FROM fx_commuters")
def routable(t: Tables) -> DataFrame:
    rows = t.commuters.withColumn("origin", F.struct(F.col("olon").alias("lon"), F.col("olat").alias("lat"))).withColumn("destination", F.struct(F.col("dlon").alias("lon"), F.col("dlat").alias("lat")))
    return rows.select("vc_id", predicates.should_route().alias("routable"), predicates.has_motor_vehicle("car", "moto", "utilities").alias("has_vehicle"), predicates.has_motorcycle().alias("has_moto"), F.col("usage").isNotNull().alias("would_use"), predicates.departure_of(F.lit("2024-05-01")).cast("timestamp_ntz").alias("departure"))


@query("WITH n AS (SELECT * FROM fx_commuters WHERE dlon IS NOT NULL ORDER BY vc_id LIMIT 2000) SELECT vc_id, 'home' AS category, round(olon, 6) AS lon, round(olat, 6) AS lat FROM n UNION ALL SELECT vc_id, CASE WHEN age = 'between_20_64' THEN 'work' ELSE 'none' END, round(dlon, 6), round(dlat, 6) FROM n")
def od_points(t: Tables) -> DataFrame:
    rows = t.commuters.withColumn("origin", F.struct(F.col("olon").alias("lon"), F.col("olat").alias("lat"))).withColumn("destination", F.struct(F.col("dlon").alias("lon"), F.col("dlat").alias("lat")))
    first = shares.first_commuters(rows.where(predicates.should_route()), 2000)
    ends = F.array(F.struct(F.lit("home").alias("category"), F.col("origin.lon").alias("lon"), F.col("origin.lat").alias("lat")), F.struct(F.when(F.col("age") == "between_20_64", "work").otherwise("none").alias("category"), F.col("destination.lon").alias("lon"), F.col("destination.lat").alias("lat")))
    return rounded(first.select("vc_id", F.explode(ends).alias("e")).select("vc_id", "e.*"))


def _loop_sql(rounds: int, mix: float, start: float) -> str:
    """The loop's rounds one after the other; a round that changes no choice is the last one."""
    late = lambda k: DELAYS.replace("sums AS", f"sums{k} AS").replace("delays AS", f"delays{k} AS").replace("FROM sums s", f"FROM sums{k} s").replace("JOIN factors f", f"JOIN factors{k} f")
    factors = lambda k: FACTORS.replace("factors AS", f"factors{k} AS").replace("FROM used u", f"FROM used{k} u")
    parts = [
        "hops AS MATERIALIZED (SELECT *, least(node, after) AS node_lo, greatest(node, after) AS node_hi FROM (SELECT *, lead(node) OVER (PARTITION BY option_id, leg_seq ORDER BY i) AS after FROM fx_route_nodes) h WHERE after IS NOT NULL)",
        "plain AS MATERIALIZED (SELECT o.vc_id, o.option_id, o.opt_ord, f.duration FROM fx_options o LEFT JOIN fx_facts f ON o.option_id = f.option_id JOIN fx_commuters c ON o.vc_id = c.vc_id WHERE c.usage IS NOT NULL OR NOT coalesce(f.has_car, false))",
        f"used0 AS (SELECT node_lo, node_hi, count(*) * 0.5e0 AS usage FROM hops h JOIN (SELECT vc_id, min(opt_ord) AS opt_ord FROM fx_route_nodes GROUP BY vc_id) p ON h.vc_id = p.vc_id AND h.opt_ord = p.opt_ord WHERE h.vc_id IN (SELECT vc_id FROM fx_draws WHERE u25 < {start}) GROUP BY 1, 2)",
        factors(0), late(0),
        f"late0 AS MATERIALIZED (SELECT o.option_id, {'coalesce(n.delay, 0e0)' if start else '0e0'} AS delay FROM fx_options o LEFT JOIN (SELECT option_id, sum(delay) AS delay FROM delays0 GROUP BY option_id) n ON o.option_id = n.option_id)",
    ]
    for k in range(1, rounds + 1):
        parts += [
            f"chosen{k} AS MATERIALIZED (SELECT o.vc_id, arg_min(o.option_id, (coalesce(o.duration + coalesce(d.delay, 0), 0), o.opt_ord)) AS option_id FROM plain o LEFT JOIN late{k - 1} d ON o.option_id = d.option_id GROUP BY o.vc_id)",
            f"used{k} AS (SELECT node_lo, node_hi, count(*) * 0.5e0 AS usage FROM hops WHERE option_id IN (SELECT option_id FROM chosen{k}) GROUP BY 1, 2)",
            factors(k),
            late(k),
            f"late{k} AS MATERIALIZED (SELECT o.option_id, {1 - mix}e0 * o.delay + {mix}e0 * coalesce(n.delay, 0) AS delay FROM late{k - 1} o LEFT JOIN (SELECT option_id, sum(delay) AS delay FROM delays{k} GROUP BY option_id) n ON o.option_id = n.option_id)",
        ]
    same = " ".join(f"WHEN NOT EXISTS (SELECT * FROM chosen{k} EXCEPT SELECT * FROM chosen{k - 1}) THEN {k}" for k in range(2, rounds + 1))
    ends = [(k, k - 1) for k in range(2, rounds + 1)] + [(0, rounds)]
    parts.append(f"last AS (SELECT CASE {same} ELSE 0 END AS k)")
    rows = " UNION ALL ".join(f"SELECT {k or rounds} AS round, c.option_id, c.vc_id, round(d.delay, 3) AS delay FROM chosen{k or rounds} c LEFT JOIN late{d} d ON c.option_id = d.option_id WHERE (SELECT k FROM last) = {k}" for k, d in ends)
    return f"WITH {', '.join(parts)} {rows}"


def _loop(t: Tables, **options) -> DataFrame:
    routes = t.routes().where("osm_nodes is not null")
    return rounded(feedback.congestion_loop(t.options, choice.option_facts(t.legs), _commuters(t), routes, t.edge_table(), vehicles_per_journey=0.5, **options), delay=3)


@query(_loop_sql(4, 0.1, 0.0))
def congestion_loop(t: Tables) -> DataFrame:
    return _loop(t, rounds=4)


@query(_loop_sql(20, 0.25, 0.5))
def congestion_feedback(t: Tables) -> DataFrame:
    """Twenty rounds at most, from half of the commuters on their first car route."""
    return _loop(t, rounds=20, mix=0.25, start=0.5)
