"""Bindings of the library's input tables to the given ones, as SQL that Spark and DuckDB evaluate alike.

``ctes(engine)`` gives the tables by name; where the engines' SQL differs (adding seconds, number series), the text is
made for the engine. Arithmetic is on doubles throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowatlas.functions import draws

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: The clip polygon of the queries.
RING = [(5.42, 51.42), (5.53, 51.43), (5.50, 51.46), (5.54, 51.49), (5.45, 51.50), (5.41, 51.46)]
#: Target dates of link queries, vehicle factors of delay distributions, place of the flow matrix.
TARGETS = ("1994-01-15", "1995-06-30", "1996-12-31", "1997-07-01", "1998-03-15")
VEHICLE_FACTORS = (0.5, 1.0, 2.0)


def ctes(engine: str) -> dict[str, str]:
    spark = engine == "spark"
    plus = (lambda ts, n: f"timestampadd(SECOND, CAST({n} AS INT), {ts})") if spark else (lambda ts, n: f"({ts} + to_seconds(CAST({n} AS BIGINT)))")
    series = (lambda n, i="i": f"LATERAL VIEW explode(sequence(0, CAST({n} AS INT))) s_{i} AS {i}") if spark else (lambda n, i="i": f", unnest(range(0, CAST({n} AS INT) + 1)) AS s_{i}({i})")
    shift = (lambda x, n: f"shiftright({x}, {n}) ^ {x}") if spark else (lambda x, n: f"xor({x} >> {n}, {x})")
    between = (lambda a, b: f"timestampdiff(SECOND, {a}, {b})") if spark else (lambda a, b: f"date_diff('second', {a}, {b})")
    big = "BIGINT"

    def uniform(key: str, salt: int, seed: int = 0) -> str:
        k, c, full = f"CAST({key} AS {big})", (salt * 40503 + seed * 69069) % 2**32, 2**32
        high = f"(shiftright({k}, 32) & {full - 1})" if spark else f"(({k} >> 32) & {full - 1})"
        x = f"((({k} & {full - 1}) * {draws.LOW} + {c}) % {full})"
        for step in range(4):
            x = f"(({shift(x, 16)}) * {draws.MIX} % {full})"
            if step == 1:
                x = f"(({x} + {high} * {draws.HIGH}) % {full})"
        return f"(({shift(x, 16)}) / 4.294967296e9)"

    codes = ", ".join(f"({i}, '{c}')" for i, c in enumerate(("Y_LT5", "Y5-9", "Y10-14", "Y15-19", "Y20-24", "Y25-29", "Y30-34", "Y35-39", "Y40-44", "Y45-49", "Y50-54", "Y55-59", "Y60-64", "Y65-69", "Y70-74", "Y75-79", "Y80-84", "Y85-89", "Y_GE90")))
    sectors = ", ".join(f"({i}, '{c}')" for i, c in enumerate(("A", "B-E", "F", "G-I", "J", "K", "L", "M_N", "O-Q", "R-U")))
    kinds = ", ".join(f"({i}, '{c}')" for i, c in enumerate(("CAR", "MOTO", "SPE", "BUS_TOT", "LOR", "TRC", "UTL", "TOT_X_TM")))
    nuts3 = "'EU1' || CAST(n_regionkey AS STRING) || CAST(CAST(floor(n_nationkey / 5) AS INT) AS STRING)" if spark else "'EU1' || n_regionkey || CAST(floor(n_nationkey / 5) AS INT)"
    text = "STRING" if spark else "VARCHAR"
    return {
        "fx_commuters": f"""SELECT c_custkey AS vc_id,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'car' WHEN c_mktsegment = 'MACHINERY' THEN 'utilities' WHEN c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0 THEN 'moto' END AS usage,
  CASE WHEN c_acctbal > 8000 THEN 2 WHEN c_acctbal > 3000 THEN 1 END AS car, CASE WHEN c_custkey % 7 = 0 THEN 1 END AS moto, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END AS utilities,
  CASE WHEN c_custkey % 10 <= 1 THEN 'under_20' WHEN c_custkey % 10 <= 7 THEN 'between_20_64' ELSE 'over_64' END AS age, {nuts3} AS region,
  5.40e0 + (c_custkey % 97) * 0.0015e0 AS olon, 51.40e0 + (c_custkey % 89) * 0.0012e0 AS olat,
  CASE WHEN c_custkey % 17 <> 0 THEN 5.40e0 + (c_custkey % 71) * 0.0015e0 END AS dlon, CASE WHEN c_custkey % 17 <> 0 THEN 51.40e0 + (c_custkey % 83) * 0.0012e0 END AS dlat
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
        "fx_options": "SELECT o_orderkey AS option_id, o_custkey AS vc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS opt_ord, o_orderdate AS departure FROM orders",
        "fx_legs": f"""SELECT option_id, leg_seq, mode, departure, {plus('departure', '60 + 12 * quantity')} AS arrival, departure_delay, departure_delay + CAST(sk % 60 AS INT) AS arrival_delay, operator, pk, sk, n_last
FROM (SELECT l.option_id, l.leg_seq, CASE (l.pk + l.sk) % 7 WHEN 0 THEN 'walking' WHEN 1 THEN 'walking' WHEN 2 THEN 'car' WHEN 3 THEN 'bus' WHEN 4 THEN 'train' WHEN 5 THEN 'gondola' ELSE 'bicycle' END AS mode,
  {plus('o_orderdate', 'leg_seq * 900')} AS departure, l.quantity, CASE WHEN l.pk % 4 = 0 THEN CAST(round(l.tax * 1000) AS INT) END AS departure_delay, n_name AS operator, l.pk, l.sk,
  CASE WHEN l.pk % 5 = 0 THEN 1 ELSE 1 + l.pk % 3 END AS n_last
  FROM (SELECT l_orderkey AS option_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS leg_seq, l_partkey AS pk, l_suppkey AS sk, l_quantity AS quantity, l_tax AS tax FROM lineitem) l
  JOIN orders ON l.option_id = o_orderkey JOIN supplier ON l.sk = s_suppkey JOIN nation ON s_nationkey = n_nationkey) x""",
        "fx_stops": f"""SELECT option_id, leg_seq, mode, i AS idx, 5.40e0 + ((pk * 7 + sk * 3 + i * 11) % 160) * 0.001e0 AS lon, 51.40e0 + ((pk * 5 + sk * 11 + i * 7) % 110) * 0.001e0 AS lat,
  CASE WHEN pk % 5 = 0 AND i = 1 THEN arrival WHEN pk % 5 = 0 THEN departure ELSE {plus('departure', 'i * 30')} END AS ts, (i = 0 AND sk % 13 = 0 AND pk % 5 <> 0) AS unlocated
FROM fx_legs {series('n_last')}""",
        "fx_trace": "SELECT option_id, row_number() OVER (PARTITION BY option_id ORDER BY leg_seq, idx) - 1 AS seq, lon, lat, ts, mode, idx = 0 AS is_leg_start FROM fx_stops WHERE NOT unlocated",
        "fx_facts": f"""SELECT option_id, bool_or(mode = 'car') AS has_car, CAST({between('min_by(departure, leg_seq)', 'max_by(arrival, leg_seq)')} + coalesce(max(CASE WHEN leg_seq = last_leg THEN arrival_delay END), 0) - coalesce(max(CASE WHEN leg_seq = 0 THEN departure_delay END), 0) AS BIGINT) AS duration
FROM (SELECT *, max(leg_seq) OVER (PARTITION BY option_id) AS last_leg FROM fx_legs) x GROUP BY option_id""",
        "fx_route_nodes": f"SELECT vc_id, option_id, opt_ord, leg_seq, departure, arrival, i, (pk * 13 + i * (1 + sk % 3) * 17) % 600 AS node FROM (SELECT l.*, o.vc_id, o.opt_ord FROM fx_legs l JOIN fx_options o ON l.option_id = o.option_id WHERE mode = 'car' AND pk % 9 <> 0) x {series('4 + pk % 4')}",
        "fx_edges": f"""SELECT lo AS node_lo, hi AS node_hi, 50e0 + (lo * 31 + hi * 17) % 400 AS length, CASE (lo + hi) % 6 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN 'x' WHEN 3 THEN '1' WHEN 4 THEN '2' ELSE '3' END AS lane
FROM (SELECT DISTINCT least(node, after) AS lo, greatest(node, after) AS hi FROM (SELECT node, lead(node) OVER (PARTITION BY option_id, leg_seq ORDER BY i) AS after FROM fx_route_nodes) p WHERE after IS NOT NULL) q""",
        # graphs of two dates: some edges longer, some of other lanes, some gone; simulations of either date
        "fx_dated_edges": "SELECT node_lo, node_hi, d AS graph_date, CASE WHEN d = '2024-01-01' AND node_lo % 3 = 0 THEN length * 2 ELSE length END AS length, CASE WHEN d = '2024-01-01' AND node_hi % 4 = 0 THEN '1' ELSE lane END AS lane FROM fx_edges CROSS JOIN (VALUES ('2021-01-01'), ('2024-01-01')) AS v(d) WHERE d = '2021-01-01' OR (node_lo + node_hi) % 17 <> 0",
        "fx_age": f"SELECT {nuts3} || CAST(n_nationkey % 2 AS {text}) AS geo, age, CAST(1000 + (n_nationkey * 37 + no * 101) % 5000 AS DOUBLE) AS value, 2020 + n_nationkey % 3 AS year FROM nation CROSS JOIN (VALUES {codes}) AS c(no, age) WHERE (n_nationkey + no) % 29 <> 0",
        "fx_sector": f"SELECT {nuts3} || CAST(n_nationkey % 2 AS {text}) AS geo, sector, CAST(1000 + (n_nationkey * 37 + no * 101) % 5000 AS DOUBLE) AS value, n_nationkey FROM nation CROSS JOIN (VALUES {sectors}) AS c(no, sector) WHERE (n_nationkey + no) % 29 <> 0",
        "fx_vehicle": f"SELECT {nuts3} AS geo, vehicle, CAST(1000 + (n_nationkey * 37 + no * 101) % 5000 AS DOUBLE) AS value FROM nation CROSS JOIN (VALUES {kinds}) AS c(no, vehicle) WHERE (n_nationkey + no) % 29 <> 0 UNION ALL SELECT {nuts3}, 'CAR', 3e0 FROM nation WHERE n_nationkey % 4 = 0",
        "fx_income": f"SELECT {nuts3} AS geo, c_acctbal AS value, 2018 + CAST(c_custkey % 5 AS INT) AS year FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "fx_tiles": f"""SELECT p_partkey AS cell, CASE WHEN p_size % 11 <> 0 THEN p_retailprice * p_size END AS population, p_size / 50e0 AS building_density,
  CAST((p_partkey * 3) % 1000 AS DOUBLE) AS work_agricultural, CAST((p_partkey * 7) % 1000 AS DOUBLE) AS work_industrial, CAST((p_partkey * 11) % 1000 AS DOUBLE) AS work_commercial, CAST((p_partkey * 13) % 1000 AS DOUBLE) AS work_office, CAST((p_partkey * 17) % 1000 AS DOUBLE) AS work_social,
  CAST((p_partkey * 19) % 1000 AS DOUBLE) AS education, CAST((p_partkey * 23) % 1000 AS DOUBLE) AS leisure, region, p_size * 1000e0 AS buildings_1, p_size * 500e0 AS buildings_2, p_size * 300e0 AS no_parking, 737327.6e0 AS tile_area,
  (p_partkey % 3 = 0) AS in_b
FROM part JOIN (SELECT n_nationkey AS k, {nuts3} AS region FROM nation) r ON p_partkey % 25 = k""",
        "fx_features": f"""SELECT p_partkey AS feature_id, CASE p_partkey % 4 WHEN 0 THEN 'Point' WHEN 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type, p_size,
  CASE WHEN p_partkey % 3 = 0 THEN CASE p_partkey % 7 WHEN 0 THEN 'retail' WHEN 1 THEN 'farmyard' WHEN 2 THEN 'industrial' WHEN 3 THEN 'education' WHEN 4 THEN 'forest' WHEN 5 THEN 'construction' ELSE 'religious' END END AS landuse,
  CASE WHEN p_partkey % 5 = 0 THEN 'yes' END AS office, CASE WHEN p_partkey % 6 = 1 THEN 'school' WHEN p_partkey % 6 = 2 THEN 'restaurant' END AS amenity, CASE WHEN p_partkey % 8 = 3 THEN 'hotel' WHEN p_partkey % 8 = 5 THEN 'yes' END AS building, CASE WHEN p_partkey % 10 = 4 THEN 'water' END AS natural_,
  CASE WHEN p_partkey % 11 = 3 THEN 'bakery' END AS shop, CASE WHEN p_partkey % 13 = 5 THEN 'clinic' END AS healthcare, CASE WHEN p_partkey % 9 = 7 THEN 'park' END AS leisure, CASE WHEN p_partkey % 14 = 9 THEN 'tennis' END AS sport, CASE WHEN p_partkey % 16 = 6 THEN 'museum' END AS tourism,
  524000e0 + (p_partkey * 7 % 160) * 100e0 AS x, 5710000e0 + (p_partkey * 5 % 110) * 120e0 AS y
FROM part""",
        # places of two parts, each with a hole; the parts of some overlap
        "fx_place_vertices": f"""SELECT n_name AS place_id, part, ring, i, 5.41e0 + (n_nationkey * 37 % 140) * 0.001e0 + part * 0.03e0 + radius * cos(i * 0.39269908169872414e0 + 0.1e0) AS x, 51.41e0 + (n_nationkey * 53 % 90) * 0.001e0 - part * 0.02e0 + radius * sin(i * 0.39269908169872414e0 + 0.1e0) AS y
FROM (SELECT *, (0.012e0 + 0.002e0 * (n_nationkey % 7)) * (1e0 + 0.08e0 * ((i * 7 + n_nationkey) % 5)) * (1e0 - 0.6e0 * ring) AS radius FROM nation CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS r(part, ring) {series(15)}) v""",
        "fx_links": f"SELECT o_custkey % 200 AS place, o_custkey % 40 AS provider, o_orderdate AS date, o_orderkey AS ord, 'L' || CAST(o_orderkey AS {text}) AS link FROM orders",
        "fx_targets": "SELECT CAST(t AS DATE) AS target FROM (VALUES " + ", ".join(f"('{t}')" for t in TARGETS) + ") AS v(t)",
        "fx_stops_gtfs": f"SELECT CAST(s_suppkey AS {text}) AS stop_id FROM supplier WHERE s_suppkey % 7 <> 3",
        "fx_trips": f"SELECT CAST(o_orderkey AS {text}) AS trip_id FROM orders WHERE o_orderkey % 5 <> 2",
        "fx_routes_gtfs": f"SELECT CAST(p_partkey AS {text}) AS route_id FROM part WHERE p_partkey % 9 <> 4",
        "fx_transfers": f"""SELECT CAST(sk AS {text}) AS from_stop_id, CAST(coalesce(lag(sk) OVER (PARTITION BY option_id ORDER BY leg_seq), sk) AS {text}) AS to_stop_id, CASE WHEN pk % 3 <> 0 THEN CAST(option_id AS {text}) END AS from_trip_id, CASE WHEN sk % 4 <> 0 THEN CAST(pk AS {text}) END AS to_route_id FROM fx_legs""",
        "fx_delay_rows": f"""SELECT n_name AS operator, CAST(bin * 5 AS {text}) || '–' AS label, CASE WHEN (n_nationkey + bin) % 13 <> 0 THEN CAST(1 + (n_nationkey * 7 + bin * 3) % 20 AS {text}) || '%' END AS percent FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT 25, 'average') n {series(7, 'bin')}
UNION ALL SELECT n_name, 'cancelled', CAST(1 + n_nationkey % 4 AS {text}) || '%' FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT 25, 'average') n UNION ALL SELECT n_name, 'substituted', '2%' FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT 25, 'average') n""",
        "fx_leg_keys": "SELECT option_id, leg_seq, option_id * 16 + leg_seq AS leg_key, mode, departure, arrival, operator FROM fx_legs",
        "fx_u_bin": f"SELECT option_id, leg_seq, leg_key, mode, departure, arrival, operator, {uniform('leg_key', 20)} AS u0, {uniform('leg_key', 21)} AS u1, {uniform('leg_key', 22)} AS u2 FROM fx_leg_keys",
        "fx_draws": "SELECT c_custkey AS vc_id, " + ", ".join(f"{uniform('c_custkey', k)} AS u{k}" for k in (1, 2, 3, 4, 5, 6, 7, 8, 12, 13, 14, 15, 16, 17, 18, 19, 23, 24, 25)) + " FROM customer",
        "fx_seeded": "SELECT c_custkey AS vc_id, " + ", ".join(f"{uniform('c_custkey', k, 1)} AS u{k}" for k in range(1, 18)) + " FROM customer",
        # keys from all over the 64 bits, of either sign
        "fx_wide_draws": f"SELECT order_key, wide_key, {uniform('wide_key', 3, 11)} AS u FROM (SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * ((o_orderkey * 7919 % 2147483647) * 4294967296 + o_custkey * 31337) AS wide_key FROM orders) k",
        "fx_roads": "SELECT option_id AS road_id, leg_seq AS idx, lon, lat FROM fx_stops WHERE idx = 0",
        # the whole globe: nodes at both poles and on either side of the antimeridian, points everywhere
        "fx_globe_nodes": "SELECT s_suppkey AS node_id, CASE WHEN s_suppkey % 3 = 0 THEN (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END) * (179e0 + (s_suppkey * 37 % 100) * 0.01e0) ELSE (s_suppkey * 7919 % 36000) * 0.01e0 - 180e0 END AS lon, CASE WHEN s_suppkey % 10 = 1 THEN 89e0 + (s_suppkey % 7) * 0.1e0 WHEN s_suppkey % 10 = 2 THEN -89e0 - (s_suppkey % 7) * 0.1e0 ELSE (s_suppkey * 104729 % 16000) * 0.01e0 - 80e0 END AS lat FROM supplier",
        "fx_globe_points": "SELECT c_custkey AS point_id, CASE WHEN c_custkey % 4 = 0 THEN (CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE -1 END) * (179.5e0 + (c_custkey * 31 % 50) * 0.01e0) ELSE (c_custkey * 7907 % 36000) * 0.01e0 - 180e0 END AS lon, CASE WHEN c_custkey % 9 = 0 THEN 88.5e0 + (c_custkey % 15) * 0.1e0 WHEN c_custkey % 9 = 1 THEN -88.5e0 - (c_custkey % 15) * 0.1e0 ELSE (c_custkey * 104723 % 17000) * 0.01e0 - 85e0 END AS lat FROM customer",
        "fx_graph_nodes": f"SELECT CAST(i AS BIGINT) AS node_id, 5.40e0 + (i % 30) * 0.005e0 AS lon, 51.40e0 + floor(i / 30) * 0.005e0 AS lat FROM (SELECT 1 AS one) o {series(599)}",
        "fx_graph": "SELECT node_lo, node_hi, 300e0 + (node_lo * 37 + node_hi * 11) % 200 AS length FROM (SELECT node_id AS node_lo, node_id + 1 AS node_hi FROM fx_graph_nodes WHERE node_id % 30 < 29 UNION ALL SELECT node_id, node_id + 30 FROM fx_graph_nodes WHERE node_id < 570) e",
    }


def with_ctes(engine: str, body: str) -> str:
    """``body`` behind a WITH of the tables it names, directly or through others."""
    tables = ctes(engine)
    needed: list[str] = []

    def need(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", sql)):
            if name in tables and name not in needed:
                need(tables[name])
                needed.append(name)

    need(body)
    if not needed:
        return body
    head = ", ".join(f"{n} AS ({tables[n]})" for n in needed)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?(.*)", body, re.S)
    return f"WITH {m[1] or ''}{head}, {m[2]}" if m else f"WITH {head} {body}"


class Tables:
    """The bound tables of a folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        sql = with_ctes("spark", f"SELECT * FROM fx_{name}")
        used = [b for b in BASE if re.search(rf"\b(FROM|JOIN) {b}\b", sql)]
        for b in used:
            sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
        return self.spark.sql(sql, **{b: self.base(b) for b in used})

    def nested_legs(self) -> DataFrame:
        """Legs with origin, destination and stopovers as nested columns."""
        i = lambda k: (5.40 + ((F.col("pk") * 7 + F.col("sk") * 3 + k * 11) % 160) * 0.001)
        j = lambda k: (51.40 + ((F.col("pk") * 5 + F.col("sk") * 11 + k * 7) % 110) * 0.001)
        at = lambda k: F.struct(i(k).alias("lon"), j(k).alias("lat"))
        gone = lambda k: (k == 0) & (F.col("sk") % 13 == 0)
        stop = lambda k: F.struct(F.when(~gone(k), i(k)).alias("lon"), F.when(~gone(k), j(k)).alias("lat"), F.lit(None).cast("timestamp_ntz").alias("arrival"), F.timestamp_add("SECOND", (k * 30).cast("int"), F.col("departure")).alias("departure"))
        stops = F.when(F.col("pk") % 5 != 0, F.transform(F.sequence(F.lit(0), F.col("n_last").cast("int")), stop))
        return self.legs.select("option_id", "leg_seq", "mode", "departure", "arrival", "departure_delay", "arrival_delay", "operator", "pk", "sk", at(F.lit(0)).alias("origin"), at(F.col("n_last")).alias("destination"), stops.alias("stopovers"))

    def routes(self) -> DataFrame:
        """Car legs with their matched nodes; legs of every ninth part key aren't matched."""
        nodes = F.transform(F.sequence(F.lit(0), (4 + F.col("pk") % 4).cast("int")), lambda k: (F.col("pk") * 13 + k * (1 + F.col("sk") % 3) * 17) % 600)
        legs = self.legs.where("mode = 'car'").select("option_id", "leg_seq", "departure", "arrival", F.when(F.col("pk") % 9 != 0, nodes).alias("osm_nodes"))
        return legs.join(self.options.select("option_id", "vc_id", F.col("opt_ord").alias("option_ord")), "option_id").withColumn("itinerary_ord", F.lit(0))

    def dated_routes(self) -> DataFrame:
        """Routes with the date of their commuter's simulation."""
        return self.routes().withColumn("graph_date", F.when(F.col("vc_id") % 2 == 0, "2021-01-01").otherwise("2024-01-01"))

    def dated_edge_table(self) -> DataFrame:
        return self.dated_edges.select("node_lo", "node_hi", "graph_date", "length", F.when(F.col("lane").isNotNull(), F.array("lane")).alias("lanes"))

    def edge_table(self) -> DataFrame:
        return self.edges.select("node_lo", "node_hi", "length", F.when(F.col("lane").isNotNull(), F.array("lane")).alias("lanes"))
