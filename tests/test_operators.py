"""Literal cases of the quirks, properties, and round trips."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowatlas.functions import clipping, geo
from flowatlas.functions.draws import uniform
from flowatlas.functions.polyline import decode, decode_polyline, encode
from flowatlas.operators import choice, congestion, delays, feeds, heatmap, matching, sampling, shares, tiles, traces
from flowatlas.sources import journeys, store, tables

POINTS = "option_id int, seq int, lon double, lat double, mode string, is_leg_start boolean"


def points(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], POINTS)


def test_passengers_count_only_at_leg_starts_and_gondola_is_rail(spark):
    rows = [(0.0, 0.0, "gondola", True), (0.0, 1.0, "gondola", False), (0.0, 2.0, "gondola", False), (0.0, 2.0, "bicycle", True), (0.0, 3.0, "bicycle", False)]
    r = traces.trace_stats(points(spark, rows)).first()
    assert r.rail_passengers == 1 and r.car_passengers == 0
    assert r.rail_meters == pytest.approx(2 * math.pi * 6371000 / 180, rel=1e-9)
    assert r.walk_meters == 0


def test_shares_are_products_of_sums_and_zero_without_travel(spark):
    schema = ", ".join(f"{m} double" for m in traces.MEASURES)
    rows = spark.createDataFrame([(100.0, 0.0, 50.0, 0.0, 2.0, 0.0, 4.0, 1.0), (0.0,) * 8], schema)
    a, b = traces.modal_shares(rows).select("car_share", "bus_share").collect()
    assert (a.car_share, a.bus_share) == (0.5, 0.5) and (b.car_share, b.bus_share) == (0.0, 0.0)


def carry_loop(rows, inside):
    out, carry = [], False
    for i, (lon, lat, mode, start) in enumerate(rows):
        if inside(lon):
            out.append((i, start or carry))
            carry = False
        elif start:
            carry = True
    return out


def test_leg_start_is_carried_like_the_loop(spark):
    dice = random.Random(3)
    rows = [(dice.random(), 0.0, "bus", dice.random() < 0.3) for _ in range(300)]
    found = traces.with_carry(points(spark, rows), F.col("lon") < 0.4).select("seq", "is_leg_start").orderBy("seq").collect()
    assert [tuple(r) for r in found] == carry_loop(rows, lambda x: x < 0.4)


def test_clipping_by_everything_is_the_identity(spark):
    rows = [(0.1 * i, 0.0, "bus", i % 3 == 0) for i in range(10)]
    p = points(spark, rows)
    assert sorted(traces.with_carry(p, F.lit(True)).collect()) == sorted(p.collect())


def test_mode_runs_and_lines(spark):
    rows = [(0.0, 0.0, "bus", True), (0.0, 1.0, "bus", False), (0.0, 1.0, "car", True), (0.0, 2.0, "bus", True)]
    runs = traces.mode_runs(points(spark, rows)).orderBy("run").collect()
    assert [(r.mode, r.n_points) for r in runs] == [("bus", 2), ("car", 1), ("bus", 1)]
    assert [len(r.line) for r in traces.lines_by_mode(points(spark, rows)).orderBy("run").collect()] == [2, 1, 1]


def test_null_duration_wins_unless_dropped(spark):
    options = spark.createDataFrame([(1, 10, 1), (2, 10, 2)], "option_id int, vc_id int, opt_ord int")
    facts = spark.createDataFrame([(1, False, 50), (2, False, None)], "option_id int, has_car boolean, duration long")
    people = spark.createDataFrame([(10, None, False)], "vc_id int, usage string, has_vehicle boolean")
    assert choice.decide(options, facts, people).first().option_id == 2
    assert choice.decide(options, facts, people, null_duration="drop").first().option_id == 1


def test_no_choice_without_a_car_free_option(spark):
    options = spark.createDataFrame([(1, 10, 1)], "option_id int, vc_id int, opt_ord int")
    facts = spark.createDataFrame([(1, True, 50)], "option_id int, has_car boolean, duration long")
    people = spark.createDataFrame([(10, None, True)], "vc_id int, usage string, has_vehicle boolean")
    assert choice.decide(options, facts, people).count() == 0
    assert choice.decide(options, facts, people, use=1.0).count() == 1


def test_polyline_of_one_point_and_unlocated_first_stop(spark):
    schema = "option_id int, leg_seq int, mode string, departure timestamp_ntz, arrival timestamp_ntz, origin struct<lon:double,lat:double>, destination struct<lon:double,lat:double>, stopovers array<struct<lon:double,lat:double,arrival:timestamp_ntz,departure:timestamp_ntz>>, polyline array<struct<lon:double,lat:double>>"
    import datetime as dt

    a, b = dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 9)
    legs = spark.createDataFrame([(1, 0, "bus", a, b, (0.0, 0.0), (1.0, 1.0), None, [(5.0, 6.0)]), (1, 1, "bus", a, b, (0.0, 0.0), (1.0, 1.0), [(None, None, None, a), (2.0, 2.0, b, None)], None), (1, 2, "car", a, b, (0.0, 0.0), (None, 1.0), None, None)], schema.replace("timestamp_ntz", "timestamp"))
    legs = legs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("departure", "arrival")})
    rows = traces.trace_points(legs.withColumn("departure_delay", F.lit(None).cast("int")).withColumn("arrival_delay", F.lit(None).cast("int")).withColumn("stopovers", F.expr("transform(stopovers, s -> named_struct('lon', s.lon, 'lat', s.lat, 'arrival', cast(s.arrival as timestamp_ntz), 'departure', cast(s.departure as timestamp_ntz)))"))).orderBy("seq").collect()
    assert [(r.lon, r.is_leg_start) for r in rows] == [(5.0, True), (2.0, False)]
    assert rows[1].ts == b


def test_lanes_and_factor(spark):
    usage = spark.createDataFrame([(i, i + 1, 4.0) for i in range(5)], "node_lo int, node_hi int, usage double")
    edges = spark.createDataFrame([(0, 1, None, 10.0), (1, 2, ["0"], 10.0), (2, 3, ["x"], 10.0), (3, 4, ["8", "1"], 10.0)], "node_lo int, node_hi int, lanes array<string>, length double")
    found = {r.node_lo: r.factor for r in congestion.congestion_factors(usage, edges).collect()}
    assert found == {0: 0.5, 1: 0.5, 2: 0.5, 3: 1.0}
    assert congestion.missing_edges(usage, edges).count() == 1


def test_heat_scale_of_equal_values(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0)], "cell int, v double")
    assert {(r.by_max, r.by_range) for r in heatmap.heat_scale(rows, "v").collect()} == {(1.0, 0.0)}


def test_convergence_with_few_commuters_stays_at_the_first(spark):
    stats = spark.createDataFrame([(i, 1.0, 0.0, 0.0, 1.0, i % 2, 0, 0, 1) for i in range(1, 6)], "index long, " + ", ".join(f"{m} {'double' if 'meters' in m else 'long'}" for m in traces.MEASURES))
    curve = shares.convergence(stats, 5).collect()
    assert len(curve) == 100 and {r.n_commuters for r in curve} == {1} and len({r.car_share for r in curve}) == 1


def test_cells(spark):
    dice = random.Random(1)
    rows = spark.createDataFrame([(dice.uniform(-170, 170), dice.uniform(-80, 80)) for _ in range(500)], "lon double, lat double")
    x, y = geo.project_x(F.col("lon")), geo.project_y(F.col("lat"))
    cell = geo.cell_of(F.col("lon"), F.col("lat"))
    found = rows.select(cell.alias("c"), F.hypot(geo.centre_x(cell) - x, geo.centre_y(cell) - y).alias("d"), geo.cell_of_plane(geo.centre_x(cell), geo.centre_y(cell)).alias("own"), geo.unproject_lon(x).alias("lon2"), geo.unproject_lat(y).alias("lat2"), "lon", "lat").collect()
    for r in found:
        assert r.d <= geo.SIDE * (1 + 1e-9) and r.c == r.own
        assert r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=1e-7)


def _area(ring):
    x, y = (np.array(ring) - ring[0]).T
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def test_areas_in_cells_add_up_to_the_rings(spark):
    dice = random.Random(3)
    def star(n, size, cx, cy):
        reach = [size * (0.4 + 0.6 * dice.random()) for _ in range(n)]
        return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(reach)]

    rings = [[(-900.0, -700.0), (1100.0, -600.0), (300.0, 200.0), (900.0, 1300.0), (-500.0, 800.0)], star(40, 9000, 1e6, -2e6), star(500, 40_000, -5e5, 6e6), star(7, 50, 3e6, 1e6), [(0.0, 0.0), (60_000.0, 0.0), (60_000.0, 60_000.0), (0.0, 60_000.0)]]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(rings)] + [(90, []), (91, [(0.0, 0.0), (1.0, 1.0)]), (92, None), (93, [(1.0, 1.0)] * 4)], "k long, ring array<struct<x:double,y:double>>")
    found = clipping.areas_by_cell(rows, "k").toPandas()
    assert not found.duplicated(["k", "cell"]).any() and found.area.max() <= geo.CELL_AREA * (1 + 1e-9)
    sums = found.groupby("k").area.sum()
    assert set(sums.index) == set(range(5))
    for k, ring in enumerate(rings):
        assert sums[k] == pytest.approx(_area(ring), rel=1e-9)
    some = spark.createDataFrame([(int(c),) for c in found.cell[:5]], "cell long")
    assert set(clipping.areas_by_cell(rows, "k", some).toPandas().cell) == set(found.cell[:5])


def test_rings_of_a_batch_are_cut_each_on_its_own():
    square = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    rings = [square, [], [(x + 1, y) for x, y in square], [(x + 9, y) for x, y in square], [(5 * x, 5 * y) for x, y in square][::-1]]
    flat = np.array([p for r in rings for p in r])
    out = clipping.clipped((flat[:, 0], flat[:, 1], np.cumsum([0, *map(len, rings)])), np.array(square))
    assert list(clipping.areas(out)) == [4.0, 0.0, 2.0, 0.0, 4.0]


def test_parking_is_monotone_and_bounded(spark):
    rows = spark.range(101).select((F.col("id") / 100).alias("building_density"))
    found = [r.parking_origin_car for r in tiles.add_parking(rows).orderBy("building_density").collect()]
    assert found == sorted(found, reverse=True) and min(found) == 0.3 and max(found) == 1.0


def test_weights_cover_the_unit_interval_and_old_thresholds(spark):
    rows = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 0.4), ("z", 0.0)], "event string, p double")
    cdf = sampling.weights_cdf(rows, [], "event", "p").orderBy("cum_lo").collect()
    assert [r.event for r in cdf] == list("abcd") and cdf[0].cum_lo == 0 and cdf[-1].cum_hi == 1
    assert all(a.cum_hi == b.cum_lo for a, b in zip(cdf, cdf[1:]))
    old = {r.event: round(r.cum_hi - r.cum_lo, 9) for r in sampling.weights_cdf(rows, [], "event", "p", reference_thresholds=True).collect()}
    assert old == {"a": 0.1, "b": 0.1, "c": 0.2, "d": 0.6}


def test_weighted_choice_hits_once_with_the_right_frequency(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 7.0)], "event string, p double")
    n = 20000
    cdf = sampling.weights_cdf(rows, [], "event", "p")
    found = {r.event: r["count"] for r in sampling.weighted_choice(spark.range(n), cdf, [], uniform(F.col("id"), 3)).groupBy("event").count().collect()}
    assert sum(found.values()) == n
    for event, p in (("a", 0.1), ("b", 0.2), ("c", 0.7)):
        assert abs(found[event] - n * p) < 4 * math.sqrt(n * p * (1 - p))


def test_draws_do_not_depend_on_partitions(spark):
    u = uniform(F.col("id"), 5, 9)
    a = spark.range(1000, numPartitions=1).select("id", u.alias("u")).orderBy("id").collect()
    assert a == spark.range(1000, numPartitions=7).select("id", u.alias("u")).orderBy("id").collect()


def test_vehicles(spark):
    rows = spark.range(4000).select(sampling.vehicle_count(F.lit(3.4), F.col("id"), 1).alias("many"), sampling.vehicle_count(F.lit(1.5), F.col("id"), 1).alias("some"), sampling.vehicle_count(F.lit(0.0), F.col("id"), 1).alias("none")).collect()
    assert {r.many for r in rows} == {2, 3, 4} and {r.some for r in rows} == {1, 2} and {r.none for r in rows} == {None}


def test_transfer_columns_may_be_absent(spark):
    transfers = spark.createDataFrame([("a", "b"), ("a", "x")], "from_stop_id string, to_stop_id string")
    stops = spark.createDataFrame([("a",), ("b",)], "stop_id string")
    none = spark.createDataFrame([], "trip_id string")
    assert feeds.repair_transfers(transfers, stops, none, none.withColumnRenamed("trip_id", "route_id")).collect() == [("a", "b")]
    assert feeds.fill_agency_url(stops).columns == ["stop_id", "agency_url"]


def test_flows_of_one_place_are_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tiles, "FLOW_BLOCK", 4, raising=False)
    table = spark.range(40).selectExpr("if(id < 37, 'a', 'b') place", "id cell", "double(id) work", "1.0D education", "2.0D leisure", "id + 1.0D workers", "2.0D pupils", "3.0D others")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = tiles.flows(table).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.place, r.origin, r.destination) for r in found} == {("a" if i < 37 else "b", i, j) for i in range(40) for j in range(40) if (i < 37) == (j < 37)} and len(found) == 37**2 + 3**2
    assert len({r.task for r in found if r.place == "a"}) > 1
    total = {"a": sum(range(37)), "b": sum(range(37, 40))}
    assert all(r.flow == pytest.approx(r.destination / total[r.place] * (r.origin + 1) + 5 / (37 if r.place == "a" else 3)) for r in found)


def test_delay_draws_meet_bins_as_rows(spark):
    """The first bin whose end isn't below the draw, without arrays and without a shuffle of the legs; empty bins are never drawn."""
    rows = [(o, f"{5 * k}–", f"{p}%") for o, shares in (("A", (0, 30, 0, 70)), ("average", (50, 50)), ("none", (0, 0, 0))) for k, p in enumerate(shares)]
    bins = delays.delay_bins(spark.createDataFrame(rows, "operator string, label string, percent string"))
    rates = spark.createDataFrame([("a", 0.0), ("average", 100.0), ("none", 0.0), ("binless", 0.0)], "operator string, cancelled_percent double")
    legs = spark.range(400).select(F.col("id").alias("leg_key"), F.element_at(F.array(*[F.lit(o) for o in ("A", "x", "None", None, "binless")]), (F.col("id") % 5 + 1).cast("int")).alias("operator"))
    drawn = delays.draw_delays(legs, bins, rates)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and drawn.columns == ["leg_key", "operator", "cancelled", "delay"]
    assert "Exchange hashpartitioning" not in drawn._jdf.queryExecution().sparkPlan().toString() and "SortMergeJoin" not in drawn._jdf.queryExecution().sparkPlan().toString()
    ends = {}
    for r in bins.orderBy("operator", "bin").collect():
        ends.setdefault(r.operator, []).append((r.cum_hi, r.start, r.end))
    draws = {r.leg_key: (r.u, r.v) for r in legs.select("leg_key", uniform(F.col("leg_key"), 21).alias("u"), uniform(F.col("leg_key"), 22).alias("v")).collect()}
    found = {r.leg_key: r for r in drawn.collect()}
    assert set(found) == {k for k in range(400) if k % 5 != 4}
    for k, r in found.items():
        op = {0: "a", 2: "none"}.get(k % 5, "average")
        u, v = draws[k]
        _, start, end = next(x for x in ends[op] if x[0] is not None and u <= x[0])
        assert r.cancelled == (op == "average") and r.delay == (None if r.cancelled else start + int(v * (end - start)))


def test_delays_stop_at_a_missed_connection(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 8, m)
    rows = [(1, 0, "walking", at(0), at(10), False, None), (1, 1, "bus", at(12), at(20), False, 5), (1, 2, "walking", at(20), at(25), False, None), (1, 3, "train", at(22), at(40), False, 0), (1, 4, "walking", at(40), at(45), False, None)]
    legs = spark.createDataFrame(rows, "option_id int, leg_seq int, mode string, departure timestamp, arrival timestamp, cancelled boolean, delay int").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("departure", "arrival")})
    found = delays.propagate(legs).orderBy("leg_seq").collect()
    assert [r.current_delay for r in found][:3] == [0, 5, 5] and [r.reached for r in found] == [True, True, True, False, False]


def dijkstra(edges, source):
    graph = {}
    for a, b, w in edges:
        graph.setdefault(a, []).append((b, w))
        graph.setdefault(b, []).append((a, w))
    best, queue = {source: 0.0}, [(0.0, source)]
    while queue:
        d, a = heapq.heappop(queue)
        for b, w in graph.get(a, []):
            if d + w < best.get(b, math.inf):
                best[b] = d + w
                heapq.heappush(queue, (d + w, b))
    return best


def test_shortest_paths_against_dijkstra(spark):
    dice = random.Random(5)
    edges = list({(a, b): (a, b, float(dice.randint(1, 9))) for a, b in (sorted(dice.sample(range(30), 2)) for _ in range(60))}.values())
    pairs = [(dice.randrange(30), dice.randrange(30)) for _ in range(12)]
    found = matching.shortest_paths(spark.createDataFrame(pairs, "source long, target long"), spark.createDataFrame(edges, "node_lo long, node_hi long, length double")).collect()
    lengths = {(a, b): w for a, b, w in edges} | {(b, a): w for a, b, w in edges}
    by = {(r.source, r.target): r for r in found}
    for s, t in set(pairs):
        expected = dijkstra(edges, s).get(t)
        if expected is None:
            assert (s, t) not in by
        else:
            r = by[s, t]
            assert r.length == expected and r.path[0] == s and r.path[-1] == t
            assert sum(lengths[a, b] for a, b in zip(r.path, r.path[1:])) == expected


def test_matching_leaves_nothing_out_silently(spark):
    ladder = [(i, i + 2, 1.0) for i in range(60)] + [(i, i + 1, 1.0) for i in range(0, 60, 2)]
    edges = spark.createDataFrame(ladder, "node_lo long, node_hi long, length double")
    pairs = spark.createDataFrame([(0, 60)], "source long, target long")
    with pytest.raises(RuntimeError):
        matching.shortest_paths(pairs, edges, max_rounds=3).collect()
    assert matching.shortest_paths.__kwdefaults__["max_rounds"] is None
    nodes = spark.createDataFrame([(1, 5.0, 51.0), (2, 9.0, 51.0)], "node_id long, lon double, lat double")
    far = spark.createDataFrame([(0, 6.0, 52.0), (1, 5.0, 51.0), (2, -160.0, -80.0), (3, 8.0, 40.0)], "k long, lon double, lat double")
    assert {r.k: r.node_id for r in matching.nearest_nodes(far, nodes).collect()} == {0: 1, 1: 1, 2: 1, 3: 2}
    assert matching.nearest_nodes(far, nodes.limit(0)).count() == 0


def test_nearest_among_dense_nodes_starts_in_small_cubes(spark):
    """Many nodes in one cube, some of them at one place: points meet few of them and still find the nearest."""
    r = random.Random(3)
    spots = [(r.uniform(5, 5.01), r.uniform(89.5, 89.9)) for _ in range(600)]
    nodes = [(i, *spots[i % 500]) for i in range(600)]
    points = [(k, r.uniform(5, 5.01), r.uniform(89.5, 89.9)) for k in range(300)]
    table = spark.createDataFrame(nodes, "node_id long, lon double, lat double")
    plain = table.selectExpr("node_id", "lon _lon", "lat _lat").dropDuplicates(["_lon", "_lat"])
    side = matching._first_side(plain, math.radians(1.0))
    assert matching._binned(plain, "_lon", "_lat", side).groupBy(*matching.CUBE).count().agg(F.max("count")).first()[0] <= matching.FULL
    rows = spark.createDataFrame(points, "k long, lon double, lat double")
    found = {x.k: x.node_id for x in matching.nearest_nodes(rows, table, cell_degrees=1.0).collect()}

    def distance(a, b, c, d):
        a, b, c, d = (math.radians(v) for v in (a, b, c, d))
        return math.asin(min(1.0, math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2)))

    assert found == {k: min((round(distance(x, y, u, v), 13), n) for n, u, v in nodes)[1] for k, x, y in points}


def test_nearest_nodes_across_the_antimeridian_and_at_the_poles(spark):
    nodes = spark.createDataFrame([(1, 179.5, 0.0), (2, -179.99, 0.0), (3, 10.0, 89.9), (4, 100.0, 89.0), (5, 0.0, -90.0)], "node_id long, lon double, lat double")
    points = [(0, 179.99, 0.0), (1, -170.0, 89.95), (2, 100.0, 89.3), (3, 170.0, -89.99), (4, -180.0, 0.0), (5, 180.0, 0.0), (6, None, 1.0), (7, 179.7, 0.0)]
    rows = spark.createDataFrame(points, "k long, lon double, lat double")
    for cell in (0.005, 1.0, 90.0):
        found = {r.k: r.node_id for r in matching.nearest_nodes(rows, nodes, cell_degrees=cell).collect()}
        assert found == {0: 2, 1: 3, 2: 4, 3: 5, 4: 2, 5: 2, 7: 1}


def test_long_paths_and_matched_legs(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "node_lo long, node_hi long, length double")
    nodes = spark.createDataFrame([(i, 5.0 + i / 100, 51.0) for i in range(31)], "node_id long, lon double, lat double")
    steps = spark.createDataFrame([(1, 0, 5.0, 51.0), (1, 1, 5.3, 51.0), (2, 0, 5.1, 51.0), (2, 1, 5.2, 51.0)], "leg_key long, step int, lon double, lat double")
    known = spark.createDataFrame([(2, [7, 8])], "leg_key long, osm_nodes array<bigint>")
    found = {r.leg_key: r.osm_nodes for r in matching.match_legs(steps, nodes, edges, matched=known).collect()}
    assert found == {1: list(range(31)), 2: [7, 8]}


def test_nobody_drops_out_of_attributes(spark):
    commuters = spark.createDataFrame([(1, "a"), (2, "none")], "vc_id long, region string")
    shares = spark.createDataFrame([("a", "20_64", 1.0)], "region string, age string, weight double")
    rates = spark.createDataFrame([("a", "20_64", 0.0)], "region string, age string, rate double")
    types = spark.createDataFrame([], "region string, employment_type string, weight double")
    found = {r.vc_id: (r.age, r.employed, r.employment_type) for r in sampling.attributes(commuters, shares, rates, types).collect()}
    assert found == {1: ("20_64", False, None), 2: (None, False, None)}


def test_flows_stay_inside_their_place(spark):
    rows = [("a", 1, 1.0, 1.0, 1.0, 10.0, 0.0, 0.0), ("a", 2, 3.0, 1.0, 1.0, 20.0, 0.0, 0.0), ("b", 3, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0)]
    tiles_ = spark.createDataFrame(rows, "place string, cell long, work double, education double, leisure double, workers double, pupils double, others double")
    found = {(r.origin, r.destination): r.flow for r in tiles.flows(tiles_).collect()}
    assert found == {(1, 1): 2.5, (1, 2): 7.5, (2, 1): 5.0, (2, 2): 15.0, (3, 3): 0.0}


def test_polylines_of_a_batch_are_decoded_each_on_its_own(spark):
    dice = random.Random(8)
    lines = [[(round(dice.uniform(-90, 90), 5), round(dice.uniform(-180, 180), 5)) for _ in range(dice.randrange(6))] for _ in range(200)]
    texts = [None if k % 9 == 0 else encode(line) + "~" * (k % 3) for k, line in enumerate(lines)]  # an unfinished number at the end
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = {r.k: r.line for r in rows.select("k", decode_polyline("text").alias("line")).collect()}
    for k, line in enumerate(lines):
        if texts[k] is None:
            assert found[k] is None
        else:
            assert np.allclose(np.array([(p.lat, p.lon) for p in found[k]]).reshape(-1, 2), np.array(line).reshape(-1, 2))
    assert rows.where("false").select(decode_polyline("text")).collect() == []


def test_polyline_round_trip():
    line = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert encode(line) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert np.allclose(decode(encode(line)), np.array(line))
    assert decode("").shape == (0, 2)


def test_bare_string_places_and_times(spark):
    rows = spark.createDataFrame([("S1",), ('{"id":"a","name":"b","station":{"location":{"longitude":1.0,"latitude":2.0}}}',), (None,)], "p string")
    place = journeys.read_place(F.col("p"))
    a, b, c = rows.select(place["name"].alias("n"), journeys.location_of(place).alias("l")).collect()
    assert a.n == "S1" and a.l is None and b.l.longitude == 1.0 and c.n is None


def test_simulations_are_replaced_apart(spark, tmp_path):
    path = str(tmp_path / "results")
    store.write_simulation(spark.createDataFrame([("a", 1), ("b", 2)], "sim_id string, v int"), path)
    store.write_simulation(spark.createDataFrame([("b", 3)], "sim_id string, v int"), path)
    assert store.read_simulation(spark, path, "a").first().v == 1 and store.read_simulation(spark, path, "b").first().v == 3
    assert journeys.read_results(spark, path, "b").count() == 1


def test_insert_absent_keeps_what_is_there(spark):
    old, new = (spark.createDataFrame(r, "id int, v string") for r in ([(1, "a")], [(1, "x"), (2, "b")]))
    assert sorted(store.insert_absent(old, new, "id").collect()) == [(1, "a"), (2, "b")]


def test_writers_round_trip(spark, tmp_path):
    stats = spark.createDataFrame([(1.0, 0.5)], "car_meters double, car_share double")
    store.write_stats(stats, str(tmp_path / "stats"), sim_id="s", meta={"city": "x"})
    assert spark.read.json(str(tmp_path / "stats")).first().meta.city == "x"
    heat = spark.createDataFrame([(7, 0.1, 0.2, 0.3, 0.4, 9.9)], "cell long, car_share double, rail_share double, bus_share double, walk_share double, car_meters double")
    store.write_heatmap(heat, str(tmp_path / "heat"))
    assert spark.read.parquet(str(tmp_path / "heat")).columns == ["cell", "car_share", "rail_share", "bus_share", "walk_share"]


def test_statistics_feed_and_grid_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("geo,TIME_PERIOD,OBS_VALUE,age\nNL1,2020,1.5,Y5-9\nNL2,2021,2.5,Y5-9\n")
    rows = tables.read_statistics(spark, str(tmp_path / "s.csv"), ["geo", "TIME_PERIOD", "OBS_VALUE", "age"], year=2020, regions=["NL1"], age=["Y5-9"])
    assert [(r.geo, r.value) for r in rows.collect()] == [("NL1", 1.5)]
    (tmp_path / "stops.txt").write_text("stop_id,n\n01,2\n")
    assert tables.read_feed(spark, str(tmp_path), "stops").first().stop_id == "01"
    spark.createDataFrame([(1.0, 1.0, 5.0), (9.0, 9.0, 6.0)], "lon double, lat double, population double").write.parquet(str(tmp_path / "grid"))
    assert tables.read_population(spark, str(tmp_path / "grid"), (0, 0, 2, 2)).first().population == 5.0


def test_merge_places_can_drop_repeats(spark):
    a = spark.createDataFrame([(1,), (2,)], "cell long")
    assert tiles.merge_places([a, a]).count() == 4 and tiles.merge_places([a, a], distinct_cells=True).count() == 2


def test_tile_region_takes_the_largest_area_then_the_first(spark):
    square = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    rows = [("b", square(-3000.0, -3000.0, 3000.0, 3000.0)), ("c", square(-100.0, -100.0, 100.0, 100.0)), ("a", square(9e4, 9e4, 9.1e4, 9.1e4))]
    regions = spark.createDataFrame(rows, "region string, ring array<struct<x:double,y:double>>")
    here, far = (spark.range(1).select(geo.cell_of_plane(F.lit(float(x)), F.lit(float(x))).alias("cell")) for x in (0, 500000))
    found = {r.cell: r.region for r in tiles.tile_region(here.unionByName(far), regions).collect()}
    assert found == {here.first().cell: "b", far.first().cell: "a"}


def test_dated_graphs_are_not_mixed(spark):
    routes = spark.createDataFrame([(1, 1, 1, 0, 0, [1, 2, 3], "a"), (2, 2, 1, 0, 0, [3, 2], "b")], "vc_id int, option_id int, option_ord int, itinerary_ord int, leg_seq int, osm_nodes array<bigint>, graph_date string")
    edges = spark.createDataFrame([(1, 2, "a", 5.0, ["4"]), (2, 3, "a", 5.0, ["4"]), (2, 3, "b", 9.0, ["1"])], "node_lo long, node_hi long, graph_date string, length double, lanes array<string>")
    usage = congestion.edge_usage(routes, vehicles_per_journey=4.0)
    found = {(r.node_lo, r.node_hi, r.graph_date): (r.usage, r.factor) for r in congestion.congestion_factors(usage, edges).collect()}
    assert found == {(1, 2, "a"): (4.0, 1.0), (2, 3, "a"): (4.0, 1.0), (2, 3, "b"): (4.0, 0.25)}
    assert congestion.missing_edges(usage, edges).count() == 0
    used = congestion.used_edges(routes)
    assert {tuple(r) for r in used.collect()} == {(1, 2, "a"), (2, 3, "a"), (3, 2, "b")}
    assert matching.edge_metadata(used, edges).count() == 3
    for a, b in ((usage, edges.drop("graph_date")), (usage.drop("graph_date"), edges)):
        with pytest.raises(ValueError, match="graph_date"):
            congestion.congestion_factors(a, b)
