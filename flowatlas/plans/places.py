"""Queries on statistics, tiles, sampling and roads, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowatlas.functions import geo
from flowatlas.functions.draws import Salt, uniform
from flowatlas.operators import roads as roads_of
from flowatlas.operators import sampling, statistics, tiles
from flowatlas.plans.fixtures import RING, Tables
from flowatlas.plans.mobility import celled, rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _any(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


AGES = "ages AS (SELECT geo, " + ", ".join(f"sum(value) FILTER ({_any('age', codes)}) AS age_{g}" for g, codes in statistics.AGE_GROUPS.items()) + " FROM fx_age GROUP BY geo)"
AGE_NAMES = [f"age_{g}" for g in statistics.AGE_GROUPS]


@query(f"WITH {AGES} SELECT geo, {', '.join(AGE_NAMES)}, {', '.join(f'round({a} / ({' + '.join(AGE_NAMES)}), 6) AS {a}_share' for a in AGE_NAMES)} FROM ages WHERE {' AND '.join(f'{a} IS NOT NULL' for a in AGE_NAMES)}")
def age_groups(t: Tables) -> DataFrame:
    ages = statistics.clean("age", t.age)
    shares = statistics.row_shares(ages, AGE_NAMES).withColumnsRenamed({a: f"{a}_share" for a in AGE_NAMES})
    return rounded(ages.join(shares, "geo"))


RATES = ("CASE WHEN age IN ('Y20-24', 'Y25-29', 'Y30-34') THEN 'between_20_64' WHEN age = 'Y65-69' THEN 'over_64' END")


@query(f"WITH r AS (SELECT left(geo, length(geo) - 1) AS geo, {RATES} AS age, value / 100 AS value FROM fx_age), s AS (SELECT geo, sum(value) FILTER (age = 'between_20_64') AS employment_rate_between_20_64, sum(value) FILTER (age = 'over_64') AS employment_rate_over_64 FROM r GROUP BY geo) SELECT geo, round(employment_rate_between_20_64, 6) AS employment_rate_between_20_64, round(employment_rate_over_64, 6) AS employment_rate_over_64 FROM s WHERE employment_rate_between_20_64 IS NOT NULL AND employment_rate_over_64 IS NOT NULL")
def employment_rate(t: Tables) -> DataFrame:
    rows = t.age.select(statistics.nuts2_of(F.col("geo")).alias("geo"), F.expr(RATES).alias("age"), (F.col("value") / 100).alias("value"))
    return rounded(statistics.clean("employment_rate", rows))


_S = [f"s{i}" for i in range(10)]
WIDE = "wide AS (SELECT CAST(n_nationkey AS VARCHAR) AS geo, " + ", ".join(f"sum(value) FILTER (sector = '{c}') AS s{i}" for i, c in enumerate(statistics.SECTORS)) + " FROM fx_sector GROUP BY n_nationkey)"
TYPES = ", ".join(f"round({' + '.join(f's{statistics.SECTORS.index(c)}' for c in group)}, 6) AS employment_type_{k}" for k, group in statistics.EMPLOYMENT_TYPES.items())


@query(f"WITH {WIDE}, c AS (SELECT geo, {', '.join(f'{s} / ({' + '.join(_S)}) AS {s}' for s in _S)} FROM wide WHERE {' AND '.join(f'{s} IS NOT NULL' for s in _S)}) SELECT geo, {TYPES} FROM c")
def employment_type(t: Tables) -> DataFrame:
    return rounded(statistics.clean("employment_type", t.sector.select(F.col("n_nationkey").cast("string").alias("geo"), "sector", "value")))


@query(f"WITH {WIDE}, c AS (SELECT {', '.join(f'avg({s} / ({' + '.join(_S)})) AS m{s}' for s in _S)} FROM wide WHERE {' AND '.join(f'{s} IS NOT NULL' for s in _S)}), f AS (SELECT geo, {', '.join(f'coalesce({s}, m{s} * ({' + '.join(f'coalesce({x}, 0)' for x in _S)})) AS {s}' for s in _S)} FROM wide CROSS JOIN c), g AS (SELECT geo, {', '.join(f'{s} / ({' + '.join(_S)}) AS {s}' for s in _S)} FROM f) SELECT geo, {TYPES} FROM g")
def employment_type_imputed(t: Tables) -> DataFrame:
    rows = t.sector.select(F.col("n_nationkey").cast("string").alias("geo"), "sector", "value")
    return rounded(statistics.clean("employment_type", rows, missing="mean"))


MOTOR = "m AS (SELECT geo, " + ", ".join(f"max(value) FILTER (vehicle = '{v}') AS {v}" for v in statistics.VEHICLES) + " FROM fx_vehicle GROUP BY geo)"


@query(f"WITH {AGES}, full_ages AS (SELECT left(geo, length(geo) - 1) AS geo, sum(age_between_20_64 + age_over_64) AS adults FROM ages WHERE {' AND '.join(f'{a} IS NOT NULL' for a in AGE_NAMES)} GROUP BY 1), {MOTOR} SELECT m.geo, round(CAR / adults, 6) AS vehicle_car, round(MOTO / adults, 6) AS vehicle_moto, round(SPE / adults, 6) AS vehicle_special, round(BUS_TOT / adults, 6) AS vehicle_bus, round((LOR + TRC) / adults, 6) AS vehicle_truck, round(UTL / adults, 6) AS vehicle_utilities FROM m JOIN full_ages a ON m.geo = a.geo")
def motorization(t: Tables) -> DataFrame:
    return rounded(statistics.clean("motorization", t.vehicle, ages=statistics.age_groups(t.age)))


@query("SELECT geo, round(avg(value), 4) AS value FROM fx_income GROUP BY geo")
def income(t: Tables) -> DataFrame:
    return rounded(statistics.clean("income", t.income), 4)


@query("SELECT year, count(*) AS n_rows, count(DISTINCT geo) AS n_regions FROM fx_income GROUP BY year")
def rows_per_year(t: Tables) -> DataFrame:
    return statistics.rows_per_year(t.income)


@query("SELECT geo, vehicle, count(*) AS n_rows FROM fx_vehicle GROUP BY geo, vehicle HAVING count(*) > 1")
def duplicate_rows(t: Tables) -> DataFrame:
    return statistics.duplicates(t.vehicle, ["geo", "vehicle"])


@query("WITH g AS (SELECT geo, value FROM fx_age WHERE year = 2021 UNION ALL SELECT geo, value FROM fx_income WHERE year = 2021), k AS (SELECT * FROM g WHERE length(geo) <= 5) SELECT geo, round(value, 4) AS value, CAST(length(geo) - 2 AS INTEGER) AS precision FROM k WHERE length(geo) = (SELECT max(length(geo)) FROM k)")
def finest_region(t: Tables) -> DataFrame:
    rows = statistics.filter_year(t.age, 2021).select("geo", "value").unionByName(statistics.filter_year(t.income, 2021).select("geo", "value"))
    return rounded(statistics.finest_regions(rows), 4)


@query("SELECT DISTINCT geo FROM fx_age WHERE geo NOT IN (SELECT geo FROM fx_age WHERE year = 2021)")
def availability(t: Tables) -> DataFrame:
    return statistics.unavailable_regions(t.age, t.age.select("geo").distinct(), 2021)


@query(f"WITH {AGES}, r AS (SELECT DISTINCT geo AS nuts3 FROM fx_age), {MOTOR} SELECT r.nuts3, a.age_under_20, a.age_between_20_64, a.age_over_64, round(i.value, 4) AS value FROM r LEFT JOIN (SELECT * FROM ages WHERE {' AND '.join(f'{a} IS NOT NULL' for a in AGE_NAMES)}) a ON r.nuts3 = a.geo LEFT JOIN (SELECT geo, avg(value) AS value FROM fx_income GROUP BY geo) i ON left(r.nuts3, length(r.nuts3) - 1) = i.geo")
def region_profile(t: Tables) -> DataFrame:
    regions = t.age.select(F.col("geo").alias("nuts3")).distinct()
    return rounded(statistics.region_profile(regions, [statistics.age_groups(t.age)], [statistics.mean_by_region(t.income)]), 4)


def _polygon(t: Tables) -> DataFrame:
    """The clip polygon and, scaled about its first corner by customer, a polygon per nation."""
    ring = F.array(*[F.struct((geo.project_x(F.lit(x)) + F.col("n_nationkey") * 700.0).alias("x"), (geo.project_y(F.lit(y)) + F.col("n_nationkey") * 300.0).alias("y")) for x, y in RING])
    return t.base("nation").select(F.col("n_name").alias("place_id"), ring.alias("ring"))


def _ring_sql() -> list[tuple[str, str]]:
    out = []
    for lon, lat in RING:
        s = f"sin(radians({lat}e0))"
        y = f"{1 - geo.E2!r}e0 * ({s} / (1 - {geo.E2!r}e0 * {s} * {s}) - {1 / (2 * geo.E1)!r}e0 * ln((1 - {geo.E1!r}e0 * {s}) / (1 + {geo.E1!r}e0 * {s}))) * {geo.A / (2 * geo.K0)!r}e0"
        out.append((f"(radians({lon}e0) * {geo.A * geo.K0!r}e0 + n_nationkey * 700e0)", f"({y} + n_nationkey * 300e0)"))
    return out


def _cover_sql() -> str:
    ring = _ring_sql()
    h, w = geo.SIDE * 1.5, geo.SIDE * 3**0.5
    cols = ", ".join(f"{x} AS x{i}, {y} AS y{i}" for i, (x, y) in enumerate(ring))
    xs, ys = (", ".join(f"{c}{i}" for i in range(len(ring))) for c in "xy")
    test = " + ".join(f"CASE WHEN (y{i} > cy) <> (y{j} > cy) AND cx < (x{j} - x{i}) * (cy - y{i}) / (y{j} - y{i}) + x{i} THEN 1 ELSE 0 END" for i, j in zip(range(len(ring)), [*range(1, len(ring)), 0]))
    return f"""WITH p AS (SELECT n_name AS place_id, {cols} FROM nation), b AS (SELECT *, least({xs}) AS x_0, greatest({xs}) AS x_1, least({ys}) AS y_0, greatest({ys}) AS y_1 FROM p),
r AS (SELECT *, unnest(range(CAST(floor(y_0 / {h!r}e0) AS BIGINT), CAST(ceil(y_1 / {h!r}e0) AS BIGINT) + 1)) AS r FROM b), q AS (SELECT *, unnest(range(CAST(floor(x_0 / {w!r}e0 - r / 2e0) AS BIGINT), CAST(ceil(x_1 / {w!r}e0 - r / 2e0) AS BIGINT) + 1)) AS q FROM r),
c AS (SELECT *, (q + r / 2e0) * {w!r}e0 AS cx, r * {h!r}e0 AS cy FROM q) SELECT place_id, (q + {geo.OFFSET}) * {geo.SPAN} + r + {geo.OFFSET} AS cell FROM c WHERE ({test}) % 2 = 1"""


@query(_cover_sql())
def tile_cover(t: Tables) -> DataFrame:
    return tiles.tile_cover(_polygon(t))


@query("SELECT cell, round(coalesce(population, (SELECT median(population) FROM fx_tiles)), 4) AS population FROM fx_tiles")
def population_imputed(t: Tables) -> DataFrame:
    grid = t.tiles.where("population is not null").select("cell", "population")
    return rounded(tiles.with_population(t.tiles.select("cell"), grid), 4)


@query("SELECT cell, population AS population, region || '-' || CAST(cell % 2 AS VARCHAR) AS region FROM fx_tiles UNION ALL SELECT cell, population, region || '-' || CAST(cell % 2 AS VARCHAR) FROM fx_tiles WHERE in_b")
def tile_merge(t: Tables) -> DataFrame:
    merged = tiles.merge_places([t.tiles.select("cell", "population", "region"), t.tiles.where("in_b").select("cell", "population", "region")])
    fields = t.tiles.select("cell", F.concat_ws("-", "region", F.col("cell") % 2).alias("region"))
    return tiles.merge_fields(merged, fields).select("cell", "population", "region")


#: Tag keys of the features, as their columns are named.
KEYS = ("landuse", "office", "amenity", "building", "shop", "healthcare", "leisure", "sport", "tourism")


def _features(t: Tables) -> DataFrame:
    tags = F.map_filter(F.create_map(*[x for k in KEYS for x in (F.lit(k), F.col(k))], F.lit("natural"), F.col("natural_")), lambda k, v: v.isNotNull())
    half = F.col("p_size") * 10.0
    corner = lambda dx, dy: F.struct((F.col("x") + dx * half).alias("x"), (F.col("y") + dy * half).alias("y"))
    ring = F.when(F.col("geom_type") == "Polygon", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))
    return t.features.select("feature_id", "geom_type", tags.alias("tags"), "x", "y", ring.alias("ring"))


def _zones_sql() -> str:
    column = {k: k for k in KEYS} | {"natural": "natural_"}
    parts = []
    for zone, rules in tiles.ZONE_TAGS.items():
        tests = [f"{column[k]} IS NOT NULL" if v is True else _any(column[k], tuple(v)) + ("" if len(v) > 1 else "") for k, v in rules.items()]
        only = f" AND geom_type = '{tiles.ONLY[zone]}'" if zone in tiles.ONLY else ""
        parts.append(f"SELECT feature_id, geom_type, x, y, p_size, '{zone}' AS zone FROM fx_features WHERE ({' OR '.join(f'coalesce({x}, false)' for x in tests)}){only}")
    return " UNION ALL ".join(parts)


@query(f"SELECT feature_id, geom_type, zone FROM ({_zones_sql()}) z")
def zone_tags(t: Tables) -> DataFrame:
    return tiles.zone_classes(_features(t)).select("feature_id", "geom_type", "zone")


def _point_cells() -> str:
    from flowatlas.plans.mobility import cube_cells

    return cube_cells(f"SELECT zone, x AS x_, y AS y_ FROM ({_zones_sql()}) z WHERE geom_type = 'Point'")


@query(f"WITH c AS ({_point_cells()}) SELECT cell, zone, count(*) * 100e0 AS area FROM c GROUP BY cell, zone")
def zone_points(t: Tables) -> DataFrame:
    return tiles.zone_points(tiles.zone_classes(_features(t)))


def cell_areas(edges: str) -> str:
    """CTEs up to ``cell_areas`` (key, cell, area): exact areas of polygons in cells, from ``edges`` (key, xa, ya, xb, yb).

    A polygon's area left of its edges is a signed sum over them; of what a cell holds of it, the width at a height is
    linear between the heights where the edge's line meets the cell's six lines, so trapezoids are exact.
    """
    h, w, r, root = geo.SIDE * 1.5, geo.SIDE * 3**0.5, geo.SIDE, 3**0.5
    half = f"least({root / 2 * r!r}e0, {root!r}e0 * ({r!r}e0 - abs(y)))"
    slants = ", ".join(f"({s * root * r!r}e0 - xs) / nullif(m + {s * t * root!r}e0, 0)" for s in (1, -1) for t in (1, -1))
    return f"""edges AS ({edges}), boxes AS (SELECT key, min(xa) - {r!r}e0 AS x0, max(xa) + {r!r}e0 AS x1, min(ya) - {r!r}e0 AS y0, max(ya) + {r!r}e0 AS y1 FROM edges GROUP BY key),
box_rows AS (SELECT *, unnest(range(CAST(floor(y0 / {h!r}e0) AS BIGINT), CAST(ceil(y1 / {h!r}e0) AS BIGINT) + 1)) AS r FROM boxes),
box_cells AS (SELECT *, unnest(range(CAST(floor(x0 / {w!r}e0 - r / 2e0) AS BIGINT), CAST(ceil(x1 / {w!r}e0 - r / 2e0) AS BIGINT) + 1)) AS q FROM box_rows),
seen AS (SELECT c.key, c.q, c.r, xa - (c.q + c.r / 2e0) * {w!r}e0 AS xa, ya - c.r * {h!r}e0 AS ya, xb - (c.q + c.r / 2e0) * {w!r}e0 AS xb, yb - c.r * {h!r}e0 AS yb FROM box_cells c JOIN edges e ON c.key = e.key WHERE ya <> yb),
lines AS (SELECT *, (xb - xa) / (yb - ya) AS m, xa - ya * (xb - xa) / (yb - ya) AS xs, greatest(least(ya, yb), {-r!r}e0) AS low, least(greatest(ya, yb), {r!r}e0) AS high, sign(yb - ya) AS s FROM seen),
heights AS (SELECT key, q, r, m, xs, s, unnest(list_filter([low, high, {r / 2!r}e0, {-r / 2!r}e0, ({root / 2 * r!r}e0 - xs) / nullif(m, 0), ({-root / 2 * r!r}e0 - xs) / nullif(m, 0), {slants}], lambda y: y >= low AND y <= high)) AS y, row_number() OVER () AS e FROM lines WHERE high > low),
widths AS (SELECT key, q, r, s, e, y, least(greatest(m * y + xs + {half}, 0e0), 2 * {half}) AS f FROM heights),
strips AS (SELECT key, q, r, s, (lead(y) OVER v - y) * (lead(f) OVER v + f) / 2 AS a FROM widths WINDOW v AS (PARTITION BY e ORDER BY y)),
cell_areas AS (SELECT key, (q + {geo.OFFSET}) * {geo.SPAN} + r + {geo.OFFSET} AS cell, abs(sum(s * a)) AS area FROM strips WHERE a IS NOT NULL GROUP BY ALL)"""


def _square_edges(source: str) -> str:
    corner = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    return " UNION ALL ".join(f"SELECT feature_id AS key, x + {a} * p_size * 10e0 AS xa, y + {b} * p_size * 10e0 AS ya, x + {c} * p_size * 10e0 AS xb, y + {d} * p_size * 10e0 AS yb FROM {source}" for (a, b), (c, d) in zip(corner, corner[1:] + corner[:1]))


@query(f"""WITH zoned AS ({_zones_sql()}), squares AS (SELECT DISTINCT feature_id, x, y, p_size FROM zoned WHERE geom_type = 'Polygon'), {cell_areas(_square_edges('squares'))},
parts AS (SELECT cell, zone, area FROM zoned z JOIN cell_areas a ON z.feature_id = a.key WHERE geom_type = 'Polygon' AND area > 1e-6 UNION ALL SELECT cell, zone, 100e0 FROM ({_point_cells()}) c)
SELECT cell, zone, round(sum(area), 3) AS area FROM parts GROUP BY cell, zone""")
def zone_area(t: Tables) -> DataFrame:
    areas = tiles.zone_areas(tiles.zone_classes(_features(t)))
    return rounded(areas.where("area > 1e-6"), 3)


@query(f"SELECT zone, round(sum(CASE geom_type WHEN 'Polygon' THEN 4 * (p_size * 10e0) * (p_size * 10e0) WHEN 'Point' THEN 100e0 END), 0) AS area FROM ({_zones_sql()}) z WHERE geom_type <> 'MultiPolygon' GROUP BY zone")
def zone_area_total(t: Tables) -> DataFrame:
    """Areas of the clipped pieces add up to the polygons' own areas."""
    return tiles.zone_areas(tiles.zone_classes(_features(t))).groupBy("zone").agg(F.round(F.sum("area"), 0).alias("area"))


def _ring_edges() -> str:
    ring = _ring_sql()
    return " UNION ALL ".join(f"SELECT n_name AS key, {xa} AS xa, {ya} AS ya, {xb} AS xb, {yb} AS yb FROM nation" for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]))


@query(f"""WITH {cell_areas(_ring_edges())}, cover AS ({_cover_sql()}), best AS (SELECT cell, min(key) AS region FROM (SELECT *, round(area, 3) = max(round(area, 3)) OVER (PARTITION BY cell) AS top FROM cell_areas) x WHERE top GROUP BY cell)
SELECT c.cell, coalesce(region, (SELECT min(n_name) FROM nation)) AS region FROM (SELECT DISTINCT cell FROM cover) c LEFT JOIN best b ON c.cell = b.cell""")
def tile_region(t: Tables) -> DataFrame:
    cells = tiles.tile_cover(_polygon(t)).select("cell").distinct()
    return tiles.tile_region(cells, _polygon(t).withColumnRenamed("place_id", "region"))


@query("SELECT cell, round(work_agricultural + work_industrial + work_commercial + work_office + work_social, 4) AS work, round((buildings_1 + buildings_2 + no_parking) / tile_area, 6) AS building_density FROM fx_tiles")
def tile_density(t: Tables) -> DataFrame:
    return rounded(tiles.tile_rollup(t.tiles).select("cell", "work", "building_density"), building_density=6)


def _park(high: float, low: float, least: float, most: float) -> str:
    return f"round_even(CASE WHEN building_density >= {high}e0 THEN {least}e0 WHEN building_density <= {low}e0 THEN {most}e0 ELSE {most}e0 + {least - most}e0 * (building_density - {low}e0) / ({high}e0 - {low}e0) END, 4)"


@query("SELECT cell, " + ", ".join(f"{_park(*limits)} AS parking_{end}_{v}" for end, by in tiles.PARKING.items() for v, limits in by.items()) + " FROM fx_tiles")
def parking(t: Tables) -> DataFrame:
    return tiles.add_parking(t.tiles).select("cell", *[f"parking_{end}_{v}" for end, by in tiles.PARKING.items() for v in by])


@query(f"WITH p AS (SELECT cell, population, exp({_park(*tiles.PARKING['origin']['car'])}) AS e FROM fx_tiles WHERE population IS NOT NULL) SELECT cell, round((e / sum(e) OVER ()) / (population / sum(population) OVER ()), 6) AS weight FROM p")
def parking_weight(t: Tables) -> DataFrame:
    return rounded(tiles.parking_weights(tiles.add_parking(t.tiles.where("population is not null"))))


@query("""WITH p AS (SELECT region, cell, work_office + work_social AS work, education, leisure, population * 0.5e0 AS workers, population * 0.2e0 AS pupils, population * 0.3e0 AS others FROM fx_tiles WHERE population IS NOT NULL),
e AS (SELECT region, cell AS destination, work / sum(work) OVER w AS a, education / sum(education) OVER w AS b, leisure / sum(leisure) OVER w AS c FROM p WINDOW w AS (PARTITION BY region))
SELECT p.region, p.cell AS origin, destination, round(a * workers + b * pupils + c * others, 4) AS flow FROM p JOIN e ON p.region = e.region""")
def od_matrix(t: Tables) -> DataFrame:
    """The matrix of every region's tiles."""
    ends = [F.col("region"), F.col("cell"), (F.col("work_office") + F.col("work_social")).alias("work"), F.col("education"), F.col("leisure")]
    people = [(F.col("population") * share).alias(name) for name, share in (("workers", 0.5), ("pupils", 0.2), ("others", 0.3))]
    return rounded(tiles.flows(t.tiles.where("population is not null").select(*ends, *people), place="region"), 4)


@query("""WITH p AS (SELECT region, cell, CASE WHEN work_office < 300 THEN 0e0 ELSE work_office END + 500e0 AS work, education, leisure, population * 0.5e0 AS workers, population * 0.2e0 AS pupils, population * 0.3e0 AS others FROM fx_tiles WHERE population IS NOT NULL),
e AS (SELECT region, cell AS destination, work / sum(work) OVER w AS a, education / sum(education) OVER w AS b, leisure / sum(leisure) OVER w AS c FROM p WINDOW w AS (PARTITION BY region))
SELECT p.region, p.cell AS origin, destination, round(a * workers + b * pupils + c * others, 4) AS flow FROM p JOIN e ON p.region = e.region""")
def od_matrix_base(t: Tables) -> DataFrame:
    """The matrix with 500 m² of work in each tile beside what is mapped there."""
    work = F.when(F.col("work_office") < 300, 0.0).otherwise(F.col("work_office"))
    people = [(F.col("population") * share).alias(name) for name, share in (("workers", 0.5), ("pupils", 0.2), ("others", 0.3))]
    rows = t.tiles.where("population is not null").select("region", "cell", work.alias("work"), "education", "leisure", *people)
    return rounded(tiles.flows(rows, place="region", base_work=500.0), 4)


def _document_sql() -> str:
    ring = [(x, y) for x, y in _ring_sql()]
    corners = ", ".join(f"printf('%.3f %.3f', {x}, {y})" for x, y in [*ring, ring[0]])
    xs, ys = (", ".join(p[k] for p in ring) for k in (0, 1))
    return f"""WITH cover AS ({_cover_sql()}), listed AS (SELECT place_id, list(cell ORDER BY cell) AS tiles, list_sort(list(DISTINCT 'R' || CAST(cell % 5 AS VARCHAR))) AS regions FROM cover GROUP BY place_id)
SELECT n_name AS name, 'Country ' || CAST(n_regionkey AS VARCHAR) AS country, CAST(len(tiles) AS BIGINT) AS n_tiles, array_to_string(tiles, ',') AS tiles, array_to_string(regions, ',') AS regions,
'MULTIPOLYGON (((' || array_to_string([{corners}], ', ') || ')))' AS shape, round(least({xs}), 3) AS x0, round(least({ys}), 3) AS y0, round(greatest({xs}), 3) AS x1, round(greatest({ys}), 3) AS y1 FROM nation JOIN listed ON n_name = place_id"""


@query(_document_sql())
def place_document(t: Tables) -> DataFrame:
    """The whole document of each nation's place, its list of tiles among them."""
    named = t.base("nation").select(F.col("n_name").alias("place_id"), F.concat("n_name", F.lit(", Country "), F.col("n_regionkey").cast("string")).alias("place"))
    polygons = _polygon(t)
    cells = tiles.tile_cover(polygons).join(named, "place_id").select("place", "cell", F.concat(F.lit("R"), (F.col("cell") % 5).cast("string")).alias("region"))
    found = tiles.place_documents(cells, polygons.join(named, "place_id").select("place", "ring"))
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return rounded(found.select("name", "country", "n_tiles", joined("tiles"), joined("regions"), "shape", *[F.col("bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]), 3)


@query("SELECT cell, round(population / sum(population) OVER (), 9) AS population_share FROM fx_tiles")
def population_share(t: Tables) -> DataFrame:
    return rounded(tiles_share(t), 9)


def tiles_share(t: Tables) -> DataFrame:
    return statistics.column_share(t.tiles.select("cell", "population"), "population", "population_share").select("cell", "population_share")


@query("SELECT place, trim(split_part(place, ',', 1)) AS city, trim(split_part(place, ',', 2)) AS country, count(*) AS n_tiles, string_agg(DISTINCT region, ',' ORDER BY region) AS regions FROM (SELECT 'City ' || CAST(cell % 7 AS VARCHAR) || ', Country ' || CAST(cell % 3 AS VARCHAR) AS place, region FROM fx_tiles) p GROUP BY place")
def place_summary(t: Tables) -> DataFrame:
    place = F.concat(F.lit("City "), F.col("cell") % 7, F.lit(", Country "), F.col("cell") % 3)
    return tiles.place_summary(t.tiles.select(place.alias("place"), "region"))


def cdf_sql(source: str, group: str, event: str, weight: str) -> str:
    """SQL of the cumulative intervals of a weighted table; group may be empty."""
    by = f"PARTITION BY {group} " if group else ""
    keys = f"{group}, " if group else ""
    return f"""SELECT {keys}{event}, least(lag(up, 1, 0e0) OVER ({by}ORDER BY p, {event}), 1e0) AS cum_lo, CASE WHEN lead({event}) OVER ({by}ORDER BY p, {event}) IS NULL THEN 1e0 ELSE least(up, 1e0) END AS cum_hi FROM (SELECT {keys}{event}, p, sum(p) OVER ({by}ORDER BY p, {event} ROWS UNBOUNDED PRECEDING) AS up FROM (SELECT {keys}{event}, {weight} / sum({weight}) OVER ({by}) AS p FROM {source} WHERE {weight} > 0) a) b"""


@query(f"SELECT cell, round(cum_lo, 9) AS cum_lo, round(cum_hi, 9) AS cum_hi FROM ({cdf_sql('fx_tiles', '', 'cell', 'population')}) c")
def weights_cdf(t: Tables) -> DataFrame:
    return rounded(sampling.weights_cdf(t.tiles, [], "cell", "population"), 9)


@query(f"WITH c AS ({cdf_sql('fx_tiles', 'region', 'cell', 'population')}) SELECT v.vc_id, v.region, c.cell FROM (SELECT k.vc_id, k.region, d.u1 FROM fx_commuters k JOIN fx_draws d ON k.vc_id = d.vc_id) v JOIN c ON v.region = c.region AND (u1 > cum_lo OR u1 = 0 AND cum_lo = 0) AND u1 <= cum_hi")
def weighted_choice(t: Tables) -> DataFrame:
    cdf = sampling.weights_cdf(t.tiles, ["region"], "cell", "population")
    return sampling.weighted_choice(t.commuters.select("vc_id", "region"), cdf, ["region"], uniform(F.col("vc_id"), Salt.HOME)).select("vc_id", "region", "cell")


@query("SELECT order_key, wide_key, round(u, 9) AS u FROM fx_wide_draws")
def wide_draws(t: Tables) -> DataFrame:
    """Draws for keys from all over the 64 bits."""
    return rounded(t.wide_draws.select("order_key", "wide_key", uniform(F.col("wide_key"), 3, 11).alias("u")), 9)


def _cells(t: Tables) -> DataFrame:
    """Tiles with grid cells instead of part keys."""
    return t.tiles.withColumn("cell", geo.cell_id(F.col("cell") % 150, F.floor(F.col("cell") / 150)))


@query(f"WITH c AS ({cdf_sql('fx_tiles', '', 'cell', 'population')}) SELECT vc_id, (cell % 150 + {geo.OFFSET}) * {geo.SPAN} + CAST(floor(cell / 150) AS BIGINT) + {geo.OFFSET} AS origin_cell FROM fx_draws JOIN c ON (u1 > cum_lo OR u1 = 0 AND cum_lo = 0) AND u1 <= cum_hi")
def home_tiles(t: Tables) -> DataFrame:
    tiled = t.tiles.select("cell", "population")
    cdf = sampling.weights_cdf(tiled, [], "cell", "population")
    drawn = sampling.weighted_choice(t.commuters.select("vc_id"), cdf, [], uniform(F.col("vc_id"), Salt.HOME))
    return drawn.select("vc_id", geo.cell_id(F.col("cell") % 150, F.floor(F.col("cell") / 150)).alias("origin_cell"))


def _home_sql() -> str:
    """Tile by population, then a point in one of the hexagon's six triangles, unprojected by the authalic series."""
    pole = 1 - (1 - geo.E2) / (2 * geo.E1) * math.log((1 - geo.E1) / (1 + geo.E1))
    e2 = geo.E2
    series = [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]
    lat = " + ".join(f"{c!r}e0 * sin({2 * k} * b)" if "e" not in repr(c) else f"{c!r} * sin({2 * k} * b)" for k, c in enumerate(series, 1))
    turn = lambda f, k: f"{f}(pi() / 6 + (side + {k}) * pi() / 3)"
    return f"""WITH grid AS (SELECT (q + {geo.OFFSET}) * {geo.SPAN} + r + {geo.OFFSET} AS tile, q, r, population, region FROM (SELECT cell % 150 AS q, CAST(floor(cell / 150) AS BIGINT) AS r, population, region FROM fx_tiles) g), c AS ({cdf_sql('grid', '', 'tile', 'population')}),
drawn AS (SELECT vc_id, g.tile, g.region, q, r, floor(u2 * 6) AS side, CASE WHEN u3 + u4 > 1 THEN 1 - u3 ELSE u3 END AS a, CASE WHEN u3 + u4 > 1 THEN 1 - u4 ELSE u4 END AS b
  FROM fx_draws JOIN c ON (u1 > cum_lo OR u1 = 0 AND cum_lo = 0) AND u1 <= cum_hi JOIN grid g ON c.tile = g.tile),
placed AS (SELECT vc_id, tile, region, (q + r / 2) * {geo.SIDE * math.sqrt(3)!r}e0 + {geo.SIDE!r}e0 * (a * {turn('cos', 0)} + b * {turn('cos', 1)}) AS x,
  asin((r * {geo.SIDE * 1.5!r}e0 + {geo.SIDE!r}e0 * (a * {turn('sin', 0)} + b * {turn('sin', 1)})) * {2 * geo.K0 / geo.A / pole!r}) AS b FROM drawn)
SELECT vc_id, CAST(tile AS BIGINT) AS origin_cell, round(degrees(x / {geo.A * geo.K0!r}e0), 7) AS origin_lon, round(degrees(b + {lat}), 7) AS origin_lat, region FROM placed"""


@query(_home_sql())
def homes(t: Tables) -> DataFrame:
    return rounded(sampling.homes(t.commuters.select("vc_id"), _cells(t)), 7)


def _regional(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    shares = statistics.age_groups(t.age.withColumn("geo", statistics.nuts2_of(F.col("geo")))).unpivot("geo", AGE_NAMES, "age", "weight").select(F.col("geo").alias("region"), F.substring("age", 5, 99).alias("age"), "weight")
    rates = shares.select("region", "age", F.when(F.col("age") == "between_20_64", 70.0).otherwise(12.0).alias("rate"))
    types = t.sector.select(statistics.nuts2_of(F.col("geo")).alias("region"), F.col("sector").alias("employment_type"), "value").groupBy("region", "employment_type").agg(F.sum("value").alias("weight"))
    return shares, rates, types


@query(f"""WITH a AS (SELECT left(geo, length(geo) - 1) AS region, CASE {' '.join(f"WHEN {_any('age', codes)} THEN '{g}'" for g, codes in statistics.AGE_GROUPS.items())} END AS age, sum(value) AS weight FROM fx_age GROUP BY 1, 2), ac AS ({cdf_sql('a', 'region', 'age', 'weight')}),
s AS (SELECT left(geo, length(geo) - 1) AS region, sector AS employment_type, sum(value) AS weight FROM fx_sector GROUP BY 1, 2), sc AS ({cdf_sql('s', 'region', 'employment_type', 'weight')}),
v AS (SELECT k.vc_id, k.region, d.* EXCLUDE (vc_id) FROM (SELECT vc_id, region FROM fx_commuters) k JOIN fx_draws d ON k.vc_id = d.vc_id)
SELECT v.vc_id, v.region, ac.age, ac.age <> 'under_20' AND u6 * 100 <= CASE WHEN ac.age = 'between_20_64' THEN 70e0 ELSE 12e0 END AS employed, CASE WHEN ac.age <> 'under_20' AND u6 * 100 <= CASE WHEN ac.age = 'between_20_64' THEN 70e0 ELSE 12e0 END THEN sc.employment_type END AS employment_type
FROM v JOIN ac ON v.region = ac.region AND (u5 > ac.cum_lo OR u5 = 0 AND ac.cum_lo = 0) AND u5 <= ac.cum_hi JOIN sc ON v.region = sc.region AND (u7 > sc.cum_lo OR u7 = 0 AND sc.cum_lo = 0) AND u7 <= sc.cum_hi""")
def attributes(t: Tables) -> DataFrame:
    return sampling.attributes(t.commuters.select("vc_id", "region"), *_regional(t)).select("vc_id", "region", "age", "employed", "employment_type")


INTERESTS = ["education", "work_agricultural", "work_industrial", "work_commercial", "work_office", "work_social"]
JOB = "CASE c_custkey % 6 WHEN 0 THEN 'agricultural' WHEN 1 THEN 'industrial' WHEN 2 THEN 'commercial' WHEN 3 THEN 'office' WHEN 4 THEN 'social' END"


def _workers(t: Tables) -> DataFrame:
    return t.commuters.select("vc_id", "age", F.expr(JOB.replace("c_custkey", "vc_id")).alias("employment_type"))


@query(f"""WITH w AS (SELECT vc_id, age, {JOB.replace('c_custkey', 'vc_id')} AS job FROM fx_commuters), i AS (SELECT vc_id, CASE WHEN age = 'under_20' THEN 'education' WHEN job IS NOT NULL THEN 'work_' || job END AS interest FROM w),
long AS ({' UNION ALL '.join(f"SELECT cell, '{k}' AS interest, {k} AS area FROM fx_tiles" for k in INTERESTS)}), c AS ({cdf_sql('long', 'interest', 'cell', 'area')})
SELECT i.vc_id, i.interest, c.cell AS destination_cell FROM i JOIN fx_draws d ON i.vc_id = d.vc_id LEFT JOIN c ON i.interest = c.interest AND (u8 > cum_lo OR u8 = 0 AND cum_lo = 0) AND u8 <= cum_hi""")
def destinations(t: Tables) -> DataFrame:
    out = sampling.destinations(_workers(t), t.tiles, INTERESTS)
    interest = F.when(F.col("age") == "under_20", "education").when(F.col("employment_type").isNotNull(), F.concat(F.lit("work_"), F.col("employment_type")))
    return out.select("vc_id", interest.alias("interest"), "destination_cell")




def _count(p: str, u: str) -> str:
    return f"CASE WHEN {p} > 2 THEN CAST(2 + floor({u} * (ceil({p}) - 1)) AS INTEGER) WHEN {p} > 1 THEN CASE WHEN {u} < {p} - 1 THEN 2 ELSE 1 END WHEN {u} < {p} THEN 1 END"


@query(f"SELECT k.vc_id, CASE WHEN age <> 'under_20' THEN {_count('1.3e0', 'u12')} END AS car, CASE WHEN age <> 'under_20' THEN {_count('0.2e0', 'u13')} END AS moto, CASE WHEN age <> 'under_20' THEN {_count('2.6e0', 'u14')} END AS utilities FROM fx_commuters k JOIN fx_draws d ON k.vc_id = d.vc_id")
def vehicles(t: Tables) -> DataFrame:
    means = t.commuters.select("region").distinct().select("region", F.lit(1.3).alias("vehicle_car"), F.lit(0.2).alias("vehicle_moto"), F.lit(2.6).alias("vehicle_utilities"))
    return sampling.vehicles(t.commuters.select("vc_id", "age", "region"), means).select("vc_id", "car", "moto", "utilities")


@query("SELECT vc_id, CASE WHEN utilities > 0 AND u17 < 0.95 THEN 'utilities' WHEN moto > 0 AND distance > 3000 AND u16 < 0.9 THEN 'moto' WHEN car > 0 AND distance > 3000 AND u15 < 0.9 THEN 'car' END AS usage FROM (SELECT k.vc_id, car, moto, utilities, k.vc_id % 6000 AS distance, u15, u16, u17 FROM fx_commuters k JOIN fx_draws d ON k.vc_id = d.vc_id) v")
def usage(t: Tables) -> DataFrame:
    rows = t.commuters.select("vc_id", "car", "moto", "utilities", (F.col("vc_id") % 6000).cast("double").alias("distance"))
    return sampling.vehicle_usage(rows).select("vc_id", "usage")


def _plane(lon: str, lat: str) -> tuple[str, str]:
    """SQL of a point's projected x and y."""
    v = f"sin(radians({lat}))"
    y = f"{1 - geo.E2!r}e0 * ({v} / (1 - {geo.E2!r}e0 * {v} * {v}) - {1 / (2 * geo.E1)!r}e0 * ln((1 - {geo.E1!r}e0 * {v}) / (1 + {geo.E1!r}e0 * {v}))) * {geo.A / (2 * geo.K0)!r}e0"
    return f"radians({lon}) * {geo.A * geo.K0!r}e0", y


def _point_sql(side: str, u: str, v: str) -> tuple[str, str]:
    """SQL of the degrees of a drawn point in the cell of q and r."""
    pole = 1 - (1 - geo.E2) / (2 * geo.E1) * math.log((1 - geo.E1) / (1 + geo.E1))
    a, b = (f"CASE WHEN {u} + {v} > 1 THEN 1 - {x} ELSE {x} END" for x in (u, v))
    turn = lambda f, k: f"{f}(pi() / 6 + (floor({side} * 6) + {k}) * pi() / 3)"
    at = lambda f: f"{geo.SIDE!r}e0 * (({a}) * {turn(f, 0)} + ({b}) * {turn(f, 1)})"
    x, y = f"((q + r / 2) * {geo.SIDE * math.sqrt(3)!r}e0 + {at('cos')})", f"(r * {geo.SIDE * 1.5!r}e0 + {at('sin')})"
    beta, e2 = f"asin({y} * {2 * geo.K0 / geo.A / pole!r})", geo.E2
    series = [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]
    lat = " + ".join(f"{c:.20e} * sin({2 * k} * {beta})" for k, c in enumerate(series, 1))
    return f"degrees({x} / {geo.A * geo.K0!r}e0)", f"degrees({beta} + {lat})"


def _commuters_sql() -> str:
    """All steps one after the other: home, age, employment, destination, vehicles, usage."""
    hit = lambda u, c: f"({u} > {c}.cum_lo OR {u} = 0 AND {c}.cum_lo = 0) AND {u} <= {c}.cum_hi"
    hlon, hlat = _point_sql("u2", "u3", "u4")
    wlon, wlat = _point_sql("u9", "u10", "u11")
    (hx, hy), (wx, wy) = _plane("origin_lon", "origin_lat"), _plane("destination_lon", "destination_lat")
    cases = " ".join(f"WHEN {_any('age', codes)} THEN '{g}'" for g, codes in statistics.AGE_GROUPS.items())
    named = {"A": "agricultural", "F": "industrial", "G-I": "commercial", "J": "office", "O-Q": "social"}
    jobs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in named.items())
    weight = lambda v: f"(exp({_park(*tiles.PARKING['origin'][v])}) / sum(exp({_park(*tiles.PARKING['origin'][v])})) OVER ()) / (population / sum(population) OVER ())"
    means = {"car": "1.3e0 * coalesce(g.car_weight, 1e0)", "moto": "0.2e0 * coalesce(g.moto_weight, 1e0)", "utilities": "0.1e0"}
    owned = ", ".join(f"CASE WHEN age <> 'under_20' THEN {_count(f'({p})', u)} END AS {v}" for (v, p), u in zip(means.items(), ("u12", "u13", "u14")))
    return f"""WITH grid AS (SELECT *, (q + {geo.OFFSET}) * {geo.SPAN} + r + {geo.OFFSET} AS tile, {weight('car')} AS car_weight, {weight('moto')} AS moto_weight, {_park(*tiles.PARKING['destination']['car'])} AS to_car, {_park(*tiles.PARKING['destination']['moto'])} AS to_moto
  FROM (SELECT *, cell % 150 AS q, CAST(floor(cell / 150) AS BIGINT) AS r FROM fx_tiles WHERE population IS NOT NULL) g),
pc AS ({cdf_sql('grid', '', 'tile', 'population')}), home AS (SELECT d.*, g.tile AS origin_cell, g.region, {hlon} AS origin_lon, {hlat} AS origin_lat FROM fx_seeded d JOIN pc ON {hit('u1', 'pc')} JOIN grid g ON pc.tile = g.tile),
age_weights AS (SELECT left(geo, length(geo) - 1) AS region, CASE {cases} END AS age, sum(value) AS weight FROM fx_age GROUP BY 1, 2), ac AS ({cdf_sql('age_weights', 'region', 'age', 'weight')}),
jobs AS (SELECT left(geo, length(geo) - 1) AS region, CASE sector {jobs} END AS employment_type, sum(value) AS weight FROM fx_sector WHERE {_any('sector', tuple(named))} GROUP BY 1, 2), jc AS ({cdf_sql('jobs', 'region', 'employment_type', 'weight')}),
aged AS (SELECT h.*, ac.age, coalesce(ac.age <> 'under_20' AND u6 * 100 <= CASE WHEN ac.age = 'between_20_64' THEN 70e0 ELSE 12e0 END, false) AS employed FROM home h LEFT JOIN ac ON h.region = ac.region AND {hit('u5', 'ac')}),
typed AS (SELECT a.*, CASE WHEN employed THEN jc.employment_type END AS employment_type FROM aged a LEFT JOIN jc ON a.region = jc.region AND {hit('u7', 'jc')}),
wished AS (SELECT *, CASE WHEN age = 'under_20' THEN 'education' WHEN employment_type IS NOT NULL THEN 'work_' || employment_type END AS interest FROM typed),
long AS ({' UNION ALL '.join(f"SELECT tile, '{k}' AS interest, {k} AS area FROM grid" for k in INTERESTS)}), ic AS ({cdf_sql('long', 'interest', 'tile', 'area')}),
going AS (SELECT w.vc_id, ic.tile AS destination_cell, g.to_car, g.to_moto, {wlon} AS destination_lon, {wlat} AS destination_lat FROM wished w JOIN ic ON w.interest = ic.interest AND {hit('u8', 'ic')} JOIN grid g ON ic.tile = g.tile),
owning AS (SELECT w.* EXCLUDE (interest), destination_cell, t.to_car, t.to_moto, destination_lon, destination_lat, {owned} FROM wished w LEFT JOIN going t ON w.vc_id = t.vc_id JOIN grid g ON w.origin_cell = g.tile),
far AS (SELECT *, coalesce(round(sqrt(pow({hx} - {wx}, 2) + pow({hy} - {wy}, 2)), 2), 0e0) AS distance FROM owning)
SELECT vc_id, 's1' AS sim_id, origin_cell, round(origin_lon, 6) AS origin_lon, round(origin_lat, 6) AS origin_lat, region, age, employed, employment_type, destination_cell, round(destination_lon, 6) AS destination_lon, round(destination_lat, 6) AS destination_lat, car, moto, utilities, distance,
CASE WHEN utilities > 0 AND u17 < 0.95 THEN 'utilities' WHEN moto > 0 AND distance > 3000 AND u16 < coalesce(to_moto, 0) THEN 'moto' WHEN car > 0 AND distance > 3000 AND u15 < coalesce(to_car, 0) THEN 'car' END AS usage FROM far"""


@query(_commuters_sql())
def commuters(t: Tables) -> DataFrame:
    shares, rates, types = _regional(t)
    cells = _cells(t).where("population is not null")
    regions = cells.select("region").distinct()
    means = regions.select("region", F.lit(1.3).alias("vehicle_car"), F.lit(0.2).alias("vehicle_moto"), F.lit(0.1).alias("vehicle_utilities"))
    named = types.where(F.col("employment_type").isin("A", "F", "G-I", "J", "O-Q")).replace({"A": "agricultural", "F": "industrial", "G-I": "commercial", "J": "office", "O-Q": "social"}, subset=["employment_type"])
    parked = tiles.add_parking(cells)
    weights = tiles.parking_weights(parked, "car").withColumnRenamed("weight", "car_weight").join(tiles.parking_weights(parked, "moto").withColumnRenamed("weight", "moto_weight"), "cell")
    n = t.base("customer").count()
    return rounded(sampling.generate(t.spark, n, sim_id="s1", tiles=cells, shares=shares, rates=rates, types=named, means=means, interests=INTERESTS, weights=weights, parking=parked, seed=1), 6)


ROADS = f"v AS ({celled('fx_roads')}), pc AS (SELECT *, idx - row_number() OVER (PARTITION BY road_id, cell ORDER BY idx) AS piece FROM v)"


STEPS = f"""xy AS (SELECT *, radians(lon) * {geo.A * geo.K0!r}e0 AS x, {geo.A / (2 * geo.K0)!r}e0 * ({1 - geo.E2!r}e0 * (sin(radians(lat)) / (1 - {geo.E2!r}e0 * pow(sin(radians(lat)), 2)) - {1 / (2 * geo.E1)!r}e0 * ln((1 - {geo.E1!r}e0 * sin(radians(lat))) / (1 + {geo.E1!r}e0 * sin(radians(lat)))))) AS y FROM pc),
d AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM xy WINDOW w AS (PARTITION BY road_id, cell, piece ORDER BY idx)), lengths AS (SELECT road_id, cell, piece, count(*) AS n_points, CASE WHEN count(*) = 1 THEN 1e0 ELSE round(coalesce(sum(d), 0), 2) END AS length FROM d GROUP BY 1, 2, 3)"""


@query(f"""WITH {ROADS}, {STEPS}
SELECT road_id, cell, CAST(piece AS BIGINT) AS piece, n_points, length, round(length / sum(length) OVER (PARTITION BY cell), 6) AS share FROM lengths""")
def road_pieces(t: Tables) -> DataFrame:
    vertices = t.roads.withColumn("cell", geo.cell_of(F.col("lon"), F.col("lat")))
    return rounded(roads_of.piece_lengths(roads_of.road_pieces(vertices)).withColumn("piece", F.col("piece").cast("long")), length=2)


@query(f"""WITH {ROADS}, {STEPS}, l AS (SELECT *, CAST(road_id AS VARCHAR) || '/' || CAST(piece AS VARCHAR) AS name FROM lengths), c AS ({cdf_sql('l', 'cell', 'name', 'length')}), h AS ({celled('fx_commuters', 'olon', 'olat')}),
drawn AS (SELECT h.vc_id, h.cell, c.name, u24 FROM h JOIN fx_draws w ON h.vc_id = w.vc_id JOIN c ON h.cell = c.cell AND (u23 > cum_lo OR u23 = 0 AND cum_lo = 0) AND u23 <= cum_hi),
segments AS (SELECT *, sum(s) OVER w AS upto, sum(s) OVER (PARTITION BY road_id, cell, piece) AS whole FROM (SELECT road_id, cell, piece, idx, x, y, coalesce(lead(x) OVER w - x, 0) AS dx, coalesce(lead(y) OVER w - y, 0) AS dy, lead(x) OVER w IS NULL AS ends,
  coalesce(sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)), 0) AS s, count(*) OVER (PARTITION BY road_id, cell, piece) AS n FROM xy WINDOW w AS (PARTITION BY road_id, cell, piece ORDER BY idx)) q WINDOW w AS (PARTITION BY road_id, cell, piece ORDER BY idx ROWS UNBOUNDED PRECEDING)),
hit AS (SELECT vc_id, d.cell, g.road_id, g.piece, idx, x, y, dx, dy, CASE WHEN s > 0 THEN (u24 * whole - (upto - s)) / s ELSE 0 END AS part FROM drawn d JOIN l ON d.cell = l.cell AND d.name = l.name JOIN segments g ON l.road_id = g.road_id AND l.cell = g.cell AND l.piece = g.piece
  WHERE (NOT ends OR n = 1) AND u24 * whole >= upto - s AND (u24 * whole <= upto OR n = 1))
SELECT vc_id, cell, road_id, CAST(piece AS BIGINT) AS piece, round(x + part * dx, 3) AS x, round(y + part * dy, 3) AS y FROM hit QUALIFY row_number() OVER (PARTITION BY vc_id ORDER BY idx) = 1""")
def road_points(t: Tables) -> DataFrame:
    vertices = t.roads.withColumn("cell", geo.cell_of(F.col("lon"), F.col("lat")))
    pieces = roads_of.road_pieces(vertices)
    rows = t.commuters.select("vc_id", geo.cell_of(F.col("olon"), F.col("olat")).alias("cell"))
    return rounded(roads_of.points_on_roads(rows, pieces).withColumn("piece", F.col("piece").cast("long")), 3)
