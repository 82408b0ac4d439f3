"""Tiles of a place: cover, population, zones, regions, density, parking, flows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowatlas.functions import geo
from flowatlas.functions.clipping import areas_by_cell

#: Area that a land-use point stands for, in square metres.
POINT_AREA = 100.0
#: Tag classes of land use; True: the key is there, a list: one of the values. Any key is enough.
ZONE_TAGS = {
    "work_agricultural": {"landuse": ["aquaculture", "farmyard"]},
    "work_industrial": {"landuse": ["industrial", "construction", "port", "quarry"]},
    "work_commercial": {"landuse": ["retail", "commercial"], "shop": True, "amenity": ["restaurant", "fast_food"]},
    "work_office": {"office": True},
    "work_social": {"landuse": ["institutional", "civic_admin", "education"], "amenity": ["kindergarten", "school", "college", "university"], "healthcare": True},
    "education": {"landuse": ["education"], "amenity": ["kindergarten", "school", "college", "university"]},
    "leisure": {"landuse": ["fairground", "retail", "recreation_ground", "religious", "winter_sports"], "shop": True, "leisure": True, "sport": True, "tourism": True},
    "empty": {
        "landuse": ["allotments", "farmland", "paddy", "animal_keeping", "flowerbed", "forest", "grass", "greenhouse_horticulture", "meadow", "orchard", "plant_nursery", "vineyard", "village_green", "greenfield", "brownfield", "landfill", "cemetery", "garages", "military", "railway"],
        "natural": ["water"],
    },
    "buildings_1": {"building": ["apartments", "house", "commercial", "retail", "farm", "hotel"]},
    "buildings_2": {"building": ["industrial", "yes"], "landuse": ["construction"]},
    "no_parking": {
        "landuse": ["allotments", "farmland", "animal_keeping", "flowerbed", "forest", "grass", "greenhouse_horticulture", "meadow", "orchard", "plant_nursery", "vineyard", "village_green", "greenfield", "brownfield", "landfill", "cemetery", "military", "railway"],
        "natural": ["water", "wood", "riverbed"],
    },
}
WORK = tuple(c for c in ZONE_TAGS if c.startswith("work_"))
#: Geometry kinds a class is restricted to.
ONLY = {"work_office": "Point", "work_industrial": "Polygon", "buildings_1": "Polygon", "buildings_2": "Polygon", "no_parking": "Polygon"}
#: Parking chance by vehicle: density from which the least holds, density up to which the largest, both.
PARKING = {end: {"car": (0.8, 0.3, 0.3, 1.0), "moto": (0.95, 0.3, 0.4, 1.0)} for end in ("destination", "origin")}


def tile_cover(polygons: DataFrame) -> DataFrame:
    """(place_id, cell): cells whose centre lies in the polygon.

    ``polygons`` has place_id and ring (ARRAY<STRUCT<x, y>>, projected metres), a row per part. Rows and columns of the
    grid within the bounding box are exploded, then tested by their centres.
    """
    height, width = geo.SIDE * 1.5, geo.SIDE * math.sqrt(3)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxes = polygons.select("place_id", "ring", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    rows = boxes.withColumn("r", F.explode(F.sequence(F.floor(F.col("y0") / height).cast("long"), F.ceil(F.col("y1") / height).cast("long"))))
    rows = rows.withColumn("q", F.explode(F.sequence(F.floor(F.col("x0") / width - F.col("r") / 2).cast("long"), F.ceil(F.col("x1") / width - F.col("r") / 2).cast("long"))))
    rows = rows.withColumn("cell", geo.cell_id(F.col("q"), F.col("r")))
    return rows.where(geo.in_ring_column(geo.centre_x(F.col("cell")), geo.centre_y(F.col("cell")), F.col("ring"))).select("place_id", "cell").distinct()


def tile_region(tiles: DataFrame, regions: DataFrame) -> DataFrame:
    """(cell, region): the region with the largest area in the tile, of equal ones the first by id; with none, the first region.

    ``regions`` has region and ring, a row per part; areas of a region's parts add up. Areas count to a thousandth.
    """
    summed = areas_by_cell(regions, "region", tiles).groupBy("cell", "region").agg(F.round(F.sum("area"), 3).alias("_a"))
    best = summed.groupBy("cell").agg(F.min(F.struct((-F.col("_a")).alias("less"), "region"))["region"].alias("region"))
    first = regions.agg(F.min("region").alias("_first"))
    return tiles.select("cell").join(best, "cell", "left").join(F.broadcast(first)).select("cell", F.coalesce("region", "_first").alias("region"))


def has_tag(tags: Column, rules: dict) -> Column:
    """Whether any of the rules holds: key there (True) or its value among those listed."""
    found = F.lit(False)
    for key, values in rules.items():
        value = F.try_element_at(tags, F.lit(key))
        found = found | F.coalesce(value.isNotNull() if values is True else value.isin(*values), F.lit(False))
    return found


def zone_classes(features: DataFrame) -> DataFrame:
    """``features`` (feature_id, geom_type, tags) once per class it belongs to, as ``zone``; geometry kinds restricted."""
    fits = [F.when(has_tag(F.col("tags"), rules) & ((F.col("geom_type") == ONLY[c]) if c in ONLY else F.lit(True)), F.lit(c)) for c, rules in ZONE_TAGS.items()]
    return features.withColumn("zone", F.explode(F.array_compact(F.array(*fits))))


def zone_points(zoned: DataFrame) -> DataFrame:
    """(cell, zone, area): 100 m² for each point feature (x, y projected) in the tile."""
    points = zoned.where(F.col("geom_type") == "Point")
    return points.groupBy(geo.cell_of_plane(F.col("x"), F.col("y")).alias("cell"), "zone").agg((F.count(F.lit(1)) * F.lit(POINT_AREA)).alias("area"))


def zone_areas(zoned: DataFrame) -> DataFrame:
    """(cell, zone, area): polygons' area in each tile, overlaps counted twice, plus 100 m² per point.

    ``zoned`` has feature_id, geom_type, zone, x, y (points) and ring (polygons, projected).
    """
    polygons = zoned.where(F.col("geom_type") == "Polygon")
    shapes = polygons.select("feature_id", "ring").dropDuplicates(["feature_id"])
    areas = areas_by_cell(shapes, "feature_id")
    by_zone = polygons.select("feature_id", "zone").join(areas, "feature_id").groupBy("cell", "zone").agg(F.sum("area").alias("area"))
    return by_zone.unionByName(zone_points(zoned)).groupBy("cell", "zone").agg(F.sum("area").alias("area"))


def tile_rollup(tiles: DataFrame) -> DataFrame:
    """``tiles`` with work (sum of the five work zones) and building_density (buildings and no-parking land by area)."""
    density = F.try_divide(F.col("buildings_1") + F.col("buildings_2") + F.col("no_parking"), F.col("tile_area"))
    return tiles.withColumn("work", sum((F.col(c) for c in WORK), F.lit(0.0))).withColumn("building_density", density)


def parking_probability(density: Column, high: float, low: float, least: float, most: float) -> Column:
    """``least`` from density ``high`` on, ``most`` up to ``low``, linear between; rounded to 4, half to even."""
    between = most + (least - most) * (density - low) / (high - low)
    return F.bround(F.when(density >= high, F.lit(least)).when(density <= low, F.lit(most)).otherwise(between), 4)


def add_parking(tiles: DataFrame) -> DataFrame:
    return tiles.withColumns({f"parking_{end}_{v}": parking_probability(F.col("building_density"), *limits) for end, by in PARKING.items() for v, limits in by.items()})


def parking_weights(tiles: DataFrame, vehicle: str = "car") -> DataFrame:
    """(cell, weight): softmax share of home parking over the tile's population share; once per tile."""
    parking = F.exp(F.col(f"parking_origin_{vehicle}"))
    totals = tiles.agg(F.sum(parking).alias("_p"), F.sum("population").alias("_n"))  # one row
    return tiles.join(F.broadcast(totals)).select("cell", F.try_divide(parking / F.col("_p"), F.col("population") / F.col("_n")).alias("weight"))


def with_population(tiles: DataFrame, grid: DataFrame, *, impute: bool = True) -> DataFrame:
    """``tiles`` with the grid's population; tiles without any get the median of those with (or null)."""
    joined = tiles.join(grid.select("cell", "population"), "cell", "left")
    if not impute:
        return joined
    middle = joined.agg(F.median("population").alias("_m"))  # one row
    return joined.join(F.broadcast(middle)).withColumn("population", F.coalesce("population", "_m")).drop("_m")


def merge_fields(tiles: DataFrame, fields: DataFrame) -> DataFrame:
    """``tiles`` with the new fields by cell; fields of the same name are replaced."""
    return tiles.drop(*[c for c in fields.columns if c != "cell"]).join(fields, "cell", "left")


def merge_places(tiles: list[DataFrame], *, distinct_cells: bool = False) -> DataFrame:
    """All places' tiles together, repeated ones kept unless ``distinct_cells``."""
    out = tiles[0]
    for more in tiles[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["cell"]) if distinct_cells else out


def place_summary(tiles: DataFrame) -> DataFrame:
    """place, city, country, number of tiles, and the sorted regions of each place (name "City, Country")."""
    from flowatlas.functions.predicates import city_of, country_of

    grouped = tiles.groupBy("place").agg(F.count(F.lit(1)).alias("n_tiles"), F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))
    return grouped.select("place", city_of(F.col("place")).alias("city"), country_of(F.col("place")).alias("country"), "n_tiles", "regions")


def place_documents(tiles: DataFrame, shapes: DataFrame) -> DataFrame:
    """A document for each place: city, country, n_tiles, the sorted cells of its tiles and their sorted regions, shape and box.

    ``tiles`` has place ("City, Country"), cell and region; ``shapes`` has place and ring (ARRAY<STRUCT<x, y>>), a row for
    each part. The shape is a MULTIPOLYGON in millimetres' precision, its parts in the order of their text; the box is
    min x, min y, max x, max y. Cells and regions that come twice are listed once. A place without a shape has none.
    """
    from flowatlas.functions.predicates import city_of, country_of

    listed = tiles.groupBy("place").agg(F.sort_array(F.collect_set("cell")).alias("tiles"), F.sort_array(F.collect_set("region")).alias("regions"))  # one place's list is what its document holds
    corner = lambda p: F.format_string("%.3f %.3f", p["x"], p["y"])
    closed = F.concat("ring", F.slice("ring", F.lit(1), F.lit(1)))
    part = F.concat(F.lit("(("), F.array_join(F.transform(closed, corner), ", "), F.lit("))"))
    ends = [f(F.transform("ring", lambda p: p[c])).alias(f"_{c}{k}") for k, f in enumerate((F.array_min, F.array_max)) for c in "xy"]
    drawn = shapes.where(F.size("ring") > 0).select("place", part.alias("_part"), *ends)
    box = F.array(*[f(c) for f, c in ((F.min, "_x0"), (F.min, "_y0"), (F.max, "_x1"), (F.max, "_y1"))]).alias("bbox")
    text = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.sort_array(F.collect_list("_part")), ", "), F.lit(")")).alias("shape")
    joined = listed.join(drawn.groupBy("place").agg(text, box), "place", "left")
    return joined.select(city_of(F.col("place")).alias("name"), country_of(F.col("place")).alias("country"), F.size("tiles").cast("long").alias("n_tiles"), "tiles", "regions", "shape", "bbox")


#: Origins of a place that meet its destinations in one task.
FLOW_BLOCK = 4096


def flows(tiles: DataFrame, origins: DataFrame | None = None, *, place: str = "place", base_work: float = 0.0) -> DataFrame:
    """(place, origin, destination, flow) for all pairs of a place's tiles: workers, pupils and others by the destination's shares.

    ``base_work`` is added to each tile's work area first, so that no tile is without any (500 m² is usual).

    ``tiles`` has the place, cell, work, education, leisure, workers, pupils, others. Each place's part is a full matrix by
    definition, so its size is the square of the place's tiles. Tiles meet by an equi-join on their place and a block of
    some FLOW_BLOCK of its origins, so that a large place is the work of many tasks; its destinations are sent to each block.
    """
    kinds = ("work", "education", "leisure")
    tiles = tiles.withColumn("work", F.coalesce("work", F.lit(0.0)) + base_work) if base_work else tiles
    totals = tiles.groupBy(place).agg(*[F.sum(c).alias(f"_{c}") for c in kinds])  # a row per place
    shares = [F.coalesce(F.try_divide(F.col(c), F.col(f"_{c}")), F.lit(0.0)).alias(f"_s{c}") for c in kinds]
    ends = tiles.join(totals, place).select(place, F.col("cell").alias("destination"), *shares)
    starts = (tiles if origins is None else origins).select(place, F.col("cell").alias("origin"), "workers", "pupils", "others")
    flow = F.col("_swork") * F.col("workers") + F.col("_seducation") * F.col("pupils") + F.col("_sleisure") * F.col("others")
    blocks = starts.groupBy(place).agg(F.ceil(F.count(F.lit(1)) / FLOW_BLOCK).alias("_blocks"))  # a row per place
    starts = starts.join(blocks, place).withColumn("_block", F.pmod(F.xxhash64("origin"), F.col("_blocks"))).drop("_blocks")
    ends = ends.join(blocks, place).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    return starts.join(ends, [place, "_block"]).select(place, "origin", "destination", flow.alias("flow"))
