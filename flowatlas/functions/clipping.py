"""Areas of polygons inside cells: half-planes cut all rings of a batch at once, over flat arrays and offsets.

A ring is first clipped to squares of some hundred cells, then what is left of it to the cells of each square, so a long
ring isn't cut anew for each cell. Squares that lie wholly inside give their cells' areas without clipping.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from flowatlas.functions import geo

#: Side of a square of cells, in rows of cells; a square's window is wider by a cell's radius.
BLOCK = 16 * geo.SIDE * 1.5
HALF = BLOCK / 2 + geo.SIDE
SQUARE = np.array([(-HALF, -HALF), (HALF, -HALF), (HALF, HALF), (-HALF, HALF)])
HEXAGON = geo.SIDE * np.array([(math.cos(math.pi / 6 + k * math.pi / 3), math.sin(math.pi / 6 + k * math.pi / 3)) for k in range(6)])

PIECE = StructType([StructField("x", ArrayType(DoubleType())), StructField("y", ArrayType(DoubleType())), StructField("area", DoubleType())])
Rings = tuple[np.ndarray, np.ndarray, np.ndarray]


def _after(offsets: np.ndarray) -> np.ndarray:
    """The next corner of each corner; the first one of its ring after the last."""
    after = np.arange(1, offsets[-1] + 1)
    some = offsets[1:] > offsets[:-1]
    after[offsets[1:][some] - 1] = offsets[:-1][some]
    return after


def cut(rings: Rings, a: np.ndarray, b: np.ndarray) -> Rings:
    """What of each ring lies on the left of the line from a to b."""
    x, y, offsets = rings
    n, after = len(offsets) - 1, _after(offsets)
    side = (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])
    ahead, keep = side[after], side >= 0
    cross = keep != (ahead >= 0)
    first = np.cumsum(keep.astype(np.int64) + cross) - keep - cross
    size = int(keep.sum() + cross.sum())
    part = side[cross] / (side[cross] - ahead[cross])
    out = []
    for v in (x, y):
        new = np.empty(size)
        new[first[keep]] = v[keep]
        new[(first + keep)[cross]] = v[cross] + (v[after][cross] - v[cross]) * part
        out.append(new)
    ring = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(ring[keep], minlength=n) + np.bincount(ring[cross], minlength=n)
    return out[0], out[1], np.r_[0, np.cumsum(counts)]


def clipped(rings: Rings, window: np.ndarray) -> Rings:
    """Each ring inside a convex window (counter-clockwise)."""
    for a, b in zip(window, np.roll(window, -1, axis=0)):
        rings = cut(rings, a, b)
    return rings


def areas(rings: Rings) -> np.ndarray:
    x, y, offsets = rings
    after = _after(offsets)
    ring = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.abs(np.bincount(ring, weights=x * y[after] - x[after] * y, minlength=len(offsets) - 1)) / 2


def _around(xs: pa.Array, ys: pa.Array, cx: pa.Array, cy: pa.Array) -> Rings:
    """Rings with their coordinates seen from each row's centre."""
    lengths = pc.fill_null(pc.list_value_length(xs), 0).to_numpy()
    at = [np.repeat(c.to_numpy(zero_copy_only=False), lengths) for c in (cx, cy)]
    return pc.list_flatten(xs).to_numpy(zero_copy_only=False) - at[0], pc.list_flatten(ys).to_numpy(zero_copy_only=False) - at[1], np.r_[0, np.cumsum(lengths)]


@F.arrow_udf(PIECE)
def in_square(xs: pa.Array, ys: pa.Array, cx: pa.Array, cy: pa.Array) -> pa.Array:
    """The rings inside the squares around (cx, cy), seen from there, and their areas."""
    rings = clipped(_around(xs, ys, cx, cy), SQUARE)
    offsets = pa.array(rings[2], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in rings[:2]]
    return pa.StructArray.from_arrays([*lists, pa.array(areas(rings))], ["x", "y", "area"])


@F.arrow_udf(DoubleType())
def in_hexagon(xs: pa.Array, ys: pa.Array, cx: pa.Array, cy: pa.Array) -> pa.Array:
    """The rings' areas inside the cells around (cx, cy)."""
    return pa.array(areas(clipped(_around(xs, ys, cx, cy), HEXAGON)))


def areas_by_cell(shapes: DataFrame, key: str, cells: DataFrame | None = None) -> DataFrame:
    """(key, cell, area) of each ring (ARRAY<STRUCT<x, y>>, projected) in each cell it covers some of; a row for a ring of ``shapes``.

    ``cells`` (cell) leaves out all others before they are clipped. Rings of less than three corners have no area.
    """
    height, width = geo.SIDE * 1.5, geo.SIDE * math.sqrt(3)
    rows = shapes.select(key, F.transform("ring", lambda p: p["x"]).alias("_xs"), F.transform("ring", lambda p: p["y"]).alias("_ys")).where(F.size("_xs") > 2)
    rows = rows.select("*", *[f(v).alias(n) for n, f, v in (("_x0", F.array_min, "_xs"), ("_x1", F.array_max, "_xs"), ("_y0", F.array_min, "_ys"), ("_y1", F.array_max, "_ys"))])
    squares = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - geo.SIDE) / BLOCK), F.floor((F.col(b) + geo.SIDE) / BLOCK)))
    rows = rows.withColumn("_bx", squares("_x0", "_x1")).withColumn("_by", squares("_y0", "_y1"))
    centre = [((F.col(c) + 0.5) * BLOCK).alias(n) for c, n in (("_bx", "_cx"), ("_by", "_cy"))]
    rows = rows.select("*", *centre).withColumn("_in", in_square("_xs", "_ys", "_cx", "_cy")).drop("_xs", "_ys").where("_in.area > 0")
    whole = F.col("_in.area") >= (2 * HALF) ** 2 * (1 - 1e-12)
    steps = lambda low, high: F.explode(F.sequence(F.ceil(low), F.ceil(high) - 1))
    rows = rows.withColumn("_r", steps(F.col("_by") * BLOCK / height, (F.col("_by") + 1) * BLOCK / height))
    rows = rows.withColumn("_q", steps(F.col("_bx") * BLOCK / width - F.col("_r") / 2, (F.col("_bx") + 1) * BLOCK / width - F.col("_r") / 2))
    rows = rows.withColumn("cell", geo.cell_id(F.col("_q"), F.col("_r")))
    x, y = geo.centre_x(F.col("cell")), geo.centre_y(F.col("cell"))
    near = x.between(F.col("_x0") - geo.SIDE, F.col("_x1") + geo.SIDE) & y.between(F.col("_y0") - geo.SIDE, F.col("_y1") + geo.SIDE)
    none = F.array().cast("array<double>")
    left = lambda c: F.when(whole, none).otherwise(F.col(f"_in.{c}")).alias(f"_{c}")
    rows = rows.where(near).select(key, "cell", whole.alias("_whole"), left("x"), left("y"), (x - F.col("_cx")).alias("_cx"), (y - F.col("_cy")).alias("_cy"))
    if cells is not None:
        rows = rows.join(cells.select("cell"), "cell", "left_semi")
    area = F.when(F.col("_whole"), F.lit(1.5 * math.sqrt(3) * geo.SIDE**2)).otherwise(in_hexagon("_x", "_y", "_cx", "_cy"))
    return rows.select(key, "cell", area.alias("area")).where("area > 0")
