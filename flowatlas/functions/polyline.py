"""Decoding of encoded polylines: one pass over the bytes of a whole batch of strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

LINE = ArrayType(StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())]))


def _codes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings less 63, and where each string starts; null is empty."""
    lines = lines.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = lines.buffers()
    at = np.frombuffer(offsets, np.int64, len(lines) + 1, 8 * lines.offset)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]].astype(np.int64) - 63, at - at[0]


def decode_batch(lines: pa.Array, precision: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitudes and latitudes of all lines, and where each line starts among them.

    A number is groups of five bits, low ones first, the last one below 32; numbers are zig-zag signed, latitude and
    longitude in turn, and add up along a line. What follows a line's last whole pair is left out.
    """
    code, at = _codes(lines)
    last = np.flatnonzero(code < 32)
    number_of = np.searchsorted(last, at)  # a line's numbers are those whose last group lies in it
    start = np.empty(len(last), np.int64)
    start[1:] = last[:-1] + 1
    start[:1] = 0
    first = np.flatnonzero(number_of[1:] > number_of[:-1])
    start[number_of[first]] = at[first]  # not what an earlier line left unfinished
    length = last - start + 1
    group = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    bits = (code[np.repeat(start, length) + group] & 31) << np.minimum(5 * group, 60)
    values = np.add.reduceat(bits, np.cumsum(length) - length) if len(last) else bits
    steps = np.where(values & 1, ~(values >> 1), values >> 1)
    counts = np.diff(number_of) // 2  # whole pairs
    offsets = np.r_[0, np.cumsum(counts)]
    pair = np.repeat(number_of[:-1], counts) + 2 * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts))
    out = []
    for side in (1, 0):
        sums = np.cumsum(steps[pair + side])
        before = np.r_[0, sums][offsets[:-1]]
        out.append((sums - np.repeat(before, counts)) / 10.0**precision)
    return out[0], out[1], offsets


def decode(text: str, precision: int = 5) -> np.ndarray:
    """(lat, lon) rows of one encoded polyline."""
    lon, lat, _ = decode_batch(pa.array([text]), precision)
    return np.stack((lat, lon), axis=1)


def encode(points: list[tuple[float, float]], precision: int = 5) -> str:
    """The encoded polyline of (lat, lon) points."""
    out, before = [], (0, 0)
    for point in points:
        now = tuple(round(v * 10**precision) for v in point)
        for a, b in zip(now, before):
            v = (a - b) << 1
            v = ~v if a < b else v
            while v >= 32:
                out.append(chr((32 | (v & 31)) + 63))
                v >>= 5
            out.append(chr(v + 63))
        before = now
    return "".join(out)


@F.arrow_udf(LINE)
def decode_polyline(lines: pa.Array) -> pa.Array:
    """Array of (lon, lat) per string; null for null."""
    lon, lat, offsets = decode_batch(lines)
    points = pa.StructArray.from_arrays([pa.array(lon), pa.array(lat)], ["lon", "lat"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points, mask=lines.is_null())
