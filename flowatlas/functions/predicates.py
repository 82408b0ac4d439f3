"""Predicates and small scalar functions on commuters, places, modes and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The travel modes of a journey, and the router's names for them.
MODES = ("train", "bus", "watercraft", "taxi", "gondola", "aircraft", "car", "bicycle", "walking")
ROUTER_MODES = {"WALK": "walking", "BUS": "bus", "RAIL": "train", "TRAM": "train", "SUBWAY": "train", "TRANSIT": "train", "BICYCLE": "bicycle", "CAR": "car"}


def should_route(origin: str = "origin", destination: str = "destination") -> Column:
    """Both ends are there with both coordinates."""
    return F.col(f"{origin}.lon").isNotNull() & F.col(f"{origin}.lat").isNotNull() & F.col(f"{destination}.lon").isNotNull() & F.col(f"{destination}.lat").isNotNull()


def has_motor_vehicle(*counts: str) -> Column:
    """Any of the vehicle counts is above 0."""
    return F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in counts], F.lit(0)) > 0


def has_motorcycle(moto: str = "moto") -> Column:
    return F.coalesce(F.col(moto), F.lit(0)) != 0


def departure_of(sim_date: Column) -> Column:
    """Eight in the morning (UTC) of the simulation's date."""
    return F.to_timestamp(F.concat(sim_date, F.lit("T08:00:00Z")))


def known_mode(mode: Column) -> Column:
    """The mode, or the empty string for anything unknown."""
    return F.when(mode.isin(*MODES), mode).otherwise("")


def router_mode(mode: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROUTER_MODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mode), F.lit(""))


def read_time(text: Column) -> Column:
    """RFC 3339 text, with or without zone and fraction, as a timestamp; null if unreadable."""
    return F.try_to_timestamp(text)


def percent(text: Column) -> Column:
    """The number of a text like ``12.5%``; 0 for null, empty or unreadable ones."""
    return F.coalesce(F.regexp_replace(text, "%", "").try_cast("double"), F.lit(0.0))


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9]+$"), F.lit(False))


def edge_key(lo: Column, hi: Column, date: Column) -> Column:
    return F.concat_ws("-", lo, hi, date)


def node_key(node: Column, date: Column) -> Column:
    return F.concat_ws("-", node, date)


def city_of(name: Column) -> Column:
    return F.trim(F.element_at(F.split(name, ","), 1))


def country_of(name: Column) -> Column:
    return F.trim(F.try_element_at(F.split(name, ","), F.lit(2)))
