"""Reproducible uniform draws: an integer mix of key, salt and seed that any engine computes alike."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Salt(IntEnum):
    """One salt per draw, so that draws of one commuter are independent."""

    HOME = 1
    HOME_SIDE = 2
    HOME_U = 3
    HOME_V = 4
    AGE = 5
    EMPLOYED = 6
    EMPLOYMENT = 7
    WORK = 8
    WORK_SIDE = 9
    WORK_U = 10
    WORK_V = 11
    CAR = 12
    MOTO = 13
    UTILITIES = 14
    USE_CAR = 15
    USE_MOTO = 16
    USE_UTILITIES = 17
    OWN_OVERRIDE = 18
    USE_OVERRIDE = 19
    DELAY = 20
    DELAY_BIN = 21
    DELAY_MINUTE = 22
    ROAD = 23
    ROAD_AT = 24
    START = 25


#: Odd multipliers below 2^31, so that their products with 32 bits stay within 63 bits in any engine.
LOW, HIGH, MIX = 668265261, 374761393, 73244475
MASK = 2**32 - 1


def uniform(key: Column, salt: int, seed: int = 0) -> Column:
    """A number in [0, 1) for any whole key of 64 bits: its halves are mixed in one after the other."""
    mixed = lambda x: F.shiftright(x, 16).bitwiseXOR(x) * F.lit(MIX) % F.lit(MASK + 1)
    key = key.cast("long")
    low, high = key.bitwiseAND(F.lit(MASK)), F.shiftright(key, 32).bitwiseAND(F.lit(MASK))
    x = mixed(mixed((low * F.lit(LOW) + F.lit((salt * 40503 + seed * 69069) % (MASK + 1))) % F.lit(MASK + 1)))
    x = mixed(mixed((x + high * F.lit(HIGH)) % F.lit(MASK + 1)))
    return F.shiftright(x, 16).bitwiseXOR(x) / F.lit(4294967296.0)
