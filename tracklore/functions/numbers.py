"""Numbers, angles and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TAU = math.pi, 2 * math.pi


def known(c: Column) -> Column:
    """NULL for NaN: comparisons with NaN hold in SQL, with NULL they do not."""
    return F.when(~F.isnan(c), c)


def wrap_signed(angle: Column) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(angle + PI, F.lit(TAU)) - PI


def wrap_turn(angle: Column) -> Column:
    """The angle in [0, 2 pi)."""
    return F.pmod(angle, F.lit(TAU))


def angle_between(a: Column, b: Column) -> Column:
    """Unsigned distance of two angles on the circle."""
    return F.abs(wrap_signed(a - b))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or either is NULL."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of two intervals by the length of their hull; 0 if they do not meet."""
    overlap = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))
    return share(overlap, F.greatest(e1, e2) - F.least(s1, s2))
