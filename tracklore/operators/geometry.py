"""Pairs of entities: partner columns, distances, headings and velocities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import PI, angle_between, wrap_signed, wrap_turn
from .series import SO_FAR, gradient, over, smooth, turn


def with_partner(df: DataFrame, keys: Sequence[str], entity: str, columns: Sequence[str], frame: str = "frame") -> DataFrame:
    """``p_`` columns of the other of two entities (0 and 1) at the same frame.

    A window over the frame, so a partitioning by ``keys`` made before serves it too.
    """
    w = Window.partitionBy(*keys, frame)
    both = {c: [F.max(F.when(F.col(entity) == k, F.col(c))).over(w) for k in (0, 1)] for c in columns}
    return df.withColumns({f"p_{c}": F.when(F.col(entity) == 0, two[1]).otherwise(two[0]) for c, two in both.items()})


def centre_distance() -> Column:
    return F.hypot(F.col("p_x") - F.col("x"), F.col("p_y") - F.col("y"))


def facing_angle() -> Column:
    """Signed angle from the heading to the partner."""
    return wrap_signed(F.atan2(F.col("p_y") - F.col("y"), F.col("p_x") - F.col("x")) - F.col("theta"))


def tip_distance(sign: int) -> Column:
    """From the head (1) or tail (-1) to the partner's ellipse, along the line between; 0 inside."""
    tip_x, tip_y = F.col("x") + sign * F.col("a") * F.cos("theta"), F.col("y") + sign * F.col("a") * F.sin("theta")
    dx, dy = tip_x - F.col("p_x"), tip_y - F.col("p_y")
    angle = F.atan2(dy, dx) - F.col("p_theta")
    a, b = F.col("p_a"), F.col("p_b")
    radius = a * b / F.sqrt(F.pow(b * F.cos(angle), 2) + F.pow(a * F.sin(angle), 2) + 1e-10)
    distance = F.hypot(dx, dy) - radius
    return F.when(distance.isNotNull(), F.greatest(distance, F.lit(0.0)))


def overlaps() -> Column:
    """Centres nearer than the two half-lengths together."""
    return F.coalesce(centre_distance() < F.col("a") + F.col("p_a"), F.lit(False))


def with_velocity(df: DataFrame, keys: Sequence[str], fps: float, frame: str = "frame") -> DataFrame:
    """``vel`` (units a frame), ``v_par`` and ``v_perp`` (along and across the heading), ``ang_vel`` (a second)."""
    sigma = max(1.0, 0.05 * fps)
    w = over(keys, frame)
    df = smooth(smooth(df, keys, "x", "__x", sigma, frame), keys, "y", "__y", sigma, frame)
    df = df.withColumns({"__vx": gradient("__x", w), "__vy": gradient("__y", w), "__w": turn("theta", w) * fps})
    df = smooth(df, keys, "__w", "ang_vel", sigma, frame)
    vx, vy = F.col("__vx"), F.col("__vy")
    return df.withColumns(
        {
            "vel": F.hypot(vx, vy),
            "v_par": vx * F.cos("theta") + vy * F.sin("theta"),
            "v_perp": -vx * F.sin("theta") + vy * F.cos("theta"),
        }
    ).drop("__x", "__y", "__vx", "__vy", "__w")


def social_features(df: DataFrame, keys: Sequence[str], entity: str, fps: float, frame: str = "frame") -> DataFrame:
    """Tracks with c2c, facing_angle, n2e, t2e, overlap and velocities, one shuffle by ``keys`` for all windows."""
    df = df.repartition(*keys)
    df = with_partner(df, keys, entity, ["x", "y", "theta", "a", "b"], frame)
    df = df.withColumns(
        {"c2c": centre_distance(), "facing_angle": facing_angle(), "n2e": tip_distance(1), "t2e": tip_distance(-1), "overlap": overlaps()}
    )
    return with_velocity(df, [*keys, entity], fps, frame)


def resolve_heading(df: DataFrame, keys: Sequence[str], theta: str, motion: str, fast: str, out: str, frame: str = "frame") -> DataFrame:
    """``theta`` or its opposite, as motion and continuity tell, by a scan instead of a loop.

    A fast frame whose motion is clearly nearer to one of the two (by over 0.3), or that has no
    known frame before, fixes the choice; other frames keep or flip the choice before, whichever
    turns less. So a frame's choice is the last fixed one plus the flips since, modulo 2.
    """
    w = over(keys, frame)
    ahead, back = wrap_turn(F.col(theta)), wrap_turn(F.col(theta) + PI)
    before = F.lag(theta).over(w)
    to_ahead, to_back = angle_between(ahead, F.col(motion)), angle_between(back, F.col(motion))
    nearer = F.when(to_ahead < to_back, 0).otherwise(1)
    is_fast = F.coalesce(F.col(fast), F.lit(False))
    fixed = F.when(F.col(theta).isNull(), None).when(is_fast & (before.isNull() | (F.abs(to_ahead - to_back) > 0.3)), nearer)
    fixed = fixed.when(~is_fast & before.isNull(), 0)
    turned = wrap_turn(before)
    flips = F.when(angle_between(ahead, turned) < angle_between(back, turned), 0).otherwise(1)
    df = df.withColumns({"__fixed": fixed, "__flip": flips})
    df = df.withColumn("__flip", F.when(F.col("__fixed").isNull() & F.col(theta).isNotNull(), F.col("__flip")).otherwise(0))
    df = df.withColumn("__block", F.count("__fixed").over(w.rowsBetween(*SO_FAR)))
    inner = Window.partitionBy(*keys, "__block").orderBy(frame).rowsBetween(*SO_FAR)
    bit = F.pmod(F.coalesce(F.first("__fixed", ignorenulls=True).over(inner), F.lit(0)) + F.sum("__flip").over(inner), F.lit(2))
    single = F.count("*").over(Window.partitionBy(*keys)) < 2
    chosen = F.when(single, F.col(theta)).when(bit == 1, back).otherwise(ahead)
    return df.withColumn(out, F.when(F.col(theta).isNotNull(), chosen)).drop("__fixed", "__flip", "__block")
