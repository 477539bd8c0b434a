"""Images as rows of pixels (keys, y, x, v): thresholds, backgrounds, ellipses, and identities over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import PI
from .series import SO_FAR


def otsu(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``threshold``: the value after which the variance between both classes is greatest, the smallest of equals.

    From the histogram: values are counted before the shuffle, and cumulated over distinct values.
    """
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    whole, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("v").rowsBetween(*SO_FAR)
    n, s = F.sum("n").over(whole), F.sum(F.col("v") * F.col("n")).over(whole)
    n0, s0 = F.sum("n").over(so_far), F.sum(F.col("v") * F.col("n")).over(so_far)
    parts = counts.withColumns({"n0": n0, "s0": s0, "all": n, "sum": s})
    between = between_classes(*(F.col(c) for c in ("n0", "s0", "all", "sum")))
    return parts.groupBy(*keys).agg(F.max_by("v", F.struct(between, -F.col("v"))).alias("threshold"))


def between_classes(n0: Column, s0: Column, n: Column, s: Column) -> Column:
    """The variance between the n0 values of sum s0 and the others of all n of sum s; 0 without others."""
    return F.coalesce(n0 * (n - n0) * F.pow(s0 / n0 - F.try_divide(s - s0, n - n0), 2), F.lit(0.0))


def background(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Upper median over time of each pixel (keys), of frames sampled before.

    From the histogram, as in ``otsu``: the first value that more than half of the values reach.
    """
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count(value).alias("n"))
    whole, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("v").rowsBetween(*SO_FAR)
    counts = counts.withColumns({"all": F.sum("n").over(whole), "so_far": F.sum("n").over(so_far)})
    return counts.groupBy(*keys).agg(F.min(F.when(F.col("so_far") > F.floor(F.col("all") / 2), F.col("v"))).alias("background"))


def moments(x: str = "x", y: str = "y") -> list[Column]:
    """Aggregates of which ``of_moments`` makes an ellipse."""
    return [F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy")]


def of_moments() -> dict[str, Column]:
    """Half-axes (twice the deviations) and heading in [0, pi)."""
    mid, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow(F.col("xy"), 2))
    turn = F.pmod(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2, F.lit(PI))
    return {"a": 2 * F.sqrt(mid + root), "b": 2 * F.sqrt(F.greatest(mid - root, F.lit(0.0))), "theta": turn}


def ellipse(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Centre, half-axes, heading in [0, pi) and area of each blob, from second moments."""
    found = df.groupBy(*keys).agg(*moments(x, y), F.count("*").alias("area"))
    return found.select(*keys, "cx", "cy", *(c.alias(n) for n, c in of_moments().items()), "area")


def largest(df: DataFrame, keys: Sequence[str], area: str, n: int = 2) -> DataFrame:
    """The n largest blobs of each frame; ties to the first by position."""
    order = Window.partitionBy(*keys).orderBy(F.desc(area), "cy", "cx")
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def assign_identities(detections: DataFrame, keys: Sequence[str], gate: float, frame: str = "frame", area: str | None = None) -> DataFrame:
    """(keys, frame, fly, x, y): two identities followed through up to two detections (x, y) a frame.

    Of more detections, the two largest by ``area`` count (without areas, the two leftmost). The
    first are numbered from left to right. Later ones go to the last known places by the pairing
    of least total distance, identity unless the swap is strictly shorter, and only within
    ``gate``; an identity without one is NULL there and keeps its place. Each step needs the
    last, so a video is the work of one task, which goes through its sorted rows and holds one
    frame and two places.
    """
    kinds = {f.name: f.dataType.simpleString() for f in detections.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{frame} long", "fly int", "x double", "y double"])
    order = [F.desc(area)] if area else []
    rank = F.row_number().over(Window.partitionBy(*keys, frame).orderBy(F.col("x").isNull() | F.col("y").isNull(), *order, "x", "y"))
    rows = detections.withColumn("__r", rank).where("__r <= 2").select(*keys, frame, "x", "y")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, frame, "x", "y")
    n = len(keys)

    def follow(batches):
        from math import hypot, isnan

        import pandas as pd

        video, at, seen, places = None, None, [], [None, None]

        def step():
            """Places of both at the frame at hand."""
            known = [k for k in (0, 1) if places[k] is not None]
            pick = {}
            if not known:
                pick = dict(enumerate(range(len(seen))))
            elif seen:
                cost = [[hypot(p[0] - q[0], p[1] - q[1]) if p else 1e6 for q in seen] for p in places]
                if len(seen) == 2:
                    swap = cost[0][1] + cost[1][0] < cost[0][0] + cost[1][1]
                    pick = {0: 1, 1: 0} if swap else {0: 0, 1: 1}
                else:
                    pick = {int(cost[1][0] < cost[0][0]): 0}
                pick = {k: j for k, j in pick.items() if places[k] is None or cost[k][j] < gate}
            for k in (0, 1):
                if k in pick:
                    places[k] = seen[pick[k]]
                yield (*video, at, k, *(places[k] if k in pick else (None, None)))

        names = [*keys, frame, "fly", "x", "y"]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[: n + 1] != (*(video or ()), at) and video is not None:
                    out.extend(step())
                    seen = []
                if row[:n] != video:
                    video, places = row[:n], [None, None]
                at = row[n]
                if not (row[n + 1] is None or row[n + 2] is None or isnan(row[n + 1]) or isnan(row[n + 2])):
                    seen.append(row[n + 1 :])
            yield pd.DataFrame(out, columns=names)
        if video is not None:
            yield pd.DataFrame(list(step()), columns=names)

    return rows.mapInPandas(follow, schema)
