"""Blobs that hold two bodies, taken apart; bodies that were lost, found again around their last places.

Joins are merges by hint: Spark takes rows for as few bytes as what they were exploded from, and would broadcast all pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import blob_pixels, contour_area, outer_contours
from .frames import NO_LABEL, by_image, flood
from .lineage import cut

#: Squares of the share of the greatest distance that a middle exceeds, in hundredths.
_MIDDLE = 16
#: The least difference in a region that is looked at again, and the share of its greatest that counts.
_FAINT, _SHARE = 5, 0.3


def squared_distances(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, x, d2): of each pixel of a blob (in ``keys``), the square of the exact distance to the nearest pixel not of it.

    First along rows, from the ends of the pixel's run; then down columns, where each pixel of a
    vertical run takes the least of the parabolas over the others and over the run's two ends.
    A task holds one column of one blob.
    """
    row = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    run = Window.partitionBy(*keys, "y", "__r")
    across = F.least(F.col("x") - F.min("x").over(run), F.max("x").over(run) - F.col("x")) + 1
    flat = pixels.select(*keys, "y", "x").withColumn("__r", row).withColumn("h", across.cast("long"))
    column = F.col("y") - F.row_number().over(Window.partitionBy(*keys, "x").orderBy("y"))
    runs = flat.withColumn("__c", column).groupBy(*keys, "x", "__c").agg(F.sort_array(F.collect_list(F.struct("y", "h"))).alias("run"))
    ends = [F.get("run", F.lit(0))["y"] - 1, F.element_at("run", -1)["y"] + 1]
    square = lambda c: c * c
    nearest = F.transform(
        "run",
        lambda p: F.struct(
            p["y"].alias("y"),
            F.least(F.array_min(F.transform("run", lambda q: square(q["h"]) + square(p["y"] - q["y"]))), *(square(p["y"] - e) for e in ends)).cast("long").alias("d2"),
        ),
    )
    return runs.select(*keys, "x", F.explode(nearest).alias("p")).select(*keys, "p.y", "x", "p.d2")


def flooded(pixels: DataFrame, seeds: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """(keys, y, x, label): labels of ``seeds`` spread to all pixels that sides or corners join to them, the nearer in steps first.

    Of labels that arrive together the smallest stays. Each image (``keys``) is the work of one task.
    """
    place = [*keys, "y", "x"]
    either = pixels.select(*place, F.lit(NO_LABEL).alias("__l")).unionByName(seeds.select(*place, F.col(label).cast("long").alias("__l")))
    known = either.repartition(*keys).groupBy(*place).agg(F.min("__l").alias("__l"))
    made = {"y": pixels.schema["y"].dataType, "x": pixels.schema["x"].dataType, label: seeds.schema[label].dataType}
    return by_image(known, keys, ["y", "x", "__l"], made, flood)


def split_blobs(pixels: DataFrame, keys: Sequence[str], least: float = 0.0, blob: str = "blob") -> DataFrame:
    """(keys, blob, part, y, x): the pixels of blobs, those of two bodies in parts 0 and 1, of others in part 0.

    Middles are the pixels further than 0.4 of the blob's greatest distance from its edge. Where
    they fall into two or more, each floods the blob; of parts with a contour area over ``least``
    the two largest are the bodies, if there are two. All pixels of the others stay together.
    """
    whole = [*keys, blob]
    far = squared_distances(pixels, whole)
    middles = far.withColumn("__top", F.max("d2").over(Window.partitionBy(*whole))).where(100 * F.col("d2") > _MIDDLE * F.col("__top"))
    renamed = middles.withColumnRenamed(blob, "__whole")
    inner = [*keys, "__whole"]
    seeds = blob_pixels(renamed.select(*inner, "y", "x"), inner).withColumnRenamed("blob", "label")
    several = seeds.withColumn("__n", F.max("label").over(Window.partitionBy(*inner))).where("__n > 0").drop("__n")
    seeds = cut(several)
    tried = seeds.select(*inner).distinct()
    mine = pixels.select(*keys, F.col(blob).alias("__whole"), "y", "x")
    parts = cut(flooded(mine.join(tried.hint("merge"), inner, "left_semi"), seeds, inner))
    areas = contour_area(parts, [*inner, "label"]).where(F.col("contour_area") > least)
    order = F.row_number().over(Window.partitionBy(*inner).orderBy(F.desc("contour_area"), "label"))
    kept = areas.withColumn("__o", order).where("__o <= 2").withColumn("__n", F.count("*").over(Window.partitionBy(*inner))).where("__n = 2")
    kept = cut(kept.select(*inner, "label", (F.col("__o") - 1).alias("part")))
    two = parts.join(kept.hint("merge"), [*inner, "label"]).select(*inner, "part", "y", "x")
    one = mine.join(kept.select(*inner).distinct().hint("merge"), inner, "left_anti").select(*inner, F.lit(0).alias("part"), "y", "x")
    return two.unionByName(one).withColumnRenamed("__whole", blob)


def _in_cells(df: DataFrame, low: dict[str, str], high: dict[str, str], cell: int) -> DataFrame:
    for c in "yx":
        df = df.withColumn(f"__c{c}", F.explode(F.sequence(F.floor(F.col(low[c]) / cell), F.floor(F.greatest(low[c], high[c]) / cell))))
    return df


def found_again(places: DataFrame, pixels: DataFrame, keys: Sequence[str], fly: str, reach: int, least: float, known: DataFrame | None = None, cell: int = 64, fill: bool = True) -> DataFrame:
    """(keys, fly, y, x, contour_area): pixels of the largest blob around the last place (px, py) of each lost body.

    ``pixels`` (keys, y, x, diff, on) hold each pixel's difference from the background, where
    there is any, and whether it is foreground. In the square of ``reach`` around a place a pixel
    counts if it is foreground, or if it differs by over 0.3 of the region's greatest difference
    (and over 5, as that must); blobs of a contour area over ``least`` count. Places within
    ``reach`` of a pixel of ``known`` are not lost. Without ``fill`` holes stay.
    Places and pixels meet in cells of the image.
    """
    windows = places
    for c in "yx":
        windows = windows.withColumns({f"__{c}0": F.greatest(F.floor(F.col(f"p{c}") - reach), F.lit(0)), f"__{c}1": F.floor(F.col(f"p{c}") + reach) - 1})
    windows = cut(_in_cells(windows, {c: f"__{c}0" for c in "yx"}, {c: f"__{c}1" for c in "yx"}, cell))
    at = {f"__c{c}": F.floor(F.col(c) / cell) for c in "yx"}
    join = [*keys, "__cy", "__cx"]
    if known is not None:
        wide = places.withColumns({f"__{c}{k}": F.floor(F.col(f"p{c}") + d * reach) for c in "yx" for k, d in ((0, -1), (1, 1))})
        wide = _in_cells(wide, {c: f"__{c}0" for c in "yx"}, {c: f"__{c}1" for c in "yx"}, cell)
        near = wide.join(known.select(*keys, "y", "x").withColumns(at).hint("merge"), join)
        near = near.where(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) < reach).select(*keys, fly).distinct()
        windows = windows.join(near.hint("merge"), [*keys, fly], "left_anti")
    met = windows.join(pixels.withColumns(at).hint("merge"), join).where("x between __x0 and __x1 and y between __y0 and __y1")
    top = F.max("diff").over(Window.partitionBy(*keys, fly))
    faint = (top > _FAINT) & (F.col("diff") > F.greatest(F.lit(_FAINT), F.floor(top * _SHARE)))
    mask = met.select(*keys, fly, "y", "x", "on", "diff").withColumn("__m", F.col("on") | faint).where("__m")
    shapes = cut(outer_contours(mask.select(*keys, fly, "y", "x"), [*keys, fly], least, fill))
    best = shapes.groupBy(*keys, fly).agg(F.max_by("blob", F.struct("contour_area", -F.col("blob"))).alias("blob"))
    return shapes.join(best.hint("merge"), [*keys, fly, "blob"]).select(*keys, fly, "y", "x", "contour_area")
