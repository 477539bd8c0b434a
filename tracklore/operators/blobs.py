"""Foreground pixels (keys, y, x) as blobs: morphology with shaped kernels, connected components, filters.

Images are sets of pixels on an unbounded plane, of which nothing outside is foreground; erosions take an image's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType

from .bouts import overlaps
from .frames import by_image, contours, labelled
from .grid import plausible_blob
from .lineage import cut
from .links import components

#: Kernel sizes and repeats that chamber detection tries, in this order.
SETTINGS = [(5, 2), (7, 2), (9, 2), (7, 3), (9, 3), (11, 3)]


def kernel(size: int, shape: str = "rect") -> list[tuple[int, int]]:
    """(dy, dx) of a square, cross or ellipse of odd ``size``; an ellipse's rows reach to the rounded width of its disc."""
    r = size // 2
    reach = {
        "rect": lambda dy: r,
        "cross": lambda dy: 0 if dy else r,
        "ellipse": lambda dy: round(r * ((r * r - dy * dy) / (r * r)) ** 0.5) if r else 0,
    }[shape]
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-reach(dy), reach(dy) + 1)]


def _moved(mask: DataFrame, keys: Sequence[str], steps: Sequence[tuple[int, int]]) -> DataFrame:
    each = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps))
    return mask.select(*keys, F.explode(each).alias("p")).select(*keys, "p.y", "p.x")


def dilated(mask: DataFrame, keys: Sequence[str], steps: Sequence[tuple[int, int]], times: int = 1) -> DataFrame:
    """Pixels that the kernel reaches from a pixel of the mask (all kernels here are symmetric)."""
    for _ in range(times):
        mask = _moved(mask, keys, steps).distinct()
    return mask


def eroded(mask: DataFrame, keys: Sequence[str], steps: Sequence[tuple[int, int]], times: int = 1, size: tuple[int, int] | None = None) -> DataFrame:
    """Pixels all of whose kernel lies in the mask, whose pixels are distinct.

    With the image's ``size`` (height, width), what lies outside the image does not count, so blobs at its edge keep theirs.
    """
    inside = lambda c, d, n: (F.col(c) + d >= 0) & (F.col(c) + d < n)
    for _ in range(times):
        counted = _moved(mask, keys, steps).groupBy(*keys, "y", "x").agg(F.count("*").alias("__n"))
        needed = F.lit(len(steps)) if size is None else sum(((inside("y", dy, size[0]) & inside("x", dx, size[1])).cast("int") for dy, dx in steps), F.lit(0))
        if size is not None:
            counted = counted.where(inside("y", 0, size[0]) & inside("x", 0, size[1]))
        mask = counted.where(F.col("__n") == needed).drop("__n")
    return mask


def opened(mask: DataFrame, keys: Sequence[str], steps: Sequence[tuple[int, int]], times: int = 1, size: tuple[int, int] | None = None) -> DataFrame:
    return _within(dilated(eroded(mask, keys, steps, times, size), keys, steps, times), size)


def closed(mask: DataFrame, keys: Sequence[str], steps: Sequence[tuple[int, int]], times: int = 1, size: tuple[int, int] | None = None) -> DataFrame:
    return eroded(_within(dilated(mask, keys, steps, times), size), keys, steps, times, size)


def _within(mask: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    return mask if size is None else mask.where((F.col("y") >= 0) & (F.col("y") < size[0]) & (F.col("x") >= 0) & (F.col("x") < size[1]))


def _runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, s, e, id): the runs of pixels of each row."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    runs = mask.select(*keys, "y", "x").distinct().withColumn("__g", F.col("x") - F.row_number().over(row))
    runs = runs.groupBy(*keys, "y", "__g").agg(F.min("x").alias("s"), F.max("x").alias("e")).drop("__g")
    return cut(runs.withColumn("id", F.monotonically_increasing_id()))


def _touching(runs: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Links (a, b) of runs of neighbouring rows that overlap, or with a ``reach`` of 1 touch by corners."""
    above = runs.select(*keys, (F.col("y") + 1).alias("y"), (F.col("s") - reach).alias("s"), (F.col("e") + reach).alias("e"), F.col("id").alias("a"))
    below = runs.select(*keys, "y", F.col("s").alias("rs"), F.col("e").alias("re"), F.col("id").alias("b"))
    return overlaps(above, below, [*keys, "y"]).select("a", "b")


def blob_runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, blob, y, s, e): the runs of each blob, of pixels that touch by sides or corners.

    Rows of an image become runs first; runs of neighbouring rows that touch are linked, and
    components of links are blobs, numbered by the first of their pixels from top to bottom. Of
    many images (``keys``), each is the work of one task; a single one is linked by all tasks.
    """
    if keys:
        return by_image(mask, keys, ["y", "x"], _made(mask, "blob y s e"), labelled)
    runs = _runs(mask, keys)
    parts = components(_touching(runs, keys, 1))
    known = runs.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    first = F.min(F.struct("y", "s")).over(Window.partitionBy(*keys, "part"))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("__first")) - 1
    return known.withColumn("__first", first).withColumn("blob", number).select(*keys, "blob", "y", "s", "e")


def _made(mask: DataFrame, names: str) -> dict[str, DataType]:
    """The types of runs' columns."""
    places = {"y": mask.schema["y"].dataType, "s": mask.schema["x"].dataType, "e": mask.schema["x"].dataType}
    return {n: (places | {"blob": IntegerType(), "contour_area": DoubleType()})[n] for n in names.split()}


def blob_pixels(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, blob, y, x) of each pixel of the mask."""
    return blob_runs(mask, keys).select(*keys, "blob", "y", F.explode(F.sequence("s", "e")).alias("x"))


def filled(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mask and its holes: background that sides (not corners) do not join to the outside.

    Gaps between the runs of a row are linked with the gaps that they overlap in the rows beside;
    one that reaches past the runs of a row beside it lies open, and so do all that are linked to it.
    """
    pixels = mask.select(*keys, "y", "x").distinct()
    after = F.lead("x").over(Window.partitionBy(*keys, "y").orderBy("x"))
    gaps = pixels.withColumn("n", after).where("n > x + 1").select(*keys, "y", (F.col("x") + 1).alias("s"), (F.col("n") - 1).alias("e"))
    gaps = cut(gaps.withColumn("id", F.monotonically_increasing_id()))
    ends = cut(pixels.groupBy(*keys, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    open_gaps = None
    for step in (-1, 1):
        beside = gaps.join(ends.withColumn("y", F.col("y") + step), [*keys, "y"], "left").where("lo is null or s < lo or e > hi").select("id")
        open_gaps = beside if open_gaps is None else open_gaps.unionByName(beside)
    parts = components(_touching(gaps, keys, 0)).withColumnRenamed("node", "id")
    known = gaps.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    leaks = known.join(open_gaps.distinct(), "id", "left_semi").select("part").distinct()
    holes = known.join(leaks, "part", "left_anti").select(*keys, "y", F.explode(F.sequence("s", "e")).alias("x"))
    return pixels.unionByName(holes)


def contour_area(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, contour_area): the area within the polygon through the outer pixels' centres, of filled blobs (in ``keys``).

    Of the squares between four pixel centres, one with all four in the blob counts whole, one with three counts half.
    """
    corners = _moved(pixels, keys, [(0, 0), (0, -1), (-1, 0), (-1, -1)]).groupBy(*keys, "y", "x").agg(F.count("*").alias("n"))
    return corners.groupBy(*keys).agg(F.sum(F.when(F.col("n") == 4, 1.0).when(F.col("n") == 3, 0.5).otherwise(0.0)).alias("contour_area"))


def outer_contours(mask: DataFrame, keys: Sequence[str], least: float = 0.0, fill: bool = True) -> DataFrame:
    """(keys, blob, y, x, contour_area) of the pixels of filled blobs whose contour area is over ``least``.

    Without ``fill`` holes stay, and their squares do not count. Of many images, each is one task's work.
    """
    if keys:
        runs = by_image(mask, keys, ["y", "x"], _made(mask, "blob y s e contour_area"), partial(contours, least=least, fill=fill))
        return runs.repartition(*keys).select(*keys, "blob", "y", F.explode(F.sequence("s", "e")).alias("x"), "contour_area")
    pixels = cut(blob_pixels(filled(mask, keys) if fill else mask, keys))
    areas = contour_area(pixels, [*keys, "blob"]).where(F.col("contour_area") > least)
    return pixels.join(areas, [*keys, "blob"])


def bordered(pixels: DataFrame, keys: Sequence[str], name: str = "rim") -> DataFrame:
    """``pixels`` of each blob (in ``keys``) with whether they have a side to a pixel that is not the blob's."""
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    beside = [f(c).over(w) == F.col(c) + d for c, w in (("x", row), ("y", column)) for f, d in ((F.lag, -1), (F.lead, 1))]
    within = beside[0] & beside[1] & beside[2] & beside[3]
    return pixels.withColumn(name, ~F.coalesce(within, F.lit(False)))


def blobs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, blob, area, x, y, w, h, cx, cy) of pixels that touch by sides or corners; ``area`` counts pixels."""
    n = F.col("e") - F.col("s") + 1
    return blob_runs(mask, keys).groupBy(*keys, "blob").agg(
        F.sum(n).alias("area"), F.min("s").alias("x"), F.min("y").alias("y"), (F.max("e") - F.min("s") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        (F.sum(n * (F.col("s") + F.col("e")) / 2) / F.sum(n)).alias("cx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"),
    )


def chamber_blobs(found: DataFrame, keys: Sequence[str], image_area: float) -> DataFrame:
    """Blobs of a chamber's size and shape; of four or more, those within 0.4 to 2 times the median area."""
    fit = found.where(plausible_blob("area", "w", "h", F.lit(image_area)))
    each = Window.partitionBy(*keys)
    fit = fit.withColumns({"__n": F.count("*").over(each), "__m": F.median("area").over(each)})
    like = (F.col("area") > 0.4 * F.col("__m")) & (F.col("area") < 2.0 * F.col("__m"))
    return fit.where((F.col("__n") < 4) | like).drop("__n", "__m")


def detect_chambers(mask: DataFrame, keys: Sequence[str], image_area: float, settings: Sequence[tuple[int, int]] = SETTINGS) -> DataFrame:
    """Blobs of the opening with an ellipse that gives an image the most chambers, the first of equal ones."""
    tried = None
    for k, (size, times) in enumerate(settings):
        found = chamber_blobs(blobs(opened(mask, keys, kernel(size, "ellipse"), times), keys), keys, image_area)
        found = found.withColumn("setting", F.lit(k))
        tried = found if tried is None else tried.unionByName(found)
    tried = cut(tried)
    counts = tried.groupBy(*keys, "setting").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max_by("setting", F.struct("n", -F.col("setting"))).alias("setting"))
    return tried.join(best, [*keys, "setting"])
