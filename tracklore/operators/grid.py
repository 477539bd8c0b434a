"""Boxes in reading order, on a grid, and descriptions resolved to boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(values: Column) -> Column:
    """The upper of the two middle values, where there are two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def padded(x: str, y: str, w: str, h: str, pad: int, width: Column, height: Column) -> list[Column]:
    """The box moved out by ``pad`` and cut at the image's edges."""
    left, top = F.greatest(F.col(x) - pad, F.lit(0)), F.greatest(F.col(y) - pad, F.lit(0))
    return [
        left.alias(x), top.alias(y), F.least(F.col(w) + 2 * pad, width - left).alias(w), F.least(F.col(h) + 2 * pad, height - top).alias(h),
    ]


def plausible_blob(area: str, w: str, h: str, image_area: Column) -> Column:
    """0.2 to 8 percent of the image, sides within a factor of two, filled by 45 percent or more."""
    ratio = F.col(w) / F.col(h)
    return F.col(area).between(0.002 * image_area, 0.08 * image_area) & ratio.between(0.5, 2.0) & (F.col(area) / (F.col(w) * F.col(h)) >= 0.45)


def reading_order(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``chamber``, from 0: rows of half a median height from top to bottom, each from left to right."""
    half = F.median("h").over(Window.partitionBy(*keys)) / 2
    row = F.floor(F.col("y") / F.greatest(half, F.lit(1.0)))
    return boxes.withColumn("__row", row).withColumn(
        "chamber", F.row_number().over(Window.partitionBy(*keys).orderBy("__row", "x", "y")) - 1
    ).drop("__row")


def grid_coordinates(boxes: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """``row`` and ``col`` of each box.

    By the height of their centres, boxes belong to the row at hand while within half the upper
    median height of that row's first box, so rows come from a fold over the sorted boxes of one
    image, whose number is small; columns are ranks by horizontal centre.
    """
    box = F.struct((F.col("y") + F.col("h") / 2).alias("cy"), F.col(index).cast("long").alias("i"))
    images = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("b"), upper_median(F.collect_list(F.col("h").cast("double"))).alias("m"))
    near = F.greatest(F.lit(1.0), 0.5 * F.col("m"))
    start = F.struct(
        F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<struct<i:bigint,row:int>>").alias("out")
    )

    def step(a: Column, b: Column) -> Column:
        same = F.coalesce(F.abs(b["cy"] - a["anchor"]) <= near, F.lit(False))
        row = F.when(same, a["row"]).otherwise(a["row"] + 1)
        return F.struct(
            F.when(same, a["anchor"]).otherwise(b["cy"]).alias("anchor"), row.alias("row"),
            F.array_append(a["out"], F.struct(b["i"].alias("i"), row.alias("row"))).alias("out"),
        )

    rows = images.select(*keys, F.explode(F.aggregate("b", start, step, lambda a: a["out"])).alias("r"))
    rows = rows.select(*keys, F.col("r.i").alias(index), F.col("r.row").alias("row"))
    joined = boxes.withColumn(index, F.col(index).cast("long")).join(rows, [*keys, index])
    cx = F.col("x") + F.col("w") / 2
    return joined.withColumn("col", F.row_number().over(Window.partitionBy(*keys, "row").orderBy(cx, index)) - 1)


def resolve_positions(cells: DataFrame, wanted: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """``wanted`` (keys, .., p) with the box that its position p (row_key, row_offset, col_key) names, NULL unless there is exactly one.

    ``cells`` are (keys, index, row, col) of each image's grid. Top and bottom count rows by the
    offset, middle is row n // 2; without a row nothing is named. Left and right are the outer
    third of a row's boxes, one at least, and middle those between, or the one at n // 2; the
    middle of two, or a row of more than one without a column, is ambiguous. Rows of ``wanted``
    meet the boxes of their own row only.
    """
    each = [*keys, "row"]
    rows = cells.groupBy(*each).agg(F.count("*").alias("n_cols"))
    rows = rows.withColumn("n_rows", F.max("row").over(Window.partitionBy(*keys)) + 1)
    n_rows = rows.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"))
    offset, last = F.col("p.row_offset"), F.col("n_rows") - 1
    target = F.when(F.col("p.row_key") == "top", offset).when(F.col("p.row_key") == "bottom", last - offset)
    target = target.when(F.col("p.row_key") == "middle", F.floor(F.col("n_rows") / 2))
    asked = wanted.join(n_rows, list(keys), "left").withColumn("row", target.cast("int")).drop("n_rows")
    boxes = cells.join(rows.drop("n_rows"), each)
    n, col = F.col("n_cols"), F.col("col")
    third = F.greatest(F.floor(n / 3), F.lit(1))
    between = F.when(n == 2, F.lit(False)).when(n - third <= third, col == F.floor(n / 2)).otherwise((col >= third) & (col < n - third))
    fits = (
        F.when(F.col("p.col_key").isNull(), n == 1)
        .when(F.col("p.col_key") == "left", col < third)
        .when(F.col("p.col_key") == "right", col >= n - third)
        .otherwise(between)
    )
    met = asked.join(boxes, each, "left").withColumn("__box", F.when(fits, F.col(index)))
    found = met.groupBy(*wanted.columns).agg(F.count("__box").alias("__n"), F.min("__box").alias("chamber"))
    return found.withColumn("chamber", F.when(F.col("__n") == 1, F.col("chamber"))).drop("__n")


def with_overrides(resolved: DataFrame, overrides: DataFrame, order: str) -> DataFrame:
    """Overrides (descriptor, chamber) first; then automatic picks, each box for the first that names it only."""
    fixed = overrides.where("chamber is not null").select("descriptor", F.col("chamber").alias("__o"))
    joined = resolved.join(fixed, "descriptor", "left")
    used = fixed.select(F.col("__o").alias("chamber")).distinct().withColumn("__used", F.lit(True))
    free = joined.join(used, "chamber", "left").withColumn("__auto", F.when(F.col("__o").isNull() & F.col("__used").isNull(), F.col("chamber")))
    first = F.row_number().over(Window.partitionBy("__auto").orderBy(order)) == 1
    chosen = F.coalesce("__o", F.when(F.col("__auto").isNotNull() & first, F.col("__auto")))
    return free.withColumn("chamber", chosen).withColumn("ambiguous", F.col("chamber").isNull()).drop("__o", "__used", "__auto")
