"""What views show: active behaviours by frame, preview frames, sampled times, grids, and evaluations by chamber."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bouts import to_frames

#: Short names of behaviours; the union has none.
ABBREVIATIONS = {"WingExt": "Wing", "Following": "Fol", "Circling": "Cir", "Copulation": "Cop", "Attempted_Copulation": "AtCop"}


def active_labels(bouts: DataFrame, keys: Sequence[str], names: dict[str, str] = ABBREVIATIONS) -> DataFrame:
    """(keys, frame, label): short names of the behaviours active at a frame, in the order of ``names``, by ' | '."""
    table = F.create_map(*(F.lit(x) for k, (n, short) in enumerate(names.items()) for x in (n, F.struct(F.lit(k).alias("k"), F.lit(short).alias("s")))))
    known = bouts.where(F.col("behavior").isin(list(names)))
    frames = to_frames(known).select(*keys, "frame", F.element_at(table, F.col("behavior")).alias("b"))
    labels = frames.groupBy(*keys, "frame").agg(F.array_sort(F.collect_set("b")).alias("b"))
    return labels.select(*keys, "frame", F.array_join(F.transform("b", lambda x: x["s"]), " | ").alias("label"))


def behaviour_masks(bouts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, frame) with a boolean column for each behaviour."""
    frames = to_frames(bouts.where(F.col("behavior").isin(list(names))))
    return frames.groupBy(*keys, "frame").agg(*(F.max(F.col("behavior") == n).alias(n) for n in names))


def preview_frames(start: Column, end: Column, fps: float, rate: int = 10, most: int = 100) -> Column:
    """Frames to show of a bout: every fps / rate-th, at most ``most``."""
    return F.slice(F.sequence(start, end, F.lit(max(1, int(fps / rate))).cast("long")), 1, most)


def sample_times(duration: Column, start_s: float = 90.0, end_s: float = 300.0, step_s: float = 5.0) -> Column:
    """Seconds at which frames are tried: from min(90, 15 %) up to, not at, min(300, 80 %) of the duration."""
    first, last = F.least(F.lit(start_s), duration * 0.15), F.least(F.lit(end_s), duration * 0.8)
    steps = F.greatest(F.ceil((last - first) / step_s), F.lit(1))
    return F.filter(F.transform(F.sequence(F.lit(0).cast("long"), steps - 1), lambda k: first + k * step_s), lambda t: t < last)


def best_sample(samples: DataFrame, keys: Sequence[str], time: str, count: str) -> DataFrame:
    """The time with most blobs, the earliest of equals."""
    return samples.groupBy(*keys).agg(F.max_by(time, F.struct(count, -F.col(time))).alias("best_t"))


def grid_boxes(images: DataFrame, rows: int, cols: int, width: str, height: str) -> DataFrame:
    """(.., idx, x, y, w, h): an even grid over each image; boxes that would leave it are dropped."""
    w, h = F.floor(F.col(width) / cols), F.floor(F.col(height) / rows)
    cells = images.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    boxes = cells.withColumns({"idx": F.col("__i"), "x": (F.col("__i") % cols) * w, "y": F.floor(F.col("__i") / cols) * h, "w": w, "h": h})
    return boxes.drop("__i").where((F.col("x") + F.col("w") <= F.col(width)) & (F.col("y") + F.col("h") <= F.col(height)) & (F.col("w") > 0) & (F.col("h") > 0))


def evaluate(annotated: DataFrame, mapping: DataFrame, measures: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each annotated descriptor: its chamber, what was compared, and the measures where something was.

    ``mapping``: (descriptor, chamber); ``results``: (chamber, scope) of chambers with a result
    file; ``measures``: a row for each chamber.
    """
    joined = annotated.join(mapping, "descriptor", "left").join(results, "chamber", "left")
    scope = F.when(F.col("chamber").isNull(), "unmapped").when(F.col("scope").isNull(), "no_results").otherwise(F.col("scope"))
    return joined.withColumn("scope", scope).join(measures, "chamber", "left")


def last_descriptor(mapping: DataFrame, order: str) -> DataFrame:
    """(chamber, descriptor), the later of two that name the same chamber."""
    return mapping.where("chamber is not null").groupBy("chamber").agg(F.max_by("descriptor", order).alias("descriptor"))

