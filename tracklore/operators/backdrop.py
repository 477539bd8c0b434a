"""Backgrounds that follow the light: medians of a bounded buffer of sampled frames, and what stands out from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import kernel, opened
from .image import between_classes


def buffer_rule(fps: float, seconds: float = 50.0, hz: float = 1.0) -> tuple[int, int, int]:
    """Frames from one sample to the next, samples that a buffer holds, and how many make it ready."""
    capacity = max(5, round(seconds * hz))
    return max(1, math.ceil(fps / hz - 1e-9)), capacity, max(5, capacity // 4)


def adaptive_background(pixels: DataFrame, keys: Sequence[str], fps: float, *, seconds: float = 50.0, hz: float = 1.0, warm: bool = False) -> DataFrame:
    """``pixels`` (keys, frame, y, x, v) with ``background``: the upper median of the samples in the buffer at that frame.

    A frame is a sample once a period has passed since the last; the buffer keeps the newest, and
    gives nothing (NULL) before it is a quarter full. It looks back only; when ``warm``, the
    first buffer is filled from the video's beginning, ahead of time. Each pixel's window of
    samples is bounded by the buffer, so a long video is as light as a short one. All windows are
    parts of a pixel's frames and no table is joined, so that rows move once, or not at all where
    the videos (``keys``) are dealt to tasks already.
    """
    step, capacity, ready = buffer_rule(fps, seconds, hz)
    pixel = [*keys, "y", "x"]
    sampled = F.col("frame") % step == 0
    found = pixels.withColumns({"__at": F.expr(f"frame div {step}"), "__sample": sampled})
    key = F.col("__at")
    if warm:  # the buffer holds the first samples until newer ones replace them
        last = F.max(F.when(F.col("__sample"), F.col("__at"))).over(Window.partitionBy(*pixel))
        found = found.withColumn("__first", F.least(last, F.lit(capacity - 1))).where("__first is not null")
        key = F.greatest("__at", "__first")
    held = Window.partitionBy(*pixel, "__sample").orderBy("__at").rowsBetween(1 - capacity, 0)
    found = found.withColumns({"__k": F.collect_list(F.when(F.col("__sample"), F.col("v"))).over(held), "__s": key})
    median = F.get(F.sort_array("__k"), F.expr("size(__k) div 2"))
    found = found.withColumn("__m", F.when(F.col("__sample") & (F.col("__at") == F.col("__s")) & (F.size("__k") >= ready), median))
    return found.withColumn("background", F.max("__m").over(Window.partitionBy(*pixel, "__s"))).select(*pixels.columns, "background")


def foreground(pixels: DataFrame, keys: Sequence[str], least_range: int = 15, size: tuple[int, int] | None = None, open_kernel: int = 3) -> DataFrame:
    """(keys, frame, y, x) of pixels that differ from their ``background`` by more than the frame's Otsu threshold, opened.

    A frame without a background, or where nothing differs by ``least_range``, has none. A task
    holds a frame, and attaches the threshold to its pixels: windows, where a join of limits would
    compute all pixels twice more and might broadcast them, as Spark takes exploded rows for small.
    """
    diff = pixels.where("background is not null").select(*keys, "frame", "y", "x", F.abs(F.col("v") - F.col("background")).alias("diff"))
    frame = [*keys, "frame"]
    whole, so_far = Window.partitionBy(*frame), Window.partitionBy(*frame).orderBy("diff").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {n: f.over(w) for w, c, d in ((so_far, "__n0", "__s0"), (whole, "__n", "__s")) for n, f in ((c, F.count("*")), (d, F.sum("diff")))}
    scored = diff.withColumns(sums).withColumn("__b", between_classes(*(F.col(c) for c in ("__n0", "__s0", "__n", "__s"))))
    best = F.max(F.struct("__b", -F.col("diff"))).over(whole)
    limits = scored.withColumns({"__t": -best["col2"], "__top": F.max("diff").over(whole)})
    mask = limits.where((F.col("__top") >= least_range) & (F.col("diff") > F.col("__t"))).select(*frame, "y", "x")
    return opened(mask, frame, kernel(open_kernel, "ellipse"), size=size)
