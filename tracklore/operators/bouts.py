"""Bouts: labelled frame intervals (``start``, ``end`` inclusive) of each series, and their algebra."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import interval_iou
from .series import SO_FAR


def runs(df: DataFrame, keys: Sequence[str], on: Column, frame: str = "frame") -> DataFrame:
    """Longest runs of consecutive frames where ``on`` holds."""
    hits = df.where(F.coalesce(on, F.lit(False))).select(*keys, F.col(frame).alias("frame"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    grouped = hits.withColumn("__g", F.col("frame") - order).groupBy(*keys, "__g")
    return grouped.agg(F.min("frame").alias("start"), F.max("frame").alias("end")).drop("__g")


def merged(bouts: DataFrame, keys: Sequence[str], gap: float = 1) -> DataFrame:
    """Bouts whose start is at most ``gap`` frames after the furthest end before them, made one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") - F.col("__reach") <= gap, 0).otherwise(1)
    tagged = bouts.withColumn("__reach", reach).withColumn("__new", new)
    tagged = tagged.withColumn("__id", F.sum("__new").over(w.rowsBetween(*SO_FAR)))
    return tagged.groupBy(*keys, "__id").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__id")


def at_least(bouts: DataFrame, frames: int) -> DataFrame:
    return bouts.where(F.col("end") - F.col("start") + 1 >= frames)


def from_scores(
    df: DataFrame, keys: Sequence[str], on: Column, min_len: int = 1, merge_gap: float = 0, frame: str = "frame"
) -> DataFrame:
    """Runs of at least ``min_len`` frames; with a ``merge_gap``, near ones are made one and filtered again."""
    found = at_least(runs(df, keys, on, frame), min_len)
    return at_least(merged(found, keys, merge_gap), min_len) if merge_gap > 0 else found


def uncovered(bouts: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Bouts that are not wholly covered by those of smaller ``rank`` in their series; NULL ranks stay.

    A dropped bout's frames are covered already, so coverage by all of smaller rank decides.
    """
    ranks = bouts.where(F.col(rank).isNotNull()).select(*keys, F.col(rank).alias("__r")).distinct()
    below = bouts.select(*keys, F.col(rank).alias("__o"), "start", "end").join(ranks, list(keys)).where("__o < __r")
    union = merged(below.select(*keys, "__r", "start", "end"), [*keys, "__r"], 1)
    union = union.select(*keys, F.col("__r").alias(rank), F.col("start").alias("rs"), F.col("end").alias("re"))
    shared = overlaps(bouts.select(*keys, rank, F.col("start").alias("s"), F.col("end").alias("e")).distinct(), union, [*keys, rank])
    shared = shared.withColumn("__c", F.least("e", "re") - F.greatest("s", "rs") + 1)
    gone = shared.groupBy(*keys, rank, F.col("s").alias("start"), F.col("e").alias("end")).agg(F.sum("__c").alias("__c"))
    gone = gone.where(F.col("__c") >= F.col("end") - F.col("start") + 1).drop("__c")
    return bouts.join(gone, [*keys, rank, "start", "end"], "left_anti")


def to_frames(bouts: DataFrame) -> DataFrame:
    """One row for each frame of each bout."""
    return bouts.withColumn("frame", F.explode(F.sequence("start", "end")))


def seconds_to_frames(start_s: Column, end_s: Column, n_frames: Column, fps: float | Decimal) -> tuple[Column, Column]:
    """First frame and last of a span in seconds: floor(start * fps), ceil(end * fps) exclusive, within the video.

    Seconds and ``fps`` that are decimals are multiplied exactly.
    """
    first = F.greatest(F.floor(start_s * fps).cast("long"), F.lit(0))
    return first, F.least(F.ceil(end_s * fps), n_frames) - 1


def _buckets(df: DataFrame, keys: Sequence[str], start: str, end: str, width: float) -> DataFrame:
    return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], width: float = 64.0) -> DataFrame:
    """Pairs of spans (s, e) of ``a`` and (rs, re) of ``b`` that share a point.

    An equi-join on time buckets; a pair counts in the first bucket that both reach.
    """
    left, right = _buckets(a, keys, "s", "e", width), _buckets(b, keys, "rs", "re", width)
    pairs = left.join(right, [*keys, "__b"]).where(F.floor(F.greatest("s", "rs") / width) == F.col("__b"))
    return pairs.where(F.greatest("s", "rs") <= F.least("e", "re")).drop("__b")


def overlap_pairs(
    a: DataFrame, b: DataFrame, keys: Sequence[str], least_iou: float = 0.3, width: float = 64.0
) -> DataFrame:
    """Pairs of spans (i, s, e) of ``a`` and (j, rs, re) of ``b`` with an IoU of ``least_iou`` (over 0) or more."""
    pairs = overlaps(a, b, keys, width)
    pairs = pairs.withColumn("iou", interval_iou(F.col("s"), F.col("e"), F.col("rs"), F.col("re")))
    return pairs.where(F.col("iou") >= least_iou)


def greedy_match(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one matches (keys, i, j, iou) of pairs with spans (s, e) and (rs, re), the highest (iou, i, j) first.

    Pairs that share a side overlap in time, so pairs whose hulls do not chain together cannot
    compete. Each chain is folded in order, taking a pair if both its sides are free: one sort by
    time and one aggregation, whatever the number of pairs.
    """
    hull = pairs.select(*keys, "i", "j", "iou", F.least("s", "rs").alias("__s"), F.greatest("e", "re").alias("__e"))
    w = Window.partitionBy(*keys).orderBy("__s", "__e")
    reach = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("__s") <= F.col("__reach"), 0).otherwise(1)
    chains = hull.withColumn("__reach", reach).withColumn("__new", new)
    chains = chains.withColumn("__g", F.sum("__new").over(w.rowsBetween(*SO_FAR)))
    ordered = F.sort_array(F.collect_list(F.struct("iou", "i", "j")), asc=False)
    kind = ordered_type(pairs)
    taken = F.aggregate(
        ordered,
        F.array().cast(f"array<{kind}>"),
        lambda got, p: F.when(F.exists(got, lambda g: (g["i"] == p["i"]) | (g["j"] == p["j"])), got).otherwise(F.array_append(got, p)),
    )
    found = chains.groupBy(*keys, "__g").agg(taken.alias("__m"))
    return found.select(*keys, F.explode("__m").alias("__p")).select(*keys, "__p.i", "__p.j", "__p.iou")


def ordered_type(pairs: DataFrame) -> str:
    return pairs.select(F.struct("iou", "i", "j").alias("p")).schema["p"].dataType.simpleString()
