"""Measures of bouts: totals, latencies, agreement, roles and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import share
from .bouts import merged, overlaps


def frames_in(start: str = "start", end: str = "end") -> Column:
    return F.col(end) - F.col(start) + 1


def index_percent(bouts: DataFrame, keys: Sequence[str], n_frames: str, onset: int = 0, skip: str = "Courtship") -> DataFrame:
    """``courtship_index``: percent of frames from ``onset`` on that lie in a bout of any behaviour but ``skip``."""
    own = bouts.where(F.col("behavior") != skip)
    union = merged(own.select(*keys, n_frames, "start", "end"), [*keys, n_frames], 1)
    length = F.greatest(F.col("end") - F.greatest(F.col("start"), F.lit(onset)) + 1, F.lit(0))
    total = union.groupBy(*keys, n_frames).agg(F.sum(length).alias("__f"))
    whole = F.greatest(F.col(n_frames) - onset, F.lit(1))
    return total.select(*keys, (F.col("__f") / whole * 100).alias("courtship_index"))


def behaviour_totals(bouts: DataFrame, keys: Sequence[str], entities: DataFrame, names: Sequence[str], fps: float) -> DataFrame:
    """``n_bouts`` and ``seconds`` of each behaviour of each entity, zeros where there is none."""
    spark = bouts.sparkSession
    every = entities.crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in names], "behavior string")))
    sums = bouts.groupBy(*keys, "behavior").agg(F.count("*").alias("n"), F.sum(frames_in()).alias("f"))
    joined = every.join(sums, [*keys, "behavior"], "left")
    return joined.select(*keys, "behavior", F.coalesce("n", F.lit(0)).alias("n_bouts"), (F.coalesce("f", F.lit(0)) / fps).alias("seconds"))


def latency(bouts: DataFrame, keys: Sequence[str], fps: float, only: str | None = None) -> DataFrame:
    """``latency_s``: start of the first bout (of one behaviour)."""
    start = F.min(F.when(F.col("behavior") == only, F.col("start")) if only else F.col("start"))
    return bouts.groupBy(*keys).agg((start / fps).alias("latency_s"))


def summary_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value as text), 'N/A' for NULL."""
    pairs = ", ".join(f"'{m}', COALESCE(CAST(`{m}` AS STRING), 'N/A')" for m in metrics)
    return df.selectExpr(*keys, f"stack({len(metrics)}, {pairs}) AS (metric, value)")


def confusion(df: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, f1, iou, 0 where a denominator is."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = df.groupBy(*keys).agg(
        F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "iou": share(tp, tp + fp + fn)}
    )


def interval_confusion(predicted: DataFrame, actual: DataFrame, totals: DataFrame, keys: Sequence[str], n_frames: str) -> DataFrame:
    """The same from bouts, by overlap lengths instead of frames; both sides without overlaps of their own."""
    p, a = (merged(x.select(*keys, "start", "end"), keys, 1) for x in (predicted, actual))
    n_p = p.groupBy(*keys).agg(F.sum(frames_in()).alias("np"))
    n_a = a.groupBy(*keys).agg(F.sum(frames_in()).alias("na"))
    spans = [x.select(*keys, F.col("start").alias(s), F.col("end").alias(e)) for x, s, e in ((p, "s", "e"), (a, "rs", "re"))]
    both = overlaps(*spans, keys).groupBy(*keys).agg(F.sum(F.least("e", "re") - F.greatest("s", "rs") + 1).alias("tp"))
    all_ = totals.join(n_p, list(keys), "left").join(n_a, list(keys), "left").join(both, list(keys), "left").fillna(0, ["np", "na", "tp"])
    return all_.select(
        *keys, "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("na") - F.col("tp")).alias("fn"),
        (F.col(n_frames) - F.col("np") - F.col("na") + F.col("tp")).alias("tn"),
    )


def match_summary(matches: DataFrame, keys: Sequence[str], n_pred: DataFrame, n_ref: DataFrame) -> DataFrame:
    """matched, false and missed bouts, mean offsets and median IoU of matches (i, j, iou, ds, de)."""
    m = matches.groupBy(*keys).agg(
        F.count("*").alias("matched"), F.avg("ds").alias("start_offset"), F.avg("de").alias("end_offset"), F.median("iou").alias("median_iou")
    )
    both = n_pred.join(n_ref, list(keys), "full").join(m, list(keys), "left").fillna(0)
    return both.select(
        *keys, "matched", (F.col("n_pred") - F.col("matched")).alias("false_bouts"), (F.col("n_ref") - F.col("matched")).alias("missed"),
        "start_offset", "end_offset", "median_iou",
    )


def infer_roles(pairs: DataFrame) -> DataFrame:
    """``is_male_0`` and ``is_male_1`` from wing frames w0, w1, median lengths a0, a1 and counts c_<behaviour>_0/1.

    Wing share over 0.7 scores 2, over 0.55 scores 1 to the larger; of lengths known from over 50
    frames (n0, n1), a ratio under 0.85 scores 1 to the smaller; each behaviour with more than
    twice the other's count scores 0.5. The higher score wins from 1.0 on.
    """
    w0, w1 = F.col("w0"), F.col("w1")
    wing = F.coalesce(F.try_divide(F.greatest(w0, w1).cast("double"), w0 + w1), F.lit(0.0))
    wing = F.when(wing > 0.7, 2.0).when(wing > 0.55, 1.0).otherwise(0.0)
    a0, a1 = F.col("a0"), F.col("a1")
    sized = (F.col("n0") > 50) & (F.col("n1") > 50) & (F.try_divide(F.least(a0, a1), F.greatest(a0, a1)) < 0.85)
    s0, s1 = F.when(w0 > w1, wing).otherwise(0.0), F.when(w0 > w1, 0.0).otherwise(wing)
    s0, s1 = s0 + F.when(sized & (a0 < a1), 1.0).otherwise(0.0), s1 + F.when(sized & (a1 < a0), 1.0).otherwise(0.0)
    for name in ("following", "circling", "attempted"):
        c0, c1 = F.col(f"c_{name}_0"), F.col(f"c_{name}_1")
        s0, s1 = s0 + F.when(c0 > 2 * c1, 0.5).otherwise(0.0), s1 + F.when(c1 > 2 * c0, 0.5).otherwise(0.0)
    return pairs.withColumns({"score_0": s0, "score_1": s1}).withColumns(
        {"is_male_0": (F.col("score_0") > F.col("score_1")) & (F.col("score_0") >= 1.0), "is_male_1": (F.col("score_1") > F.col("score_0")) & (F.col("score_1") >= 1.0)}
    )


def px_per_mm(tracks: DataFrame, keys: Sequence[str], length: str = "a", body_mm: float = 2.5) -> DataFrame:
    """Median of known positive half-lengths over half the body length; NULL without any."""
    sound = F.when((F.col(length) > 0) & ~F.isnan(length) & (F.col(length) < float("inf")), F.col(length))
    value = F.median(sound) / (body_mm / 2) if body_mm > 0 else F.lit(None).cast("double")
    return tracks.groupBy(*keys).agg(value.alias("px_per_mm"))


def nearest_item(df: DataFrame, keys: Sequence[str], item: str, value: str, target: float, tolerance: float) -> DataFrame:
    """The item whose median value is nearest to ``target`` and within ``tolerance``, the least of equals; NULL without one."""
    medians = df.groupBy(*keys, item).agg(F.median(value).alias("m")).withColumn("d", F.abs(F.col("m") - target))
    near = F.when(F.col("d") < tolerance, F.struct("d", item))
    return medians.groupBy(*keys).agg(F.min(near).getField(item).alias(item))
