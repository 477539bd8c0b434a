"""Per-entity time series: rows keyed by ``keys`` and ordered by ``frame``, one partitioning for all."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numbers import wrap_signed, wrap_turn

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)
FROM_HERE = (Window.currentRow, Window.unboundedFollowing)


def over(keys: Sequence[str], frame: str = "frame") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(frame)


def with_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], frame: str = "frame") -> DataFrame:
    """Dense frame numbers from 0 within each series."""
    return df.withColumn(frame, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def _neighbours(value: str, w: WindowSpec, frame: str) -> tuple[Column, Column, Column, Column]:
    """Last known value at or before, its frame, and the first known at or after, its frame."""
    at = F.when(F.col(value).isNotNull(), F.col(frame))
    before, after = w.rowsBetween(*SO_FAR), w.rowsBetween(*FROM_HERE)
    return (
        F.last(value, ignorenulls=True).over(before),
        F.last(at, ignorenulls=True).over(before),
        F.first(value, ignorenulls=True).over(after),
        F.first(at, ignorenulls=True).over(after),
    )


def fill_linear(df: DataFrame, keys: Sequence[str], value: str, out: str, frame: str = "frame") -> DataFrame:
    """Gaps filled on a line between their neighbours; ends take the nearest known value."""
    names = [f"__{out}_{k}" for k in ("pv", "pf", "nv", "nf")]
    df = df.withColumns(dict(zip(names, _neighbours(value, over(keys, frame), frame), strict=True)))
    pv, pf, nv, nf = (F.col(n) for n in names)
    line = pv + (nv - pv) * (F.col(frame) - pf) / F.when(nf != pf, nf - pf)
    filled = F.coalesce(F.col(value), F.when(pv.isNull(), nv).when(nv.isNull(), pv).otherwise(line))
    return df.withColumn(out, filled).drop(*names)


def interpolate_gaps(
    df: DataFrame, keys: Sequence[str], lead: str, linear: Sequence[str], circular: Sequence[str] = (), zero: Sequence[str] = (),
    most: int = 5, frame: str = "frame",
) -> DataFrame:
    """Runs of at most ``most`` frames without ``lead``, known on both sides, are filled.

    ``linear`` columns run on a line, ``circular`` ones along the shorter arc, ``zero`` ones are 0.
    """
    w = over(keys, frame)
    at = F.when(F.col(lead).isNotNull(), F.col(frame))
    before, after = w.rowsBetween(*SO_FAR), w.rowsBetween(*FROM_HERE)
    cols = {"__pf": F.last(at, ignorenulls=True).over(before), "__nf": F.first(at, ignorenulls=True).over(after)}
    seen = F.col(lead).isNotNull()
    for c in (*linear, *circular):
        # The neighbour is the row where ``lead`` is known, whatever this column holds there.
        cols[f"__p_{c}"] = F.last(F.when(seen, F.struct(c)), ignorenulls=True).over(before)[c]
        cols[f"__n_{c}"] = F.first(F.when(seen, F.struct(c)), ignorenulls=True).over(after)[c]
    df = df.withColumns(cols)
    gap = F.col(lead).isNull() & F.col("__pf").isNotNull() & F.col("__nf").isNotNull() & (F.col("__nf") - F.col("__pf") - 1 <= most)
    part = (F.col(frame) - F.col("__pf")) / F.when(gap, F.col("__nf") - F.col("__pf"))
    new = {}
    for c in linear:
        new[c] = F.when(gap, F.col(f"__p_{c}") + part * (F.col(f"__n_{c}") - F.col(f"__p_{c}"))).otherwise(F.col(c))
    for c in circular:
        turn = wrap_signed(F.col(f"__n_{c}") - F.col(f"__p_{c}"))
        new[c] = F.when(gap, wrap_turn(F.col(f"__p_{c}") + part * turn)).otherwise(F.col(c))
    for c in zero:
        new[c] = F.when(gap, F.lit(0.0)).otherwise(F.col(c))
    return df.withColumns(new).drop(*cols)


def gaussian_weights(sigma: float) -> list[float]:
    """Weights of offsets -r..r, r = int(4 sigma + 0.5), that add up to 1."""
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / math.fsum(raw) for x in raw]


def gaussian(df: DataFrame, keys: Sequence[str], value: str, out: str, sigma: float, frame: str = "frame") -> DataFrame:
    """Convolution of a series without gaps (frames 0..n-1) with a Gaussian, mirrored at both ends.

    The rows near the ends are added again at their mirrored places, then each row is a weighted
    sum of its neighbours by offset, in one window over the series.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    n = F.col("__n")
    df = df.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    near = (F.col(frame) < r) | (F.col(frame) >= n - r)
    turns = F.sequence(-F.ceil(r / (2 * n)) - 1, F.ceil(r / (2 * n)) + 1)
    places = F.flatten(F.transform(turns, lambda m: F.array(2 * n * m + F.col(frame), 2 * n * m - 1 - F.col(frame))))
    outside = F.filter(places, lambda p: ((p < 0) & (p >= -r)) | ((p >= n) & (p < n + r)))
    own = F.array(F.col(frame).cast("long"))
    df = df.withColumn("__at", F.explode(F.when(near, F.concat(own, outside)).otherwise(own)))
    w = over(keys, "__at")
    total = None
    for k, x in enumerate(weights):
        term = F.lit(x) * (F.lag(value, r - k).over(w) if k < r else F.lead(value, k - r).over(w) if k > r else F.col(value))
        total = term if total is None else total + term
    done = df.withColumn(out, total)
    return done.where((F.col("__at") >= 0) & (F.col("__at") < n)).drop("__at", "__n")


def smooth(df: DataFrame, keys: Sequence[str], value: str, out: str, sigma: float, frame: str = "frame") -> DataFrame:
    """Gaussian smoothing that fills gaps first and opens them again."""
    filled = gaussian(fill_linear(df, keys, value, "__filled", frame), keys, "__filled", "__smooth", sigma, frame)
    return filled.withColumn(out, F.when(F.col(value).isNotNull(), F.col("__smooth"))).drop("__filled", "__smooth")


def gradient(value: str, w: WindowSpec) -> Column:
    """Central differences, one-sided at the ends; NULL where a neighbour it needs is."""
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(first & last, F.lit(0.0)).when(first, after - F.col(value)).when(last, F.col(value) - before).otherwise((after - before) / 2)


def turn(value: str, w: WindowSpec) -> Column:
    """Signed change of an angle since the frame before; 0 at the first."""
    first = F.lag(F.lit(1)).over(w).isNull()
    return F.when(first, F.when(F.col(value).isNotNull(), F.lit(0.0))).otherwise(wrap_signed(F.col(value) - F.lag(value).over(w)))


def rolling_std(value: str, w: WindowSpec, width: int) -> Column:
    """Centred sample deviation over ``width`` rows, 0 where there is one value only."""
    frame = w.rowsBetween(-(width // 2), width - 1 - width // 2)
    return F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0))


def window_stat(value: str, w: WindowSpec, stat: str, radius: int, offset: int = 0) -> Column:
    """mean, min, max, std, change, diff_neighbor_mean/min/max or zscore_neighbors over [t-r+o, t+r+o].

    Windows are clipped at the ends; NULLs are left out; an unknown statistic is 0.
    """
    frame = w.rowsBetween(offset - radius, offset + radius)
    if stat in ("mean", "min", "max", "std"):
        return {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop}[stat](value).over(frame)
    if stat.startswith("diff_neighbor_"):
        return F.col(value) - F.coalesce(window_stat(value, w, stat.removeprefix("diff_neighbor_"), radius, offset), F.lit(0.0))
    if stat == "zscore_neighbors":
        mean, std = F.avg(value).over(frame), F.coalesce(F.stddev_pop(value).over(frame), F.lit(0.0))
        return (F.col(value) - F.coalesce(mean, F.lit(0.0))) / F.when(std > 1e-6, std).otherwise(1.0)
    if stat == "change":
        return _change(value, frame)
    return F.lit(0.0)


def _change(value: str, frame: WindowSpec) -> Column:
    """Mean of the later half of a window less that of the earlier, which has the middle row."""
    every = F.collect_list(F.struct(F.col(value).alias("v"))).over(frame)
    size = F.size(every)
    half = F.floor((size + 1) / 2).cast("int")
    # Halves of the window: rows 1..half and the rest.
    mean = lambda part: F.aggregate(
        part,
        F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
        lambda a, x: F.struct((a["s"] + F.coalesce(x["v"], F.lit(0.0))).alias("s"), (a["n"] + x["v"].isNotNull().cast("int")).alias("n")),
        lambda a: F.when(a["n"] > 0, a["s"] / a["n"]),
    )
    return F.when(size < 2, 0.0).otherwise(mean(F.slice(every, half + 1, size - half + 1)) - mean(F.slice(every, F.lit(1), half)))


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Share of a series' 51 percentiles (0, 2 .. 100) that a value reaches; 0 for NULL.

    Values within half of the ninth decimal count as equal, as interpolated percentiles are not exact below it.
    """
    bins = F.percentile(value, F.array(*(F.lit(p / 100) for p in range(0, 101, 2)))).over(Window.partitionBy(*keys))
    df = df.withColumn("__bins", bins)
    rank = F.size(F.filter("__bins", lambda b: b <= F.col(value) + 5e-10)) / F.lit(51.0)
    return df.withColumn(out, F.when(F.col(value).isNull(), F.lit(0.0)).otherwise(rank)).drop("__bins")


def transform_mask(trans: str | int | None) -> int:
    """Bits of a transform: abs is 2, flip 4 and relative 8, by name or as bits; anything else is none."""
    if isinstance(trans, str) and trans.lower() in ("abs", "flip", "relative"):
        return {"abs": 2, "flip": 4, "relative": 8}[trans.lower()]
    try:
        return int(trans or 0)
    except ValueError:
        return 0


def transformed(df: DataFrame, keys: Sequence[str], value: Column, trans: str | int | None, out: str) -> DataFrame:
    """``df`` with ``value`` as ``out``: made positive, then turned over, then ranked by ``percentile_rank``, as the bits say."""
    mask = transform_mask(trans)
    value = F.abs(value) if mask & 2 else value
    df = df.withColumn(out, -value if mask & 4 else value)
    return percentile_rank(df, keys, out, out) if mask & 8 else df
