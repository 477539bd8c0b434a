"""Bodies in images: ellipses fitted to borders, which end is the head, and wings beside the body.

Blobs are rows of pixels (keys, blob, y, x), their ellipses rows of (keys, blob, cx, cy, a, b, theta)
with half axes a >= b and the heading theta of the longer one.

Joins are merges by hint: Spark takes rows for as few bytes as what they were exploded from, and would broadcast all pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import PI, TAU
from .blobs import blob_pixels, bordered
from .image import moments, of_moments

#: A wing's least and greatest share of the blob's area, its furthest place in long axes.
WING_AREA, WING_REACH = (0.05, 0.5), 2.0
#: Half the side of the window that is weighed, in long axes, and its least.
HEAD_WINDOW, LEAST_WINDOW = 1.5, 20


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def solved(rows: Column, n: int) -> Column:
    """The solution of n linear equations, rows of n factors and a right side, by elimination; NULL if they do not determine one."""
    if n == 0:
        return rows
    state = rows
    steps = [lambda m, k=k: _eliminated(m, k) for k in range(n)]

    def run(m: Column, left: list) -> Column:
        return F.transform(m, lambda r: F.get(r, F.lit(n))) if not left else let(left[0](m), lambda x: run(x, left[1:]))

    return run(state, steps)


def _eliminated(m: Column, k: int) -> Column:
    """Row k divided by its own factor and taken from all others."""
    pivot = let(F.get(m, F.lit(k)), lambda p: F.transform(p, lambda x: F.try_divide(x, F.get(p, F.lit(k)))))
    return let(pivot, lambda p: F.transform(m, lambda r, i: F.when(i == k, p).otherwise(F.zip_with(r, p, lambda x, y: x - y * F.get(r, F.lit(k))))))


def fitted_ellipses(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cx, cy, a, b, theta) of each blob (in ``keys``): the conic with the least squares of A u2 + B uv + C v2 + D u + E v - 1 over its border.

    Sums of powers up to 4 (u and v from a corner of the blob, so that they are exact) give the
    equations, which are solved in each row. Blobs of under five border pixels, and those whose
    conic is no ellipse, take the ellipse of their second moments.
    """
    each = Window.partitionBy(*keys)
    placed = bordered(pixels, keys, "__rim").withColumns({f"__{c}0": F.min(c).over(each) - 1 for c in "xy"})
    u, v = (F.col("x") - F.col("__x0")).cast("double"), (F.col("y") - F.col("__y0")).cast("double")
    power = lambda i, j: F.pow(u, F.lit(i)) * F.pow(v, F.lit(j))
    terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1)]
    wanted = sorted({(i + k, j + m) for i, j in terms for k, m in terms} | set(terms))
    on_rim = [F.count_if("__rim").alias("__n"), *(F.sum(F.when(F.col("__rim"), power(i, j))).alias(f"__s{i}{j}") for i, j in wanted)]
    sums = placed.groupBy(*keys, "__x0", "__y0").agg(*on_rim, *moments())
    rows = F.array(*(F.array(*(F.col(f"__s{i + k}{j + m}") for k, m in terms), F.col(f"__s{i}{j}")) for i, j in terms))
    own = {"cx": F.col("cx"), "cy": F.col("cy")} | of_moments()
    conic = sums.select(*keys, *(c.alias(n) for n, c in own.items()), "__x0", "__y0", "__n", solved(rows, 5).alias("__c"))
    p, q, r, d, e = (F.get("__c", F.lit(k)) for k in range(5))
    det = 4 * p * r - q * q
    names = dict(zip(("__p", "__q", "__r", "__d", "__e"), (p, q, r, d, e), strict=True))
    centre = {"__u": F.try_divide(q * e - 2 * r * d, det), "__v": F.try_divide(q * d - 2 * p * e, det)}
    centred = conic.select(*keys, *own, "__n", "__x0", "__y0", *(c.alias(n) for n, c in (names | centre).items()))
    level = 1 - (F.col("__d") * F.col("__u") + F.col("__e") * F.col("__v")) / 2
    scaled = centred.select(*keys, *own, "__n", (F.col("__u") + F.col("__x0")).alias("__fx"), (F.col("__v") + F.col("__y0")).alias("__fy"), *(F.try_divide(F.col(c), level).alias(c) for c in ("__p", "__q", "__r")))
    p, q, r = (F.col(c) for c in ("__p", "__q", "__r"))
    mid, root, turn = (p + r) / 2, F.sqrt(F.pow((p - r) / 2, 2) + F.pow(q / 2, 2)), F.pmod(F.atan2(q, p - r) / 2 + PI / 2, F.lit(PI))
    both = scaled.select(*keys, *own, "__n", "__fx", "__fy", (mid - root).alias("__least"), (mid + root).alias("__most"), turn.alias("__ft"))
    good = (F.col("__n") >= 5) & (F.col("__least") > 0) & (F.col("__most") < float("inf")) & F.col("__fx").isNotNull()
    fits = {"cx": F.col("__fx"), "cy": F.col("__fy"), "a": F.try_divide(F.lit(1.0), F.sqrt("__least")), "b": F.try_divide(F.lit(1.0), F.sqrt("__most")), "theta": F.col("__ft")}
    return both.select(*keys, *(F.when(F.coalesce(good, F.lit(False)), fit).otherwise(F.col(c)).alias(c) for c, fit in fits.items()))


def inside(x: Column, y: Column) -> Column:
    """Whether (x, y) lies in the filled ellipse (cx, cy, a, b, theta) beside it; one without width holds all."""
    dx, dy = x - F.col("cx"), y - F.col("cy")
    along, across = dx * F.cos("theta") + dy * F.sin("theta"), dy * F.cos("theta") - dx * F.sin("theta")
    return F.coalesce(F.pow(F.try_divide(along, F.col("a")), 2) + F.pow(F.try_divide(across, F.col("b")), 2) <= 1, F.lit(True))


def headings(bodies: DataFrame, pixels: DataFrame, keys: Sequence[str], blob: str = "blob", cell: int = 64) -> DataFrame:
    """``bodies`` with ``theta`` turned round where the dark of the foreground weighs more behind them than before.

    Weighed are the foreground pixels (keys, y, x, gray) of a window around each body, by 255 less
    their gray; bodies and pixels meet in cells of the image.
    """
    half = F.greatest(F.floor(HEAD_WINDOW * 2 * F.col("a")), F.lit(LEAST_WINDOW))
    sides = {f"__{c}{k}": x for c in "xy" for k, x in ((0, F.greatest(F.floor(F.col(f"c{c}") - half), F.lit(0))), (1, F.floor(F.col(f"c{c}") + half) - 1))}
    windows = bodies.withColumns(sides)
    for c in "yx":
        windows = windows.withColumn(f"__c{c}", F.explode(F.sequence(F.floor(F.col(f"__{c}0") / cell), F.floor(F.greatest(f"__{c}1", f"__{c}0") / cell))))
    dots = pixels.select(*keys, "y", "x", "gray", F.floor(F.col("y") / cell).alias("__cy"), F.floor(F.col("x") / cell).alias("__cx"))
    met = windows.join(dots.hint("merge"), [*keys, "__cy", "__cx"]).where("x between __x0 and __x1 and y between __y0 and __y1")
    ahead = (F.col("x") - F.col("cx")) * F.cos("theta") + (F.col("y") - F.col("cy")) * F.sin("theta")
    dark = (255 - F.col("gray")).cast("double")
    sums = met.groupBy(*keys, blob).agg(F.sum(F.when(ahead > 0, dark)).alias("__head"), F.sum(F.when(ahead < 0, dark)).alias("__tail"))
    turned = F.coalesce("__tail", F.lit(0.0)) > F.coalesce("__head", F.lit(0.0))
    out = bodies.join(sums.hint("merge"), [*keys, blob], "left")
    return out.withColumn("theta", F.pmod(F.col("theta") + F.when(turned, PI).otherwise(0.0), F.lit(TAU))).select(*bodies.columns)


def wing_angles(bodies: DataFrame, pixels: DataFrame, keys: Sequence[str], area: str = "area", blob: str = "blob") -> DataFrame:
    """``bodies`` with ``wing_angle``: between the heading and the largest part of the blob outside its ellipse, 0 without one.

    A part counts if it has over 5 and under 50 percent of the blob's ``area``, and its centre
    lies within two long axes of the body's; of equal ones the first from the top.
    """
    body = bodies.withColumnRenamed(blob, "__body")
    own = pixels.select(*keys, F.col(blob).alias("__body"), "y", "x")
    rest = own.hint("merge").join(body.select(*keys, "__body", "cx", "cy", "a", "b", "theta"), [*keys, "__body"]).where(~inside(F.col("x"), F.col("y")))
    parts = blob_pixels(rest.select(*keys, "__body", "y", "x"), [*keys, "__body"])
    parts = parts.groupBy(*keys, "__body", "blob").agg(F.count("*").alias("__n"), F.avg("x").alias("__x"), F.avg("y").alias("__y"))
    dx, dy = F.col("__x") - F.col("cx"), F.col("__y") - F.col("cy")
    near = parts.hint("merge").join(body, [*keys, "__body"]).withColumn("__d", F.sqrt(dx * dx + dy * dy))
    near = near.where((F.col("__n") > WING_AREA[0] * F.col(area)) & (F.col("__n") < WING_AREA[1] * F.col(area)) & (F.col("__d") < WING_REACH * 2 * F.col("a")))
    along = F.greatest(F.least(F.try_divide(dx * F.cos("theta") + dy * F.sin("theta"), F.col("__d")), F.lit(1.0)), F.lit(-1.0))
    angle = F.when(F.col("__d") > 1e-6, F.acos(along)).otherwise(0.0)
    found = near.groupBy(*keys, "__body").agg(F.max_by(angle, F.struct("__n", -F.col("blob"))).alias("wing_angle"))
    out = bodies.join(found.withColumnRenamed("__body", blob).hint("merge"), [*keys, blob], "left")
    return out.withColumn("wing_angle", F.coalesce("wing_angle", F.lit(0.0))).select(*bodies.columns, "wing_angle")
