"""Bodies planted in images: contours, ellipses, heads, wings, splits, lost ones; backgrounds against a loop."""

import math
from collections import deque

import numpy as np
import pytest

from tracklore.operators import backdrop as D
from tracklore.operators import blobs as P
from tracklore.operators import shapes as H
from tracklore.operators import split as Q


def frame(spark, images):
    pixels = [(v, int(y), int(x)) for v, m in images.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(pixels, "v int, y int, x int")


def drawn(cx, cy, a, b, theta, shape=(60, 80)):
    y, x = np.mgrid[: shape[0], : shape[1]]
    u, w = (x - cx) * math.cos(theta) + (y - cy) * math.sin(theta), (y - cy) * math.cos(theta) - (x - cx) * math.sin(theta)
    return (u / a) ** 2 + (w / b) ** 2 <= 1


def test_contours_fill_holes_and_measure_polygons(spark):
    ring = np.zeros((12, 14), bool)
    ring[1:9, 2:10] = True
    ring[3:7, 4:8] = False
    ring[4:6, 5:7] = True  # a blob within the ring's hole is no outer contour
    line, cup, corner = (np.zeros((12, 14), bool) for _ in range(3))
    line[5, 1:9] = True
    cup[2:8, 2:9] = True
    cup[2:5, 4:7] = False
    corner[[1, 2, 3, 2, 1, 3], [1, 2, 3, 4, 5, 1]] = True  # corners join pixels, and let no background out
    got = {}
    for r in P.outer_contours(frame(spark, {0: ring, 1: line, 2: cup, 3: corner}), ["v"], -1.0).collect():
        got.setdefault((r.v, r.blob), [r.contour_area, 0])[1] += 1
    assert got[0, 0] == [49.0, 64] and got[1, 0] == [0.0, 8] and (0, 1) not in got
    assert got[2, 0] == [6 * 5 - 2 * 4.0 - 0.0, 6 * 7 - 9] or got[2, 0][1] == 33
    assert P.outer_contours(frame(spark, {0: ring, 1: line}), ["v"], 10.0).select("v").distinct().count() == 1


def test_erosion_leaves_the_image_edge(spark):
    m = np.zeros((6, 7), bool)
    m[0:4, 0:4] = True
    m[5, 6] = True
    steps = P.kernel(3, "rect")
    df = frame(spark, {0: m})
    free = {(r.y, r.x) for r in P.eroded(df, ["v"], steps).collect()}
    held = {(r.y, r.x) for r in P.eroded(df, ["v"], steps, size=(6, 7)).collect()}
    assert free == {(y, x) for y in (1, 2) for x in (1, 2)} and held == {(y, x) for y in range(3) for x in range(3)}
    assert {(r.y, r.x) for r in P.opened(df, ["v"], steps, size=(6, 7)).collect()} == {(y, x) for y in range(4) for x in range(4)}
    assert {(r.y, r.x) for r in P.closed(df, ["v"], steps, size=(6, 7)).collect()} >= {(y, x) for y in range(4) for x in range(4)} | {(5, 6)}


def test_ellipses_heads_and_wings(spark):
    planted = {k: (30 + k, 28 - k % 3, 14 + k % 4, 6 + k % 2, k * math.pi / 9 + 0.05) for k in range(9)}
    images, gray = {}, []
    for k, (cx, cy, a, b, t) in planted.items():
        images[k] = drawn(cx, cy, a, b, t)
        side = 1 if k % 2 else -1
        if k % 3 == 0:  # a wing at 90 degrees, and specks that are too small
            wx, wy = cx - (b + 3) * math.sin(t), cy + (b + 3) * math.cos(t)
            images[k] |= drawn(wx, wy, 3.6, 3.6, 0)
        for y, x in zip(*np.nonzero(images[k]), strict=True):
            along = (x - cx) * math.cos(t) + (y - cy) * math.sin(t)
            gray.append((k, int(y), int(x), int(100 - 5 * side * np.sign(along))))
    images[20] = np.zeros((60, 80), bool)
    images[20][7, 7:10] = True  # too small for a conic
    images[21] = np.zeros((60, 80), bool)
    images[21][3:20, 9] = True  # a line is none either
    pixels = P.cut(P.blob_pixels(frame(spark, images), ["v"]))
    fitted = P.cut(H.fitted_ellipses(pixels, ["v", "blob"]))
    got = {r.v: r for r in fitted.collect()}
    for k, (cx, cy, a, b, t) in planted.items():
        r = got[k]
        if k % 3:
            assert max(abs(r.cx - cx), abs(r.cy - cy)) < 0.3 and abs(r.a - a) < 1.3 and abs(r.b - b) < 1  # borders run within the edge
            assert abs((r.theta - t + math.pi / 2) % math.pi - math.pi / 2) < 0.06
    assert (got[20].cx, got[20].cy) == (8.0, 7.0) and (got[21].cx, got[21].cy) == (9.0, 11.0)
    grays = spark.createDataFrame(gray, "v int, y int, x int, gray int")
    headed = P.cut(H.headings(fitted, grays, ["v"], cell=16))
    for r in headed.where("v < 20").collect():
        k = r.v
        before = got[k].theta
        ahead = sum((155 + 100 - g) * np.sign((x - r.cx) * math.cos(before) + (y - r.cy) * math.sin(before)) for v, y, x, g in gray if v == k)
        assert abs((r.theta - before) % (2 * math.pi) - (math.pi if ahead < 0 else 0)) < 1e-9
    areas = P.contour_area(pixels, ["v", "blob"]).withColumnRenamed("contour_area", "area")
    known = spark.createDataFrame([(k, 0, float(cx), float(cy), a + 0.5, b + 0.5, t) for k, (cx, cy, a, b, t) in planted.items()], "v int, blob int, cx double, cy double, a double, b double, theta double")
    wings = {r.v: r.wing_angle for r in H.wing_angles(known.join(areas, ["v", "blob"]), pixels, ["v"]).collect()}
    assert all((abs(wings[k] - math.pi / 2) < 0.35) if k % 3 == 0 else wings[k] == 0 for k in planted)
    flat = {r.v: r.wing_angle for r in H.wing_angles(headed.join(areas, ["v", "blob"]).where("v >= 20"), pixels, ["v"]).collect()}
    assert flat == {20: 0, 21: 0}


def test_distances_and_splits_against_loops(spark):
    rng = np.random.default_rng(4)
    images = {0: drawn(20, 20, 9, 9, 0) | drawn(38, 22, 9, 9, 0), 1: drawn(30, 30, 14, 12, 0.3), 2: rng.random((15, 15)) < 0.7, 3: drawn(20, 20, 9, 9, 0) | drawn(37, 20, 9, 9, 0) | drawn(29, 34, 8, 8, 0)}
    pixels = P.cut(P.blob_pixels(frame(spark, images), ["v"]))
    where = {(r.v, r.y, r.x): r.blob for r in pixels.collect()}
    got = {(r.v, r.y, r.x): r.d2 for r in Q.squared_distances(pixels, ["v", "blob"]).collect()}
    assert set(got) == set(where)
    for (v, y, x), d2 in got.items():
        reach = range(-15, 16)
        want = min(i * i + j * j for i in reach for j in reach if where.get((v, y + i, x + j), -1) != where[v, y, x])
        assert d2 == want
    parts = {(r.v, r.y, r.x): r.part for r in Q.split_blobs(pixels, ["v"], 5.0).where("v <> 2").collect()}
    sizes = {(v, p): sum(k[0] == v and n == p for k, n in parts.items()) for v in images for p in (0, 1)}
    assert sizes[1, 1] == 0 and sizes[1, 0] == images[1].sum()
    assert sizes[0, 0] + sizes[0, 1] == images[0].sum() and min(sizes[0, 0], sizes[0, 1]) > 0.4 * images[0].sum()
    assert parts[0, 20, 20] != parts[0, 22, 38] and 0 < sizes[3, 1] <= sizes[3, 0] and sizes[3, 0] + sizes[3, 1] < images[3].sum()
    # Floods in rounds of steps, the smaller label first.
    ends = {(0, 20, 20): 5, (0, 22, 38): 3}
    seeds = spark.createDataFrame([(*k, n) for k, n in ends.items()], "v int, y int, x int, label int")
    flood = {(r.y, r.x): r.label for r in Q.flooded(pixels.where("v = 0"), seeds, ["v"]).collect()}
    want, todo = {k[1:]: (0, n) for k, n in ends.items()}, deque(sorted((k[1:] for k in ends), key=lambda p: ends[0, *p]))
    while todo:
        y, x = todo.popleft()
        for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
            if images[0][q] and (q not in want or want[q] > (want[y, x][0] + 1, want[y, x][1])):
                want[q] = (want[y, x][0] + 1, want[y, x][1])
                todo.append(q)
    assert flood == {k: n for k, (_, n) in want.items()}


def test_lost_bodies_come_back(spark):
    m = drawn(20, 20, 8, 5, 0.4) | drawn(60, 40, 8, 5, 1.1)
    pixels = [(0, int(y), int(x), 200 if x < 40 else 30, bool(x < 40)) for y, x in zip(*np.nonzero(m), strict=True)]
    pixels += [(0, 38, 70, 8, False), (1, 5, 5, 4, False)]
    df = spark.createDataFrame(pixels, "v int, y int, x int, diff int, on boolean")
    places = spark.createDataFrame([(0, 0, 20.0, 20.0), (0, 1, 58.0, 41.0), (1, 0, 5.0, 5.0)], "v int, fly int, px double, py double")
    got = Q.found_again(places, df, ["v"], "fly", 15, 10.0, df.where("on"), cell=16).collect()
    assert {(r.v, r.fly) for r in got} == {(0, 1)}
    assert {(r.y, r.x) for r in got} == {p[1:3] for p in pixels if p[2] >= 40 and p[3] == 30}


@pytest.mark.parametrize("warm", [False, True])
def test_background_buffer_against_a_loop(spark, warm):
    rng = np.random.default_rng(7)
    fps, seconds, n = 3.0, 8.0, 61
    v = rng.integers(0, 256, (n, 2, 2))
    rows = [(1, t, y, x, int(v[t, y, x])) for t in range(n) for y in range(2) for x in range(2)]
    df = spark.createDataFrame(rows, "k int, frame int, y int, x int, v int").repartition(3)
    got = {(r.frame, r.y, r.x): r.background for r in D.adaptive_background(df, ["k"], fps, seconds=seconds, warm=warm).collect()}
    buffer, last = deque(maxlen=8), -math.inf
    if warm:
        for t in range(0, n, 3):
            if len(buffer) < 8:
                buffer.append(v[t])
        last = len(buffer) - 1.0
    for t in range(n):
        if t / fps - last >= 1.0:
            buffer.append(v[t])
            last = t / fps
        want = np.sort(np.array(buffer), axis=0)[len(buffer) // 2] if len(buffer) >= 5 else None
        for y in range(2):
            for x in range(2):
                assert got[t, y, x] == (None if want is None else want[y, x]), (t, y, x)
    assert D.buffer_rule(30.0) == (30, 50, 12) and D.buffer_rule(29.97) == (30, 50, 12) and D.buffer_rule(10.0, 2.0) == (10, 5, 5)
