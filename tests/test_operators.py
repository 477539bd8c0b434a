"""Examples with known results, and loops written out for comparison."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.functions import numbers as N
from tracklore.functions import text as T
from tracklore.operators import bouts as B
from tracklore.operators import geometry as G
from tracklore.operators import grid as R
from tracklore.operators import image as I
from tracklore.operators import metrics as M
from tracklore.operators import models as L
from tracklore.operators import rules
from tracklore.operators import series as S
from tracklore.sources import annotations, results


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "seconds"),
    [("0:00:07", 7), ("1:23:45", 5025), ("0:10:00", 600), ("1:23", 83), ("10:00", 600), ("", None), ("nan", None), ("0:07:35:00", None), ("foo", None), ("3", None), (None, None)],
)
def test_time_text(spark, text, seconds):
    assert one(spark, T.time_seconds(F.lit(text).cast("string"))) == seconds


@pytest.mark.parametrize(
    ("text", "position"),
    [
        ("01 (bottom right)", ("bottom", 0, "right")),
        ("02 (second row from the bottom, right)", ("bottom", 1, "right")),
        ("03 (second row from bottom, middle)", ("bottom", 1, "middle")),
        ("05 (second row from top, middle)", ("top", 1, "middle")),
        ("06 (top row, right)", ("top", 0, "right")),
        ("07 (top row middle)", ("top", 0, "middle")),
        ("top left", ("top", 0, "left")),
        ("bottom centre", ("bottom", 0, "middle")),
        ("nothing", (None, 0, None)),
        ("twenty-first from the top, left", ("top", 0, "left")),
        ("the second  row top", ("top", 1, None)),
        ("second row, top", ("top", 0, None)),
        ("second from the right, bottom", ("bottom", 0, "right")),
        ("middle row of two, center", ("middle", 0, None)),
        ("leftover, right", (None, 0, "right")),
        ("3 middle (bottom, left) (top)", ("bottom", 0, "left")),
        ("()", (None, 0, None)),
        (None, (None, 0, None)),
    ],
)
def test_positions(spark, text, position):
    assert tuple(one(spark, T.position(F.lit(text).cast("string")))) == position


def test_scores_to_bouts_against_a_loop(spark):
    rng = random.Random(1)
    series = {k: [rng.random() < 0.6 for _ in range(60)] for k in range(8)}
    df = spark.createDataFrame([(k, t, v) for k, vs in series.items() for t, v in enumerate(vs)], "k int, frame long, on boolean")

    def loop(on, least, gap):
        runs, start = [], None
        for t, v in enumerate([*on, False]):
            if v and start is None:
                start = t
            elif not v and start is not None:
                runs.append((start, t - 1))
                start = None
        runs = [r for r in runs if r[1] - r[0] + 1 >= least]
        out = []
        for s, e in runs:
            if gap > 0 and out and s - out[-1][1] <= gap:
                out[-1] = (out[-1][0], e)
            else:
                out.append((s, e))
        return [r for r in out if r[1] - r[0] + 1 >= least]

    for least, gap in ((1, 0), (2, 0), (2, 3), (3, 2)):
        got = B.from_scores(df, ["k"], F.col("on"), least, gap).collect()
        assert sorted((r.k, r.start, r.end) for r in got) == sorted((k, s, e) for k, on in series.items() for s, e in loop(on, least, gap))


def test_gaussian_against_a_loop(spark):
    rng = random.Random(2)
    series = {k: [rng.random() for _ in range(n)] for k, n in enumerate((1, 2, 5, 40))}
    df = spark.createDataFrame([(k, t, v) for k, vs in series.items() for t, v in enumerate(vs)], "k int, frame long, v double")
    got = {(r.k, r.frame): r.g for r in S.gaussian(df, ["k"], "v", "g", 1.5).collect()}
    w = S.gaussian_weights(1.5)
    for k, vs in series.items():
        n = len(vs)
        for t in range(n):
            total = 0.0
            for d, x in enumerate(w):
                m = (t + d - len(w) // 2) % (2 * n)
                total += x * vs[m if m < n else 2 * n - 1 - m]
            assert math.isclose(got[k, t], total, abs_tol=1e-12)


def test_gaps_are_filled_only_inside(spark):
    xs = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(xs)], "k int, frame long, x double")
    got = [r.x for r in S.interpolate_gaps(df, ["k"], "x", ["x"], most=2).orderBy("frame").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]


def test_confusion(spark):
    rows = [(t, t < 30, 15 <= t < 45) for t in range(60)]
    df = spark.createDataFrame(rows, "frame long, p boolean, a boolean").withColumn("k", F.lit(0))
    r = M.confusion(df, ["k"], F.col("p"), F.col("a")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (15, 15, 15, 15)
    assert r.f1 == 0.5
    assert M.confusion(df, ["k"], F.lit(False), F.lit(False)).first().f1 == 0


def test_greedy_match_against_a_loop(spark):
    """Chains of overlaps with ties, keys of two videos, and no more than one job's shuffles."""
    rng = random.Random(3)
    rows = []
    for k in range(3):
        a = [(i, s, s + rng.randrange(1, 9)) for i, s in enumerate(rng.sample(range(120), 30))]
        b = [(j, s, s + rng.randrange(1, 9)) for j, s in enumerate(rng.sample(range(120), 30))]
        rows += [(k, i, s, e, j, rs, re, rng.choice([0.3, 0.5, 0.5, 0.9])) for i, s, e in a for j, rs, re in b if max(s, rs) <= min(e, re)]
    pairs = spark.createDataFrame(rows, "k int, i int, s int, e int, j int, rs int, re int, iou double")
    used, want = set(), set()
    for k, i, _, _, j, _, _, iou in sorted(rows, key=lambda r: (-r[7], -r[1], -r[4])):
        if (k, 0, i) not in used and (k, 1, j) not in used:
            used |= {(k, 0, i), (k, 1, j)}
            want.add((k, i, j, iou))
    out = B.greedy_match(pairs, ["k"])
    assert {tuple(r) for r in out.collect()} == want and out.columns == ["k", "i", "j", "iou"]
    assert B.greedy_match(pairs.where("i > 99"), ["k"]).count() == 0
    assert B.greedy_match(pairs.select("k", *(F.col(c).cast("string").alias(c) for c in ("i", "j")), "s", "e", "rs", "re", "iou"), ["k"]).count() == len(want)


def test_iou_uses_the_hull(spark):
    iou = lambda *x: one(spark, N.interval_iou(*(F.lit(float(v)) for v in x)))
    assert iou(0, 2, 1, 3) == pytest.approx(1 / 3)
    assert iou(0, 1, 2, 3) == 0


def test_calibration(spark):
    px = lambda values: M.px_per_mm(spark.createDataFrame([(0, v) for v in values], "k int, a double"), ["k"]).first().px_per_mm
    assert px([15.0, 15.0]) == 12.0
    assert px([15.0, float("nan"), 0.0, -1.0, None]) == 12.0
    assert px([None, 0.0]) is None


def test_grid_rows_compare_with_their_first_box(spark):
    boxes = [(0, i, float(x), float(y), 40.0, 40.0) for i, (x, y) in enumerate([(100, 14), (0, 0), (200, 28), (0, 80)])]
    df = spark.createDataFrame(boxes, "image int, idx int, x double, y double, w double, h double")
    got = {r.idx: (r.row, r.col) for r in R.grid_coordinates(df, ["image"], "idx").collect()}
    assert got == {1: (0, 0), 0: (0, 1), 2: (1, 0), 3: (2, 0)}


def test_annotation_blocks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,,\n\nChamber,Start,End,Duration\n,,,\n01 (top left),0:00:07,0:00:24,17\n,0:00:26,0:00:30,4\n,,,21\n,,,0\n02 (top right),1:00,2:00,60\n,5:00,4:00,\n,foo,4:00,\n")
    got = annotations.read_annotations(spark, str(tmp_path / "a.csv")).orderBy("row").collect()
    assert [(r.descriptor[:2], r.ord, r.start_s, r.end_s) for r in got] == [("01", 0, 7, 24), ("01", 1, 26, 30), ("02", 0, 60, 120)]


def test_bout_files_of_both_headers(spark, tmp_path):
    rows = spark.createDataFrame([("WingExt", 0, 30, 44), ("Courtship", 1, 60, 89)], "behavior string, fly int, start long, end long")
    roles = spark.createDataFrame([(0, False, True), (1, True, False)], "fly int, is_male boolean, is_female boolean")
    path = str(tmp_path / "chamber_3_results.csv")
    results.write_bouts(results.bout_rows(rows, 30.0, roles), path)
    got = results.read_bouts(spark, path).orderBy("start").collect()
    assert [(r.behavior, r.label, r.fly, r.start, r.end, r.start_s) for r in got] == [("WingExt", "Fly 0 (Female)", 0, 30, 44, 1.0), ("Courtship", "Fly 1 (Male)", 1, 60, 89, 2.0)]
    old = tmp_path / "chamber_5_results.csv"
    old.write_text('Behavior,Fly,Duration (s),Start_Frame,End_Frame,Start_Time (mm:ss),End_Time (mm:ss)\nFollowing,Fly 0,0.1,3,5,00:00,00:00\n')
    r = results.read_bouts(spark, str(old)).first()
    assert (r.chamber, r.start_s, r.end_s) == (5, 0.1, pytest.approx(5 / 30))


def test_overrides(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}',), ('{"c": 2, "d": "x"}',)], "j string")
    assert [tuple(r) for r in results.read_overrides(df, "j").collect()] == [("a", 1)]


def test_params():
    assert rules.read_params('{"follow_facing_deg": 30}')["follow_facing_deg"] == 30
    assert rules.read_params("{") == rules.DEFAULTS
    assert rules.changed({"follow_facing_deg": 30, "merge_gap_s": 1.5, "other": 2}) == {"follow_facing_deg": 30}


def test_stumps(spark):
    score = L.boosted_score([L.Stump(1, 0.5, 1, 2.0), L.Stump(2, 0.5, -1, 1.0), L.Stump(9, 0.0)], [F.lit(0.1), F.lit(None).cast("double")])
    assert one(spark, score) == 2.0 + 1.0
    assert L.token_map(["stat", "mean", "radius", "5"]) == {"stat": "mean", "radius": "5"}


def test_one_shuffle_serves_pairs_and_series(spark):
    df = spark.range(40).selectExpr("id div 20 AS video_id", "CAST(id % 2 AS INT) AS fly", "id div 2 AS frame", "rand() AS x", "rand() AS y", "rand() AS theta", "1.0 AS a", "0.5 AS b")
    plan = G.social_features(df, ["video_id"], "fly", 30.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("value > 40").select("user_id", "value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,40.0)]" in plan
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan


def test_identities_survive_a_crossing_gap(spark):
    rows = [("v", t, 10.0 + t, 50.0) for t in range(20)] + [("v", t, 100.0 - t, 50.0) for t in range(20) if not 5 <= t < 8]
    df = spark.createDataFrame(rows, "video string, frame long, x double, y double")
    got = {(r.frame, r.fly): r.x for r in I.assign_identities(df, ["video"], 20.0).collect()}
    assert all(got[t, 0] == 10.0 + t for t in range(20))
    assert got[6, 1] is None or math.isnan(got[6, 1])
    assert got[19, 1] == 81.0


def test_background_is_the_upper_median_without_arrays(spark):
    from tracklore.operators import image

    values = {1: [5.0, 1.0, 5.0, 2.0], 2: [3.0], 3: [None, None], 4: [2.0, None, 9.0], 5: [4.0, 4.0, 1.0], 6: [float("nan"), 1.0, 2.0, 1.0]}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "p int, v double")
    out = image.background(df, ["p"], "v")
    known = {k: sorted(v for v in x if v is not None) for k, x in values.items() if k < 6}
    got = {r.p: r.background for r in out.collect()}
    assert {k: got[k] for k in known} == {k: x[len(x) // 2] if x else None for k, x in known.items()} and got[6] == 2.0
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_positions_name_one_box_or_none(spark):
    """Grids of 1 to 7 rows and columns against a loop."""
    grids = {(n, m): [(r, c) for r in range(n) for c in range(m)] for n in (1, 2, 3, 4, 5) for m in (1, 2, 3, 4, 5, 6, 7)}
    places = [(row, k, col) for row in ("top", "bottom", "middle", None) for k in (0, 1, 4) for col in ("left", "right", "middle", None)]

    def expected(cells, row, k, col):
        n = max(r for r, _ in cells) + 1
        at = {"top": k, "bottom": n - 1 - k, "middle": n // 2}.get(row, -1)
        mine = [i for i, (r, _) in enumerate(cells) if r == at]
        m = len(mine)
        third = max(1, m // 3)
        if col == "left":
            mine = mine[:third]
        elif col == "right":
            mine = mine[-third:] if mine else []
        elif col == "middle" and m == 2:
            return None
        elif col == "middle" and m > 2:
            mine = mine[third : m - third] or mine[m // 2 : m // 2 + 1]
        return mine[0] if len(mine) == 1 else None

    cells = [(f"{n}x{m}", i, r, c) for (n, m), found in grids.items() for i, (r, c) in enumerate(found)]
    wanted = [(f"{n}x{m}", j, p) for n, m in grids for j, p in enumerate(places)] + [("none", 0, places[0])]
    cells = spark.createDataFrame(cells, "image string, idx long, row int, col int")
    wanted = spark.createDataFrame(wanted, "image string, j int, p struct<row_key: string, row_offset: int, col_key: string>")
    out = R.resolve_positions(cells, wanted, ["image"], "idx")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.image, r.j): r.chamber for r in out.collect()}
    assert got == {(f"{n}x{m}", j): expected(found, *p) for (n, m), found in grids.items() for j, p in enumerate(places)} | {("none", 0): None}


def test_features_by_synonym_default_and_rank(spark):

    columns = ["theta", "vel", "wing_angle", "x"]
    named = {"Abs Angle": "theta", "vel_mag": "vel", "WingSpread": "wing_angle", "x": "x", "bearing_left": None, "unknown": None, "distance2other": None}
    assert {n: L.feature_column({"perframe": n}, columns) for n in named} == named
    assert L.feature_column({}, columns) == "vel" and L.feature_column({"src": ["speed"]}, columns) == "vel"
    assert L.feature_column({}, ["x"]) is None
    assert L.feature_tokens(None, "Wing_Ext", {}, {"wingext": [["a"]]}) == [["a"]] and L.feature_tokens([["b"]], "w", {"w": [["a"]]}, {}) == [["b"]]
    values = [3.0, -1.0, 7.0, -9.0, None, 2.0]
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "k int, frame long, vel double")
    specs = [{"perframe": "velocity", "radius": 5, "stat": "max", "trans": t} for t in ("relative", 8, "10", 14, "flip", "none", "odd")]
    out = L.window_features(df, ["k"], specs).where("frame = 0").first()
    known = np.array([v for v in values if v is not None])

    def best(x):
        bins = np.percentile(x, range(0, 101, 2))
        return max(np.searchsorted(np.round(bins, 9), np.round(v, 9), side="right") / 51 for v in x)

    assert [out[f"f{k}"] for k in range(1, 8)] == pytest.approx([best(known), best(known), best(abs(known)), best(-abs(known)), 9.0, 7.0, 7.0])


def test_covered_bouts_against_frames(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(r), int(s), int(s + n)) for k, r, s, n in zip(rng.integers(0, 3, 200), rng.integers(1, 4, 200), rng.integers(0, 900, 200), rng.integers(0, 150, 200), strict=True)]
    df = spark.createDataFrame([*rows, (0, None, 5, 9)], "k int, r int, start long, end long")
    got = sorted((x.k, x.r or 0, x.start, x.end) for x in B.uncovered(df, ["k"], "r").collect())
    frames = lambda k, r: {t for a, b, s, e in rows if a == k and b < r for t in range(s, e + 1)}
    assert got == sorted([x for x in rows if not set(range(x[2], x[3] + 1)) <= frames(x[0], x[1])] + [(0, 0, 5, 9)])


def test_identities_of_the_largest_over_many_batches(spark):
    """Three detections a frame, of which the smallest is left out, in videos that batches cut."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for v in range(7):
        a, b = rng.uniform(0, 20, 2), rng.uniform(60, 80, 2)
        for t in range(60):
            a, b = a + rng.uniform(-1, 1, 2), b + rng.uniform(-1, 1, 2)
            rows += [(v, t, *map(float, a), 50.0), (v, t, *map(float, b), 40.0), (v, t, float(rng.uniform(-90, 90)), 0.0, 3.0)]
            want[v, t] = (a[0], b[0])
    rows.append((8, 0, None, 1.0, 9.0))
    df = spark.createDataFrame(rows, "v int, frame long, x double, y double, area double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    got = {(r.v, r.frame, r.fly): r.x for r in I.assign_identities(df, ["v"], 20.0, area="area").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 2 * (7 * 60 + 1) and got[8, 0, 0] is None
    assert {(v, t): (got[v, t, 0], got[v, t, 1]) for v, t in want} == want


def test_kernels_and_blobs(spark):
    from tracklore.operators import blobs as P

    assert P.kernel(3, "ellipse") == P.kernel(3, "cross") == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    assert len(P.kernel(5, "rect")) == 25 and len(P.kernel(5, "ellipse")) == 17 and P.kernel(1, "ellipse") == [(0, 0)]
    rng = np.random.default_rng(6)
    images = {v: rng.random((14, 17)) < p for v, p in enumerate((0.25, 0.5, 0.8))}
    pixels = [(v, y, x) for v, m in images.items() for y, x in zip(*(i.tolist() for i in np.nonzero(m)), strict=True)]
    mask = spark.createDataFrame(pixels, "v int, y int, x int").repartition(4)
    got = {(r.v, r.blob): (r.area, r.x, r.y, r.w, r.h, round(r.cx, 6), round(r.cy, 6)) for r in P.blobs(mask.union(mask), ["v"]).collect()}
    want = {}
    for v, m in images.items():
        left, k = {(y, x) for w, y, x in pixels if w == v}, 0
        for start in sorted(left):
            if start not in left:
                continue
            part, todo = [], [start]
            left.discard(start)
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            ys, xs = zip(*part, strict=True)
            want[v, k] = (len(part), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, round(float(np.mean(xs)), 6), round(float(np.mean(ys)), 6))
            k += 1
    assert got == want
    steps = P.kernel(3, "ellipse")
    mine = {(y, x) for v, y, x in pixels if v == 2}
    grown = {(y + i, x + j) for y, x in mine for i, j in steps}
    shut = {p for p in grown if all((p[0] + i, p[1] + j) in grown for i, j in steps)}
    assert {(r.y, r.x) for r in P.closed(mask.where("v = 2"), ["v"], steps).collect()} == shut


def test_chambers_of_the_best_setting(spark):
    from tracklore.operators import blobs as P

    squares = [(5, 5), (5, 30), (30, 5), (30, 30)]
    pixels = {(y + i, x + j) for y, x in squares for i in range(14) for j in range(14)} | {(12, x) for x in range(5, 44)}
    mask = spark.createDataFrame([(0, y, x) for y, x in pixels], "v int, y int, x int")
    found = P.detect_chambers(mask, ["v"], 2500.0, [(1, 1), (3, 1), (5, 1)]).orderBy("y", "x").collect()
    # The strip's end beside each upper square comes back with the square's own edge.
    assert [(r.setting, r.y, r.x, r.w, r.h) for r in found] == [(1, 5, 5, 15, 14), (1, 5, 29, 15, 14), (1, 30, 5, 14, 14), (1, 30, 30, 14, 14)]


def test_runs_newest_first_and_nearest_items(spark):
    files = ["a/2024-02-01_10-00-05/chamber_1_results.csv", "a/2024-02-01_10-00-05/chamber_2_results.csv", "a/2024-10-01_09-30-00/x_results.csv", "a/old/x_results.csv", "a/none/x.txt", "x_results.csv"]
    out = results.runs_newest_first(spark.createDataFrame([(f,) for f in files], "f string"), "f").collect()
    assert [tuple(r) for r in out] == [("old", "old", 1), ("2024-10-01_09-30-00", "Oct 01, 2024 09:30 AM", 1), ("2024-02-01_10-00-05", "Feb 01, 2024 10:00 AM", 2)]
    df = spark.createDataFrame([(1, 0, 10.0), (1, 0, 30.0), (1, 1, 70.0), (2, 0, None), (2, 1, 500.0), (3, 1, 55.0), (3, 0, 45.0)], "v int, fly int, x double")
    got = {r.v: r.fly for r in M.nearest_item(df, ["v"], "fly", "x", 50.0, 50.0).collect()}
    assert got == {1: 1, 2: None, 3: 0}
