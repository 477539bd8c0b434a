"""Queries at sizes and on rows where they once failed or differed from their SQL."""

import duckdb
import numpy as np
import pytest

from tracklore.operators import blobs as P
from tracklore.operators import frames
from tracklore.operators import split as Q
from tracklore.plans import catalog


def in_duckdb(name, folder, *tables):
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
        return sorted(db.execute(catalog.oracle_sql()[name]).fetchall())


def test_frame_labels_at_whole_frames(spark, tmp_path):
    """Spans that end at whole frames, where 0.37 as a double ends them elsewhere than as a decimal."""
    rows = spark.range(0, 61 * 300).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id div 61 AS user_id", "'view' AS event_type", "IF(id % 61 in (3, 6, 12, 24, 48, 60), CAST(61 + id div 61 AS DOUBLE), 0D) AS value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["frame_labels"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.frame) for r in got) == in_duckdb("frame_labels", tmp_path, "events")


@pytest.mark.parametrize("name", ["adaptive_foreground", "warm_foreground", "contour_areas", "fitted_bodies", "wing_angles", "bodies_found_again", "split_discs"])
def test_exploded_rows_are_not_broadcast(spark, name):
    """Spark takes rows for as few bytes as what they were exploded from, whatever they are made into."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_lost_bodies_keep_their_holes(spark, tmp_path):
    """Parts of sf0.1 whose masks have a hole, which the SQL leaves."""
    parts = spark.read.parquet("/root/testdata/sf0.1/part.parquet").where("p_partkey div 2 in (356, 1500, 1501)")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["bodies_found_again"](spark, str(tmp_path)).collect()
    assert sorted((r.image, r.fly, r.n, r.area, r.x, r.y) for r in got) == in_duckdb("bodies_found_again", tmp_path, "part")


def noise(seed, n, shape=(13, 17)):
    rng = np.random.default_rng(seed)
    return {k: rng.random(shape) < rng.choice([0.3, 0.55, 0.7, 0.85]) for k in range(n)}


def pixel_rows(spark, images):
    return spark.createDataFrame([(k, int(y), int(x)) for k, m in images.items() for y, x in zip(*np.nonzero(m), strict=True)], "v int, y int, x int")


def test_images_whole_like_images_linked(spark):
    """Blobs and contours of many images as the work of tasks, against the links of one image and counted squares."""
    images = noise(3, 2)
    for k, m in images.items():
        one = pixel_rows(spark, {k: m}).drop("v")
        want = {(r.blob, r.y, r.x, r.contour_area) for r in P.outer_contours(one, [], 1.0).collect()}
        y, x = np.nonzero(m)
        image, (blob, row, s, e, area) = frames.contours(np.zeros(len(y), int), y, x, 1.0)
        assert {(b, r, i, a) for b, r, s, e, a in zip(blob, row, s, e, area, strict=True) for i in range(s, e + 1)} == want and not image.any()
    places = {(r.v, r.y, r.x): r.blob for r in P.blob_pixels(pixel_rows(spark, images), ["v"]).collect()}
    for k, m in images.items():
        assert {(r.y, r.x): r.blob for r in P.blob_pixels(pixel_rows(spark, {k: m}).drop("v"), []).collect()} == {p[1:]: b for p, b in places.items() if p[0] == k}


def test_floods_against_a_loop(spark):
    images, seeds = noise(5, 4), {}
    rng = np.random.default_rng(6)
    for k, m in images.items():
        on = np.argwhere(m)
        seeds |= {(k, *map(int, p)): int(n) for n, p in enumerate(on[rng.choice(len(on), 4, replace=False)])}
    marked = spark.createDataFrame([(*p, n) for p, n in seeds.items()], "v int, y int, x int, label int")
    got = {(r.v, r.y, r.x): r.label for r in Q.flooded(pixel_rows(spark, images), marked, ["v"]).collect()}
    want, edge = dict(seeds), set(seeds)
    while edge:
        reached = {}
        for v, y, x in edge:
            for q in ((v, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= q[1] < 13 and 0 <= q[2] < 17 and images[v][q[1:]] and q not in want:
                    reached[q] = min(reached.get(q, 99), want[v, y, x])
        want, edge = want | reached, set(reached)
    assert got == want
