"""Archives of tracks: files as NumPy writes them, round trips, failures, columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.sources import archives as A


def test_archives_as_numpy_writes_them(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    rng = np.random.default_rng(1)
    x = rng.random((2, 40))
    x[1, 3:6] = np.nan
    arrays = {f"fly_{k}_{f}": x[k] * (n + 1) for k in (0, 1) for n, f in enumerate(A.FIELDS[:6])} | {"fly_0_wing_angle": x[0]}
    np.savez_compressed(tmp_path / "run1/chamber_3_tracks.npz", fps=np.array([25.0]), overlap_0=x[0] > 0.5, **arrays)
    np.savez_compressed(tmp_path / "run1/chamber_11_tracks.npz", fly_0_x=np.arange(3.0))
    (tmp_path / "chamber_4_tracks.npz").write_bytes(b"no archive")
    (tmp_path / "run1/other.npz").write_bytes(b"")
    got = {(r.run, r.chamber, r.fly, r.frame): r for r in A.read_archives(spark, str(tmp_path)).collect()}
    assert len(got) == 83 and {k[:2] for k in got} == {("run1", 3), ("run1", 11)}
    for k in (0, 1):
        for t in range(40):
            r = got["run1", 3, k, t]
            assert r.fps == 25.0 and r.overlap == bool(x[0, t] > 0.5)
            assert (r.x is None and math.isnan(x[k, t])) or (r.x, r.area) == (x[k, t], x[k, t] * 6)
            assert r.wing_angle == (x[0, t] if k == 0 else None)
    assert (got["run1", 11, 0, 2].x, got["run1", 11, 0, 2].fps, got["run1", 11, 0, 2].overlap) == (2.0, 30.0, None)
    some = A.read_archives(spark, str(tmp_path), ["frame", "y"])
    assert some.columns == ["frame", "y"] and some.count() == 83
    one = A.read_archives(spark, str(tmp_path / "run1/chamber_11_tracks.npz"))
    assert one.count() == 3
    assert A.read_archives(spark, str(tmp_path / "none")).count() == 0 if (tmp_path / "none").mkdir() is None else True


def test_round_trip_and_failures(spark, tmp_path):
    rows = spark.range(1200).select(
        F.concat(F.lit("run"), (F.col("id") % 2).cast("string")).alias("run"), F.expr("cast(id div 2 % 3 as int)").alias("chamber"), F.lit(30.0).alias("fps"),
        F.expr("cast(id div 6 % 2 as int)").alias("fly"), F.expr("id div 12").alias("frame"), F.when(F.col("id") % 7 > 0, F.rand(3)).alias("x"), F.col("id").cast("double").alias("area"), (F.expr("id div 12") % 5 == 0).alias("overlap"),
    ).repartition(5)
    rows = rows.cache()
    path = str(tmp_path / "out")
    A.write_archives(rows, path)
    names = ["run", "chamber", "fps", "fly", "frame", "x", "area", "overlap"]
    back = A.read_archives(spark, path)
    assert sorted(map(tuple, back.select(names).collect()), key=str) == sorted(map(tuple, rows.select(names).collect()), key=str)
    assert back.where("y is not null").count() == 0
    files = sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*") if f.is_file())
    assert files == sorted(f"out/run{r}/chamber_{c}_tracks.npz" for r in (0, 1) for c in (0, 1, 2))
    with np.load(tmp_path / "out/run0/chamber_1_tracks.npz") as data:
        assert sorted(data.files) == ["fly_0_area", "fly_0_x", "fly_1_area", "fly_1_x", "fps", "overlap_0"] and len(data["fly_0_x"]) == 100
    with pytest.raises(Exception, match="exists"):
        A.write_archives(rows, path)
    bad = rows.withColumn("x", F.when((F.col("chamber") == 2) & (F.col("frame") == 60), F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        A.write_archives(bad, str(tmp_path / "bad"))
    assert not [f for f in (tmp_path / "bad").rglob("*") if f.is_file()]
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*") if f.is_file()) == files
    A.write_archives(rows.withColumn("x", F.lit(1.0)), path, overwrite=True)
    assert A.read_archives(spark, path).select("x").distinct().count() == 1
