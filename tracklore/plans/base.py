"""Tables as series and tracks, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import with_frames

TAU = 6.283185307179586


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: Column, each: int) -> DataFrame:
    """``df`` dealt by ``key`` to tasks of a million of the rows that will be made of it, ``each`` of one; as many tasks as cores at least.

    What follows works on the rows of a key together, and moves none of the many rows again.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() * each // 1_000_000))
    return df.repartition(n, key)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one series for each user, frames in order of time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return with_frames(events, ["user_id"], ["ts", "event_id"])


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ``x`` (and the angle ``h``) unknown at errors."""
    known = F.when(F.col("event_type") != "error", F.col("value"))
    return series(spark, sf_dir).withColumns({"x": known, "h": F.pmod(known, F.lit(TAU))})


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in pairs as two entities in one video, with places, headings and sizes made of their events."""
    s = series(spark, sf_dir)
    angle = F.pmod(F.col("event_id"), F.lit(360)) * (TAU / 360)
    return s.select(
        F.floor(F.col("user_id") / 2).alias("video_id"), F.pmod("user_id", F.lit(2)).cast("int").alias("fly"), "frame",
        (20 + F.col("value") / 20 * F.cos(angle)).alias("x"), (20 + F.col("value") / 20 * F.sin(angle)).alias("y"),
        F.pmod("value", F.lit(TAU)).alias("theta"), (5 + F.pmod("event_id", F.lit(11))).cast("double").alias("a"),
        ((5 + F.pmod("event_id", F.lit(11))) / 2).alias("b"), F.pmod("value", F.lit(1.6)).alias("wing_angle"),
    )


SERIES = """s AS (
  SELECT event_id, ts, user_id, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"""
GAPPY = SERIES + f""", g AS (
  SELECT *, CASE WHEN event_type <> 'error' THEN value END AS x,
         CASE WHEN event_type <> 'error' THEN fmod(value, {TAU}) END AS h FROM s)"""
TRACKS = SERIES + f""", t AS (
  SELECT user_id // 2 AS video_id, CAST(user_id % 2 AS INT) AS fly, frame,
         20 + value / 20 * cos((event_id % 360) * {TAU / 360}) AS x, 20 + value / 20 * sin((event_id % 360) * {TAU / 360}) AS y,
         fmod(value, {TAU}) AS theta, CAST(5 + event_id % 11 AS DOUBLE) AS a, (5 + event_id % 11) / 2.0 AS b,
         fmod(value, 1.6) AS wing_angle FROM s)"""


def pmod(x: str, m: str = str(TAU)) -> str:
    """SQL for the remainder with the sign of the modulus."""
    return f"(fmod(fmod({x}, {m}) + {m}, {m}))"


def signed(x: str) -> str:
    """SQL for an angle in [-pi, pi)."""
    return f"({pmod(f'({x}) + {TAU / 2}')} - {TAU / 2})"


def runs_sql(source: str, keys: str, cond: str, name: str) -> str:
    """CTE of the runs of frames where ``cond`` holds."""
    return f"""{name} AS (
  SELECT {keys}, min(frame) AS s, max(frame) AS e FROM (
    SELECT {keys}, frame, frame - row_number() OVER (PARTITION BY {keys} ORDER BY frame) AS grp FROM {source} WHERE {cond})
  GROUP BY {keys}, grp)"""


def merged_sql(source: str, keys: str, gap: float, name: str, where: str = "TRUE") -> str:
    """CTE of the intervals of ``source`` at most ``gap`` apart, made one."""
    return f"""{name}_0 AS (
  SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source} WHERE {where}),
{name}_1 AS (
  SELECT *, sum(CASE WHEN s - reach <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS sid FROM {name}_0),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_1 GROUP BY {keys}, sid)"""
