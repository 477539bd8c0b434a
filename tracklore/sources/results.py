"""Bout files, summaries, tracks and run progress."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import known
from ..functions.text import entity_label, entity_of_label, names_male
from ..operators.bouts import merged

#: Columns of a bout file as written; older files have other times and order, so readers go by name.
BOUT_COLUMNS = ["Behavior", "Fly", "Start_Time (s)", "End_Time (s)", "Duration (s)", "Start_Frame", "End_Frame"]


def chamber_of_file(name: Column) -> Column:
    return F.regexp_extract(name, r"chamber_(\d+)_results", 1).try_cast("int")


def read_bouts(spark: SparkSession, path: str, fps: float = 30.0) -> DataFrame:
    """(chamber, behavior, label, fly, start, end, start_s, end_s) of bout files of either header."""
    raw = spark.read.option("header", True).csv(path)
    chamber = chamber_of_file(F.col("_metadata.file_name"))
    start, end = F.col("Start_Frame").try_cast("long"), F.col("End_Frame").try_cast("long")
    if missing := {"Start_Frame", "End_Frame"} - set(raw.columns):
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    seconds = (lambda c, f: F.col(f"`{c}`").try_cast("double")) if "Start_Time (s)" in raw.columns else (lambda c, f: f / fps)
    return raw.select(
        chamber.alias("chamber"), F.col("Behavior").alias("behavior"), F.col("Fly").alias("label"), entity_of_label(F.col("Fly")).alias("fly"),
        start.alias("start"), end.alias("end"), seconds("Start_Time (s)", start).alias("start_s"), seconds("End_Time (s)", end).alias("end_s"),
    )


def courtship_spans(bouts: DataFrame, keys: list[str], male_only: bool = True) -> DataFrame:
    """(keys, start, end, scope) of Courtship in seconds: the male's, else all, those that meet made one."""
    own = bouts.where(F.col("behavior") == "Courtship").select(*keys, "start_s", "end_s", names_male(F.col("label")).alias("male"))
    any_male = F.max("male").over(Window.partitionBy(*keys)) if male_only else F.lit(False)
    chosen = own.withColumn("scope", F.when(any_male, "male").otherwise("union")).where((F.col("scope") == "union") | F.col("male"))
    spans = chosen.select(*keys, "scope", F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    union = merged(spans.where("scope = 'union'"), [*keys, "scope"], 0)
    return spans.where("scope = 'male'").unionByName(union)


def bout_rows(bouts: DataFrame, fps: float, roles: DataFrame | None = None) -> DataFrame:
    """Bouts (behavior, fly, start, end) as a bout file has them, times at three decimals."""
    if roles is None:
        bouts = bouts.withColumns({"is_male": F.lit(False), "is_female": F.lit(False)})
    else:
        bouts = bouts.join(roles, "fly", "left")
    return bouts.select(
        F.col("behavior").alias("Behavior"), entity_label(F.col("fly"), F.col("is_male"), F.col("is_female")).alias("Fly"),
        F.round(F.col("start") / fps, 3).alias("Start_Time (s)"), F.round(F.col("end") / fps, 3).alias("End_Time (s)"),
        F.round((F.col("end") - F.col("start") + 1) / fps, 3).alias("Duration (s)"),
        F.col("start").alias("Start_Frame"), F.col("end").alias("End_Frame"),
    )


def write_bouts(rows: DataFrame, path: str) -> None:
    """One sorted CSV file for a chamber's bouts."""
    ordered = rows.coalesce(1).sortWithinPartitions("`Start_Time (s)`", "Behavior", "Fly", "Start_Frame")
    ordered.select([f"`{c}`" for c in BOUT_COLUMNS]).write.mode("overwrite").option("header", True).csv(path)


def write_tracks(tracks: DataFrame, path: str) -> None:
    tracks.write.mode("overwrite").partitionBy("video_id", "chamber").parquet(path)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks with NULL for NaN."""
    df = spark.read.parquet(path)
    return df.withColumns({f.name: known(F.col(f.name)) for f in df.schema if f.dataType.simpleString() in ("double", "float")})


def read_overrides(texts: DataFrame, column: str) -> DataFrame:
    """(descriptor, chamber) of JSON objects; NULLs are skipped, an object with a bad value counts for nothing."""
    parsed = F.from_json(column, "map<string,string>")
    sound = F.forall(F.map_values(parsed), lambda v: v.isNull() | v.try_cast("int").isNotNull())
    rows = texts.select(F.explode(F.when(sound, parsed)).alias("descriptor", "value"))
    return rows.where("value is not null").select("descriptor", F.col("value").cast("int").alias("chamber"))


def overrides_json(mapping: dict[str, int | None]) -> str:
    return json.dumps({k: v for k, v in mapping.items() if v is not None}, sort_keys=True)


def remaining(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Planned work that is not done."""
    return planned.join(done.select(key).distinct(), key, "left_anti")


def runs_newest_first(files: DataFrame, column: str) -> DataFrame:
    """(run, label, n) of folders that hold result files, the last name first; names that are times are shown as such."""
    parts = F.split(column, "/")
    run, name = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    found = files.select(run.alias("run"), name.alias("name")).where(F.col("name").endswith("_results.csv") & F.col("run").isNotNull())
    time = F.try_to_timestamp("run", F.lit("yyyy-MM-dd_HH-mm-ss"))
    label = F.coalesce(F.date_format(time, "MMM dd, yyyy hh:mm a"), F.col("run"))
    return found.groupBy("run").agg(F.count("*").alias("n")).select("run", label.alias("label"), "n").orderBy(F.desc("run"))


def box_lines(text: Column) -> Column:
    """Boxes of lines 'x,y,w,h'; lines without four parts are skipped, a part that is no number voids all."""
    parts = F.filter(F.transform(F.split(text, r"\n"), lambda s: F.split(F.trim(s), ",")), lambda p: F.size(p) == 4)
    boxes = F.transform(parts, lambda p: F.transform(p, lambda v: F.trim(v).try_cast("int")))
    return F.when(F.forall(boxes, lambda b: F.forall(b, lambda v: v.isNotNull())), boxes).otherwise(F.array().cast("array<array<int>>"))
