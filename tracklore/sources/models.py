"""Classifier definitions as JSON: behaviour, stumps and feature tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded

MODEL = (
    "behavior STRING, score_filename STRING, timestamp DOUBLE, feature_names ARRAY<ARRAY<STRING>>,"
    " learners ARRAY<STRUCT<dim: INT, tr: DOUBLE, dir: INT, alpha: DOUBLE>>"
)


def read_models(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Models of JSON files (one object each), the file's name where there is no behaviour; ``only`` by folded name."""
    raw = spark.read.schema(MODEL).json(path, multiLine=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    models = raw.withColumn("behavior", F.coalesce("behavior", name))
    if only is None:
        return models
    return models.where(folded(F.col("behavior")).isin([*map(_fold, only)]))


def _fold(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def stumps(models: DataFrame) -> DataFrame:
    """(behavior, learner, dim, thr, direction, alpha); direction and alpha default to 1, broken ones are skipped."""
    rows = models.select("behavior", F.posexplode("learners").alias("learner", "s")).where("s.dim is not null and s.tr is not null")
    return rows.select(
        "behavior", "learner", "s.dim", F.col("s.tr").alias("thr"), F.coalesce("s.dir", F.lit(1)).alias("direction"), F.coalesce("s.alpha", F.lit(1.0)).alias("alpha")
    )
