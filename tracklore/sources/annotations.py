"""Hand-made annotations: blocks of intervals in a CSV file without a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import time_seconds


def parse_blocks(lines: DataFrame) -> DataFrame:
    """(descriptor, ord, start_s, end_s, row) from (file, row, c0, c1, c2) of annotation files.

    Rows after the one whose first cell is 'chamber' count. A filled first cell opens a block,
    whose name the rows below inherit; a bout is kept if both times parse and end after start.
    A file without such a row has none.
    """
    cell = F.trim(F.coalesce("c0", F.lit("")))
    w = Window.partitionBy("file").orderBy("row")
    header = F.min(F.when(F.lower(cell) == "chamber", F.col("row"))).over(Window.partitionBy("file"))
    rows = lines.withColumn("__h", header).where(F.col("row") > F.col("__h"))
    named = rows.withColumn("descriptor", F.last(F.when(cell != "", cell), ignorenulls=True).over(w))
    timed = named.select("file", "row", "descriptor", time_seconds(F.col("c1")).alias("start_s"), time_seconds(F.col("c2")).alias("end_s"))
    bouts = timed.where(F.col("descriptor").isNotNull() & (F.col("end_s") > F.col("start_s")))
    order = F.row_number().over(Window.partitionBy("file", "descriptor").orderBy("row")) - 1
    return bouts.withColumn("ord", order)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``parse_blocks`` of small CSV files; each is one row until its lines are numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    lines = whole.select("file", F.posexplode("lines").alias("row", "line"))
    cells = F.from_csv("line", F.lit("c0 STRING, c1 STRING, c2 STRING, c3 STRING"), {"mode": "PERMISSIVE"})
    return parse_blocks(lines.select("file", "row", cells.alias("c")).select("file", "row", "c.c0", "c.c1", "c.c2"))
