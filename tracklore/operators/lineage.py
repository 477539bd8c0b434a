"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that are worth a task.
TASK_ROWS = 32_768


def found_by_workers(spark: SparkSession) -> None:
    """Workers on this machine find the package wherever the driver was started; a cluster installs it."""
    context = spark.sparkContext
    if context.master.startswith("local["):
        paths = [str(Path(__file__).parents[2]), *filter(None, context.environment.get("PYTHONPATH", "").split(os.pathsep))]
        context.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, kept in the folder of spark.checkpoint.dir (one of its own where that is unset)."""
    _shared(df.sparkSession)
    return df.checkpoint()


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more tasks than these are worth, or than there are cores.

    No row is moved. Iterations over small tables otherwise run a task for each shuffle partition,
    whatever it holds; tables of more than TASK_ROWS rows a partition stay as they are dealt.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def cut_fitted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut(df)``, fitted to its rows, and their number."""
    done = cut(df)
    rows = fitted(done, 0).count()
    return fitted(done, rows), rows


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
