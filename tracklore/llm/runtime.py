"""Session settings and lineage cuts shared by the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import cut_fitted as cut_fitted
from ..operators.lineage import fitted as fitted
from ..operators.lineage import found_by_workers

#: Rows and bytes of one Arrow batch: a Python worker holds a few such batches at most.
BATCH_ROWS = 2048
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, free shuffle files once a job is over and checkpoints once no DataFrame
    uses them, and name a checkpoint folder if none is set.

    The settings stay: results are computed after the operators return. A cluster names the shared folder in ``spark.checkpoint.dir``; only where that is unset, as
    in tests on one machine, a folder is made here.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    context = spark.sparkContext
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    found_by_workers(spark)
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark drop the checkpoints and shuffle files that no DataFrame uses any more.

    Its cleaner acts once the driver's JVM has collected what held them, which a driver with
    memory to spare does too seldom for the disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors share."""
    context = prepare(spark).sparkContext
    return f"{spark.conf.get('spark.checkpoint.dir', None) or context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
