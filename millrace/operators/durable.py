"""Cutting lineage into storage that every executor can read.

A materialised frame is written by ``checkpoint()`` to the folder named by
``spark.checkpoint.dir``, a stored one as Parquet beside it. The folder is read from the
session; only when the session names none (tests, laptops) is one chosen here. Stored files
go when they are dropped, or with the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure ``checkpoint()`` can be called on this session."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and (context.master.startswith("local[") or context.master == "local"):
        named = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    if named is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named)


def materialise(frame: DataFrame) -> DataFrame:
    """Compute ``frame`` once, into shared storage; later reads do not recompute it."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Narrow rows that one task and one file of a materialised frame are worth.
ROWS_A_TASK = 200_000


def tasks_for(rows: int) -> int:
    """How many tasks a frame of at most ``rows`` narrow rows is worth: few rows need few tasks and files."""
    return max(1, -(-rows // ROWS_A_TASK))


def _hadoop_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in shared storage; what is written there goes with the session."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    files, at = _hadoop_path(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder whose rows are read no more."""
    files, at = _hadoop_path(spark, path)
    files.delete(at, True)


def stored(frame: DataFrame, name: str = "stored") -> DataFrame:
    """``frame`` computed once, into Parquet files in shared storage, so that later reads take only their columns."""
    path = f"{shared_folder(frame.sparkSession, name)}/rows"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Input that a core is worth: smaller inputs are dealt to all cores before costly maps.
BYTES_A_CORE = 32 << 20


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` dealt to all cores if it is small and its files are fewer than cores; as it is otherwise.

    A file that cannot be split is one task's work. A table that can keep every core busy is never shuffled for this.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Only the files of a small table are listed.
    return frame.repartition(cores) if size < cores * BYTES_A_CORE and len(frame.inputFiles()) < cores else frame
