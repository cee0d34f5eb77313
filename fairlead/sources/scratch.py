"""Where a session's scratch tables lie: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one of our own only where none is set and all work is on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("fairlead.scratch.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fairlead-")
        spark.conf.set("fairlead.scratch.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/fairlead-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table below the shared folder: what is derived from it does not make it again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once[T](*parts: Callable[[], T]) -> list[T]:
    """What ``parts``, which write tables of their own, give: planned and run side by side, so that none waits for the last tasks of another."""
    with ThreadPoolExecutor(max(len(parts), 1)) as pool:
        return [job.result() for job in [pool.submit(inheritable_thread_target(part)) for part in parts]]
