"""Materialising an intermediate result that several later jobs read."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_REGISTERED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session that driver and executors all see; it goes when the session's JVM ends.

    It lies in ``spark.checkpoint.dir``, else in the context's checkpoint folder, else on the
    default file system. A local default file system is shared only if the master is local.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    given = context._jsc.sc().getCheckpointDir()
    if not root and given.isDefined():
        root = given.get()
    if not root:
        default = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if not default.startswith("file:"):
            root = f"{default.rstrip('/')}/tmp"
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            root = f"file://{context._jvm.java.lang.System.getProperty('java.io.tmpdir')}"
        else:
            raise RuntimeError("Executors do not share the local file system: set spark.checkpoint.dir to a shared folder.")
    folder = f"{root.rstrip('/')}/plumbline-{context.applicationId}"
    if folder not in _REGISTERED:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _REGISTERED.add(folder)
    return folder


def new_path(spark: SparkSession, kind: str = "stage") -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a result once and continue from the files: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_once(*calls: Callable[[], Any], together: int = 4) -> list[Any]:
    """Results of calls that each run Spark jobs of their own; jobs of several share the executors."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max(1, min(together, len(calls)))) as pool:
        return [job.result() for job in [pool.submit(inherit(call)) for call in calls]]
