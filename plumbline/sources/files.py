"""Small JSON files on any Hadoop file system."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, text: str):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def read_json(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """A small JSON file on any Hadoop file system; None when missing or unreadable."""
    p = hadoop_path(spark, path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        return json.loads(text)
    except ValueError:
        return None
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: dict[str, Any], replace: bool = True) -> bool:
    """Write beside the target, then rename, so a reader never sees half a file; without ``replace`` False if it exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    target, draft = hadoop_path(spark, path), hadoop_path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    fs = target.getFileSystem(conf)
    out = fs.create(draft, True)
    out.write(json.dumps(value, indent=2).encode())
    out.close()
    option = hadoop.Options.Rename.OVERWRITE if replace else hadoop.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = option
    try:
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except Py4JJavaError as exc:
        fs.delete(draft, False)
        if replace or "FileAlreadyExists" not in exc.java_exception.getClass().getName():
            raise
        return False
    return True
