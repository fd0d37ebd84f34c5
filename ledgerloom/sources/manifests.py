"""Small JSON files that say what is valid, on any file system that Spark reaches: written beside and renamed into place."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str) -> JavaObject:
    """Hadoop's file system of a path."""
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def remove(files: JavaObject, path: str) -> None:
    """Removes a file or folder with all in it; nothing happens if it isn't there."""
    files.delete(SparkSession.active().sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    at, files = _path(spark, folder), file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def write_json(spark: SparkSession, path: str, value: Any) -> bool:
    """Writes a JSON file whole or not at all; False if there is one of that name, which stays."""
    files = file_system(spark, path)
    beside = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside, False)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if not files.exists(_path(spark, path)) and files.rename(beside, _path(spark, path)):
        return True
    files.delete(beside, False)
    return False


def read_json(spark: SparkSession, path: str) -> Any:
    """What write_json has written; None if there is no such file."""
    at, files = _path(spark, path), file_system(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def changed(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """The path, the latest change of it or of what lies in it, and how much that is."""
    at, files = _path(spark, path), file_system(spark, path)
    each = files.listStatus(at) if files.exists(at) else []
    return path, max((s.getModificationTime() for s in each), default=0), sum(s.getLen() for s in each)
