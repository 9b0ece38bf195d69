"""Small files that are there whole or not at all, on whatever file system the paths name.

Uses the session's Hadoop file systems, as Spark does for its own checkpoints; a rename must be atomic there.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; ``False``, and nothing changed, where there is one already."""
    jvm, fs = spark._jvm, _system(spark, path)
    if fs.exists(_path(spark, path)):
        return False
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    out = fs.create(_path(spark, draft), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    try:  # fails where another writer came first
        context.rename(context.makeQualified(_path(spark, draft)), context.makeQualified(_path(spark, path)), options)
    except Py4JJavaError as e:
        fs.delete(_path(spark, draft), False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs = _system(spark, path)
    size = fs.getFileStatus(_path(spark, path)).getLen()
    stream = fs.open(_path(spark, path))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, without drafts and other hidden ones; none where there is no folder."""
    fs = _system(spark, folder)
    if not fs.exists(_path(spark, folder)):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(_path(spark, folder))]
    return sorted(n for n in found if not n.startswith((".", "_")))


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)
