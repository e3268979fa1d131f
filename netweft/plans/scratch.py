"""Tables in the folder that driver and executors share.

Lineage is cut by writing a table there and reading it again, so that a lost
executor costs only the tasks that it was running. What an operator no longer
needs it removes; the rest, which results still read, goes when the driver ends.
"""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a temporary folder if the session is a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="netweft-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of that name that nobody uses yet; not created."""
    return f"{shared_root(spark)}/netweft/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, uri: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, *uris: str) -> None:
    """Deletes folders, through Hadoop so that any store works."""
    for uri in uris:
        store, path = _store(spark, uri)
        store.delete(path, True)
        store.cancelDeleteOnExit(path)


def passing(spark: SparkSession, uri: str) -> str:
    """The URI of a folder that is there; it is deleted when the driver ends."""
    store, path = _store(spark, uri)
    store.deleteOnExit(path)
    return uri


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` and reads it back: ``(table, its folder)``."""
    spark = df.sparkSession
    uri = new_folder(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(passing(spark, uri)), uri
