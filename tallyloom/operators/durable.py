"""Tables written to the cluster's shared folder, so that lost executors cost no recomputation.

The folder is the session's ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary
folder of its own; on a cluster a missing setting is an error, as a machine-local folder would not survive there.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing = threading.Lock(), []


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, a write deletes its shuffle files as soon as it ends, not when the driver happens to collect its garbage."""
    with _lock:
        if not _writing:
            _writing.append(spark.conf.get(_FREED, None))
            spark.conf.set(_FREED, "true")
        else:
            _writing.append(None)
    try:
        yield
    finally:
        with _lock:
            last = _writing[0]
            _writing.pop()
            if not _writing:
                spark.conf.unset(_FREED) if last is None else spark.conf.set(_FREED, last)


def durable(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """df, computed once, written to the shared folder and read again: lineage ends at the written files."""
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a durable table that no later step reads."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.durable_path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
