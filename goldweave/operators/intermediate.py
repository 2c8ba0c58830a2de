"""Intermediate results in the folder that driver and executors share.

Everything that one application writes lies in one folder of its own, which is
deleted when the process ends; what an operator has consumed goes earlier.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Folders of this process's applications, with the JVM and its configuration, which outlive a session.
_FOLDERS: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder.

    Without either, a run inside one JVM (``local[...]``) takes a temporary
    folder; on a cluster, whose machines share no such folder, it's an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        found = getattr(spark, "_goldweave_dir", None) or "file://" + tempfile.mkdtemp(prefix="goldweave-")
        spark._goldweave_dir = found
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/goldweave-{spark.sparkContext.applicationId}"
    if not _FOLDERS:
        atexit.register(clean)
    _FOLDERS[folder] = (spark._jvm, spark._jsc.hadoopConfiguration())
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._goldweave_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these frames; nothing may read them, or what was made from them, any more."""
    for df in frames:
        spark = df.sparkSession
        _delete(spark._jvm, spark._jsc.hadoopConfiguration(), df._goldweave_path)


def clean() -> None:
    """Delete everything that this process's applications wrote down; runs by itself when the process ends."""
    for folder, (jvm, conf) in list(_FOLDERS.items()):
        try:
            _delete(jvm, conf, folder)
        except (Py4JError, OSError):  # the JVM is gone already
            pass
        del _FOLDERS[folder]


def _delete(jvm, conf, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
