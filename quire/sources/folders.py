"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set on the context.

    Where neither is set, a session on one machine gets a temporary folder; on a cluster, where executors wouldn't see
    that, it is an error.
    """
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quire-")
    if own.isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders of queries that were run, newest last, to be removed when their session ends.
_MADE: list[tuple[SparkSession, str]] = []


def run_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors see, for what one run writes and reads again; it is removed when the driver's program ends."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(remove_folders)
    _MADE.append((spark, folder))
    return folder


def remove_folders() -> None:
    """Removes all folders of runs. What was written there can't be read any more."""
    while _MADE:
        spark, folder = _MADE.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended: its folder is of no use to anyone, but nobody is left to remove it
            return
