"""Storage that outlives an executor: written tables in the shared checkpoint folder.

Tables belong to the session that wrote them: an operator removes those it has done with, and what a
result still reads goes when the session's Python process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

_made: dict[str, SparkSession] = {}
_scopes = threading.local()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only where one machine is all there is."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {SETTING} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="fleetloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder of this run below the checkpoint root, removed with the session at the latest."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made[folder] = spark
    for made in getattr(_scopes, "open", []):
        made.append(folder)
    return folder


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Folders made in the block, by this thread, are removed at its end. For jobs whose result is written in it."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        for folder in _scopes.open.pop():
            remove(folder)


def remove(folder: str) -> None:
    """Remove a folder that this run made."""
    spark = _made.pop(folder, None)
    if spark is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder.

    Cuts the lineage, survives lost executors, and gives the planner the real size of the rows.
    """
    folder = shared_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    written = df.sparkSession.read.schema(df.schema).parquet(folder)
    written._fleetloom_folder = folder
    return written


def discard(table: DataFrame) -> None:
    """Remove the files of a table that :func:`durable` returned, once nothing reads it any more."""
    remove(table._fleetloom_folder)


@atexit.register
def _remove_all() -> None:
    for folder in list(_made):
        # The session may have been stopped already.
        with contextlib.suppress(Exception):
            remove(folder)
