"""What a session needs: the package on executors that don't have it, the folder that all share, files behind any URL."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are processes of this machine."""
    return spark.sparkContext.master.startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only on a local master is a temporary one made where none is set; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keyloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Files:
    """Folders behind any URL that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing if there is none."""
        return sorted(f.getPath().getName() for f in self.system.listStatus(self.path(path))) if self.exists(path) else []

    def totals(self, path: str) -> tuple[int, int]:
        """Number and bytes of all files below a folder."""
        told = self.system.getContentSummary(self.path(path))
        return told.getFileCount(), told.getLength()

    def delete(self, path: str) -> None:
        self.system.delete(self.path(path), True)


def ship(spark: SparkSession) -> None:
    """Sends the package along as a zip file, once for an application, unless workers find it by their path anyway."""
    context = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if context.applicationId in _shipped or (is_local(spark) and (ROOT in paths or os.getcwd() == ROOT)):
        return
    folder = tempfile.mkdtemp(prefix="keyloom-zip-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "keyloom"), "zip", ROOT, "keyloom"))
    _shipped.add(context.applicationId)


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, which ships the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
