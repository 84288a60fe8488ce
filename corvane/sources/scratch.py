"""Folders for short-lived tables, shared by driver and executors; removed when the driver's process ends."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

_LOCAL: list[str] = []
_MADE: dict[str, SparkSession] = {}

#: Share of its limit that the driver's heap may hold between jobs; above it, growth since the last collection that is worth another.
HEAP_SHARE = 0.4
HEAP_GROWTH = 1.1
_SETTLED = [0]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where driver and executors are one machine, a local folder will do."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
    return _LOCAL[0]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with all it holds at the end of the process or by ``sweep``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def settle(spark: SparkSession) -> None:
    """Lets the driver's JVM give back the memory by which plans have grown its heap.

    A plan is garbage once its job has run, but what the heap has grown by is only given back by a full
    collection, which a driver of many short jobs hardly ever makes by itself.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    total = runtime.totalMemory()
    _SETTLED[0] = min(_SETTLED[0], total)
    if total > max(HEAP_SHARE * runtime.maxMemory(), HEAP_GROWTH * _SETTLED[0]):
        spark._jvm.java.lang.System.gc()
        _SETTLED[0] = runtime.totalMemory()


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep() -> None:
    """Removes all scratch folders of this process; what is still to be read must not depend on them."""
    while _MADE:
        path, spark = _MADE.popitem()
        remove(spark, path)


@atexit.register
def _at_end() -> None:
    # without its JVM the process can reach no store any more
    with contextlib.suppress(Py4JError, OSError, AttributeError):
        sweep()
