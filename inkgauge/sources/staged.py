"""Tables that operators write between jobs.

A staged table cuts lineage and survives the loss of an executor: it is plain Parquet in the
folder the cluster names in ``spark.checkpoint.dir``, which driver and executors share. What a
``scope`` staged goes when the scope ends, the rest when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
#: Paths made by this process that nobody has removed yet, with their sessions.
_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only on a local master without one."""
    global _own_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="inkgauge-")
        atexit.register(shutil.rmtree, _own_folder, True)
    return "file://" + _own_folder


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


#: Under it Spark removes a query's shuffle files when the query ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """Write ``df``; its shuffles go then, as nobody reads them once the table is there."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def remove(paths: list[str]) -> None:
    """Delete staged tables that nobody needs any more."""
    for path in paths:
        spark = _made.pop(path, None)
        if spark is None or spark.sparkContext._jsc is None:  # the session has ended; its folder is the cluster's to clear
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope() -> Iterator[set[str]]:
    """Removes what is staged inside when it ends, but for paths put into the set it gives."""
    before, kept = set(_made), set()
    try:
        yield kept
    finally:
        remove([p for p in _made if p not in before and p not in kept])


def stage_alone(made: Callable[[], DataFrame], spark: SparkSession, label: str) -> tuple[DataFrame, str]:
    """The table that ``made()`` describes, staged, and its path; whatever was staged to make it is removed."""
    with scope() as kept:
        df, path = made(), new_path(spark, label)
        _write(df, path)
        kept.add(path)
    return spark.read.schema(df.schema).parquet(path), path


def _at_end() -> None:
    try:
        remove(list(_made))
    except Exception:  # the gateway may be gone before us
        pass


atexit.register(_at_end)
