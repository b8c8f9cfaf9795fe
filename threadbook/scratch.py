"""Folders that all executors share, for written tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of written tables by application, oldest first.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one serves if all runs on this machine (tests); a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="threadbook-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/threadbook-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written as Parquet to the shared folder and read back: cuts the lineage. ``cleared`` deletes what is no longer needed."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes the tables of frames that ``written`` gave, once nothing reads them any more."""
    for df in frames:
        _delete(df.sparkSession, df._written_to)
        _made[df.sparkSession.sparkContext.applicationId].remove(df._written_to)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of a query when the query has ended; otherwise they stay until the driver happens to collect its garbage. The setting is put back after."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def mark(spark: SparkSession) -> int:
    """A point in the order of written tables, for ``cleared``."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def cleared(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes the tables written after ``since``, but for the last ``keep`` of them, and gives their number. Frames that still read them must be done with."""
    made = _made.get(spark.sparkContext.applicationId, [])
    stop = max(since, len(made) - keep)
    gone = made[since:stop]
    for path in gone:
        _delete(spark, path)
    made[since:stop] = []
    return len(gone)
