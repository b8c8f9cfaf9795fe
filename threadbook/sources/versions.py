"""Tables that change: versions in a folder, each committed by one rename, and id ranges that several writers may take."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dims import assign_ids

#: Times that a change is made again when another writer has committed in between.
TRIES = 10


class Conflict(Exception):
    """Another writer has committed the version that this one was to be."""


class _Folder:
    """A folder on the session's file systems. Needs one whose rename is atomic and can refuse an existing target, such as HDFS or a local one; not an object store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        place = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def place(self, aside: str, target: str) -> bool:
        """Renames a finished folder. False, and the folder goes, if the target is there already."""
        fs, (source, to) = self.spark._jvm.org.apache.hadoop.fs, (self._path(f"{self.root}/{x}") for x in (aside, target))
        self._fs.mkdirs(to.getParent())
        strict = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        strict[0] = fs.Options.Rename.NONE  # a plain rename would move into it
        try:
            fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, to, strict)
        except Py4JJavaError:
            if not self._fs.exists(to):
                raise
            self._fs.delete(source, True)
            return False
        return True

    def put(self, target: str, lines: list[str]) -> bool:
        """Commits some lines under a name that is free; False if it is not."""
        aside = f"aside/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{self.root}/{aside}")
        return self.place(aside, target)

    def lines(self, name: str) -> list[str]:
        return [r.value for r in self.spark.read.text(f"{self.root}/{name}").collect()]


class VersionedTable:
    """A table whose states are versions 1, 2, ...: a version is a list of data files, and files never change.

    data/<name> holds what one write made, versions/<n> the names of the files of version n. The rename that gives versions/<n> its name is the commit; only one writer gets it, and the
    others have a ``Conflict``. A reader opens one version and sees it whole, whatever is committed meanwhile. A change rewrites the files that hold touched keys and shares all others
    with the version before. Rows lie in ranges of the key, so that few files hold a few keys and a look-up by key reads few row groups.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id"):
        self.spark, self.schema, self.key = spark, schema, key
        self._folder = _Folder(spark, root)
        self.root = self._folder.root

    def version(self) -> int:
        return max(map(int, self._folder.names("versions")), default=0)

    def files(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        return self._folder.lines(f"versions/{version}") if version else []

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.files(version))

    def _write(self, rows: DataFrame, files: int) -> list[str]:
        name = f"data/{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema]
        dealt = rows.select(*columns).repartitionByRange(files, self.key).sortWithinPartitions(self.key)
        dealt.write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(f"{self.root}/{name}")
        return [f"{name}/{f}" for f in self._folder.names(name) if f.endswith(".parquet")]

    def commit(self, files: list[str], after: int) -> int:
        """Makes ``files`` the version after ``after``."""
        if not self._folder.put(f"versions/{after + 1}", sorted(files)):
            raise Conflict(f"version {after + 1} of {self.root} is there")
        return after + 1

    def append(self, rows: DataFrame, after: int | None = None, files: int | None = None) -> int:
        """A version with more rows. With ``after``, only if that is still the last one; else after whichever is last."""
        new = self._write(rows, files or int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        if after is not None:
            return self.commit(self.files(after) + new, after)
        return self.retried(lambda last: self.commit(self.files(last) + new, last))

    def touched(self, keys: DataFrame, version: int) -> list[str]:
        """The files of a version that hold any of the keys. Only keys are read."""
        held = self.read(version).select(self.key, F.col("_metadata.file_path").alias("_file")) if self.files(version) else None
        if held is None:
            return []
        found = held.join(keys.select(self.key), self.key, "left_semi").select("_file").distinct().collect()  # names of files
        return ["/".join(r[0].split("/")[-3:]) for r in found]

    def change(self, keys: DataFrame, how: Callable[[DataFrame], DataFrame], after: int | None = None) -> int:
        """A version in which ``how`` has been applied to the rows of those files that hold any of ``keys``. ``how`` gives all rows that are to stay, and may leave out rows or add
        some. Without ``after``, a change that meets another writer's commit is made again on the new version.
        """

        def made(last: int) -> int:
            old = self.touched(keys, last)
            if not old:
                return last
            new = self._write(how(self._rows(old)), len(old))
            return self.commit([f for f in self.files(last) if f not in set(old)] + new, last)

        return made(after) if after is not None else self.retried(made)

    def retried(self, step: Callable[[int], int]) -> int:
        """Makes a step on the last version, again if another writer commits first."""
        for turn in range(TRIES):
            try:
                return step(self.version())
            except Conflict:
                if turn == TRIES - 1:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` versions and the files that no version left needs; gives the number of writes deleted. For times without other writers: what they have not
        committed yet goes too.
        """
        versions = sorted(map(int, self._folder.names("versions")))
        for v in versions[:-keep]:
            self._folder.delete(f"versions/{v}")
        needed = {f.split("/")[1] for v in versions[-keep:] for f in self.files(v)}
        gone = [n for n in self._folder.names("data") if n not in needed]
        for n in gone:
            self._folder.delete(f"data/{n}")
        self._folder.delete("aside")
        return len(gone)


class IdRanges:
    """Ids for several writers: a range is taken by committing its reservation, so no two writers have an id in common. Ids of a writer that fails are never used."""

    def __init__(self, spark: SparkSession, root: str, first: int = 1):
        self._folder, self.first = _Folder(spark, root), first

    def reserve(self, n: int) -> int:
        """The first of n ids that nobody else has."""
        while True:
            last = max(map(int, self._folder.names("ranges")), default=0)
            start = int(self._folder.lines(f"ranges/{last}")[0]) if last else self.first
            if self._folder.put(f"ranges/{last + 1}", [str(start + n)]):
                if last > 16:
                    self._folder.delete(f"ranges/{last - 16}")  # only the last ones are looked at
                return start


def with_reserved_ids(rows: DataFrame, ids: IdRanges, order: list[str], name: str = "id") -> DataFrame:
    """Rows with ids of a range of their own, in the given order."""
    n = rows.count()
    return assign_ids(rows, order, ids.reserve(n) - 1, name) if n else rows.withColumn(name, F.lit(None).cast("long"))


def get_or_create(table: VersionedTable, wanted: DataFrame, by: str, ids: IdRanges, order: list[str] | None = None) -> int:
    """A version in which every row of ``wanted`` has one with its value of ``by``: what is missing gets an id and is added, one row a value. Values are looked up again if another writer
    commits first, so two writers never make the same one twice.
    """
    columns = [c for c in wanted.columns if c != by]
    once = wanted.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(F.struct(*columns)).alias("_row")) if columns else wanted.where(F.col(by).isNotNull()).select(by).distinct()

    def made(last: int) -> int:
        new = once.join(table.read(last).select(by), by, "left_anti").select(by, *[F.col(f"_row.{c}").alias(c) for c in columns])
        if not new.limit(1).count():
            return last
        numbered = with_reserved_ids(new, ids, order or [by])
        missing = [f for f in table.read(last).schema if f.name not in numbered.columns]
        return table.append(numbered.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]), after=last, files=1)

    return table.retried(made)


def update_table(table: VersionedTable, patches: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], after: int | None = None) -> int:
    """A version in which patches (with the table's key) are applied: ``how`` takes rows and patches, as ``update_lessons`` or ``record_triggers`` do."""
    return table.change(patches.select(table.key).distinct(), lambda rows: how(rows, patches), after)
