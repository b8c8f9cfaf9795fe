"""A stored text index that follows its table: segments that never change, rows struck out, segments merged, statistics kept by segment."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FIELD_WEIGHTS
from ..sources.versions import TRIES, Conflict, _Folder
from .text import build_postings, lexeme_bucket

POSTINGS = "lexeme string, id long, field string, weight double, tf long, positions array<int>, segment string, bucket int"
STATISTICS = "segment string, lexeme string, rows long, occurrences long"
#: Segments of one size class from which a merge makes one, and how much larger the next class is.
FANOUT = 4


class TextIndex:
    """Postings (as of ``build_postings``) of a table's rows, in a folder.

    postings/segment=<name>/bucket=<n> holds what one write indexed, sorted by lexeme within its bucket; statistics/segment=<name> its counts by lexeme; struck/segment=<name> the ids that the write took
    out of older segments. versions/<n> lists the live segments in order, each with its number of rows, and is committed by a rename that only one writer gets. A row is in its youngest segment only:
    an update writes the row anew and strikes it from those before; a deletion only strikes. A search reads the buckets of its lexemes in each segment, and leaves out what is struck.
    """

    def __init__(self, spark: SparkSession, root: str, weights: dict[str, float] | None = None, stem: bool = False, key: str = "id"):
        self.spark, self.weights, self.stem, self.key = spark, weights or FIELD_WEIGHTS, stem, key
        self._folder = _Folder(spark, root)
        self.root = self._folder.root

    # ------------------------------------------------------------ versions

    def version(self) -> int:
        return max(map(int, self._folder.names("versions")), default=0)

    def segments(self, version: int | None = None) -> list[tuple[str, int]]:
        """The live segments, oldest first, and how many rows each has indexed."""
        version = self.version() if version is None else version
        held = [x.split(" ") for x in self._folder.lines(f"versions/{version}")] if version else []
        return [(name, int(rows)) for _, name, rows in sorted(held, key=lambda x: int(x[0]))]

    def _commit(self, segments: list[tuple[str, int]], after: int) -> int:
        if not self._folder.put(f"versions/{after + 1}", [f"{n} {name} {rows}" for n, (name, rows) in enumerate(segments)]):
            raise Conflict(f"version {after + 1} of {self.root} is there")
        return after + 1

    # ------------------------------------------------------------ writes

    def _segment(self, postings: DataFrame, struck: DataFrame) -> str:
        name, path = uuid.uuid4().hex, self.root
        dealt = postings.select("lexeme", "id", "field", "weight", "tf", "positions").withColumn("bucket", lexeme_bucket()).repartition("bucket")
        dealt.sortWithinPartitions("bucket", "lexeme").write.partitionBy("bucket").parquet(f"{path}/postings/segment={name}")
        struck.select(F.col(self.key).cast("long").alias("id")).distinct().coalesce(1).write.parquet(f"{path}/struck/segment={name}")
        held = self._read(f"postings/segment={name}", "lexeme string, id long, tf long, bucket int")
        counts = held.groupBy("lexeme").agg(F.count_distinct("id").alias("rows"), F.sum("tf").alias("occurrences"))
        counts.write.parquet(f"{path}/statistics/segment={name}")
        return name

    def _read(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")

    def put(self, rows: DataFrame, fresh: bool = False) -> int:
        """A version in which ``rows`` (the key and the weighted fields) are indexed, instead of what was indexed for their keys. ``fresh``: none of the keys has been there before."""
        segment = self._segment(build_postings(rows, self.weights, self.stem, self.key), rows.limit(0) if fresh else rows)
        n = rows.count()
        return self._added(segment, n)

    def remove(self, ids: DataFrame) -> int:
        """A version without the rows of ``ids``."""
        none = self.spark.createDataFrame([], "lexeme string, id long, field string, weight double, tf long, positions array<int>")
        return self._added(self._segment(none, ids), 0)

    def _added(self, segment: str, rows: int) -> int:
        for turn in range(TRIES):
            last = self.version()
            try:
                return self._commit([*self.segments(last), (segment, rows)], last)
            except Conflict:
                if turn == TRIES - 1:
                    raise
        raise AssertionError

    # ------------------------------------------------------------ reads

    def _struck(self, names: list[str]) -> DataFrame | None:
        """segment and id of what later segments have taken out: a row for each older segment that may hold the id."""
        out = None
        for n, name in enumerate(names):
            if n:
                older = F.array(*[F.lit(x) for x in names[:n]])
                one = self._read(f"struck/segment={name}", "id long").select("id", F.explode(older).alias("segment"))
                out = one if out is None else out.unionByName(one)
        return None if out is None else out.distinct()

    def postings(self, version: int | None = None) -> DataFrame:
        """The postings of all live rows, with their bucket, for ``fts_rank``, ``fts_cover_rank`` and ``hybrid_search``."""
        names = [name for name, _ in self.segments(version)]
        if not names:
            return self.spark.createDataFrame([], POSTINGS).drop("segment")
        held = self.spark.read.option("basePath", f"{self.root}/postings").schema(POSTINGS).parquet(*[f"{self.root}/postings/segment={n}" for n in names])
        struck = self._struck(names)
        return (held if struck is None else held.join(struck, ["segment", "id"], "left_anti")).select("lexeme", "id", "field", "weight", "tf", "positions", "bucket")

    def statistics(self, version: int | None = None) -> DataFrame:
        """lexeme, rows and occurrences as the segments have counted them: struck rows count until a merge, as a cheap bound."""
        names = [name for name, _ in self.segments(version)]
        if not names:
            return self.spark.createDataFrame([], STATISTICS).drop("segment")
        held = self.spark.read.option("basePath", f"{self.root}/statistics").schema(STATISTICS).parquet(*[f"{self.root}/statistics/segment={n}" for n in names])
        return held.groupBy("lexeme").agg(F.sum("rows").alias("rows"), F.sum("occurrences").alias("occurrences"))

    # ------------------------------------------------------------ merges

    def due(self) -> tuple[int, int] | None:
        """The run of the youngest segments that a merge would make one: ``FANOUT`` of one size class, and any smaller ones between and after them."""
        found = self.segments()
        classes = [(max(rows, 1) - 1).bit_length() // (FANOUT.bit_length() - 1) for _, rows in found]
        start = len(classes)
        while start:
            size = classes[start - 1]
            while start and classes[start - 1] <= size:
                start -= 1
            if classes[start:].count(size) >= FANOUT:
                return start, len(classes)
        return None

    def merge(self, run: tuple[int, int] | None = None) -> int:
        """A version in which a run of neighbouring segments (that is ``due``, or the one given) is one segment, without what has been struck in it. A conflict leaves all as it was."""
        last = self.version()
        found = self.segments(last)
        run = run or self.due()
        if run is None:
            return last
        names = [name for name, _ in found[run[0] : run[1]]]
        held = self.spark.read.option("basePath", f"{self.root}/postings").schema(POSTINGS).parquet(*[f"{self.root}/postings/segment={n}" for n in names])
        struck = self._struck([name for name, _ in found])  # by later segments, within the run and after it
        alive = held if struck is None else held.join(struck, ["segment", "id"], "left_anti")
        taken = self.spark.read.schema("id long").parquet(*[f"{self.root}/struck/segment={n}" for n in names])  # older segments still need them
        if run[0] == 0:
            taken = taken.limit(0)
        segment = self._segment(alive, taken.withColumnRenamed("id", self.key))
        rows = self._read(f"postings/segment={segment}", "id long, bucket int").agg(F.count_distinct("id")).first()[0]
        return self._commit([*found[: run[0]], (segment, rows), *found[run[1] :]], last)

    def vacuum(self) -> int:
        """Deletes what the last version does not need; for times without readers of older ones and other writers."""
        last = self.version()
        needed = {name for name, _ in self.segments(last)}
        for v in self._folder.names("versions"):
            if int(v) < last:
                self._folder.delete(f"versions/{v}")
        gone = {n for f in ("postings", "struck", "statistics") for n in self._folder.names(f) if n.removeprefix("segment=") not in needed}
        for n in gone:
            for f in ("postings", "struck", "statistics"):
                self._folder.delete(f"{f}/{n}")
        self._folder.delete("aside")
        return len(gone)
