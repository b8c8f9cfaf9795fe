"""Token counts: delta-maintained rollups by source, language and tokenizer version, with idempotent batch commits."""

from __future__ import annotations

import base64
import os
import uuid
from functools import cache

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Where the driver finds the merge ranks of the subword tokenizer; its version is the name of the file.
RANKS = os.environ.get("THREADBOOK_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Batches beyond the last snapshot of the totals from which a commit makes a new one.
COMPACT = 8
WORDS = "words-1"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer"]


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subword", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def version_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def count_tokens(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: two rows a document, one for words and one for subwords. Null texts have 0 tokens, very
    long ones are counted whole. The ranks at ``path`` travel from the driver to the executors.
    """
    docs.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(SparkFiles.get(name))
        return pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    both = F.map_from_arrays(F.array(F.lit(WORDS), F.lit(version_of(path))), F.array("words", "subwords"))
    counted = docs.select("doc_id", "source", "lang", words.alias("words"), F.pandas_udf(count, "long")("text").alias("subwords"))
    return counted.select("doc_id", "source", "lang", F.explode(both).alias("tokenizer", "tokens"))


# ---------------------------------------------------------------- deltas


def deltas(added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Signed sums by key: rows of ``added`` count up, those of ``removed`` down. A revised count is both."""
    signed = [df.select(*KEYS, F.lit(s).alias("docs"), (F.col("tokens") * s).alias("tokens")) for df, s in ((added, 1), (removed, -1)) if df is not None]
    out = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return out.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))


class Rollups:
    """Totals by key in a folder, maintained by committed batches of deltas.

    batches/<name> holds the deltas of a batch; the rename that gives the folder its name is the commit. totals/<n> is the n-th snapshot,
    the totals of the batches that totals/<n>/batches lists; it is the sum of the one before and of the batches committed since, and is renamed
    into place as well. Reading adds the batches since the last snapshot to it, so the cost does not grow with the history. Needs a file
    system whose rename of a folder is atomic and can refuse an existing target, such as HDFS or a local one; not an object store.
    """

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, root: str, compact: int = COMPACT):
        self.spark, self.root, self.compact = spark, root, compact
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("batches", "totals"):
            self._fs.mkdirs(path(f"{root}/{folder}"))

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/batches/{batch}"))

    def _placed(self, aside: str, target: str) -> bool:
        """Renames a finished folder to its name. False, and the folder goes, if another writer was there first."""
        source, place = self._path(aside), self._path(target)
        fs = self.spark._jvm.org.apache.hadoop.fs
        strict = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        strict[0] = fs.Options.Rename.NONE  # refuses an existing target, where a plain rename would move into it
        try:
            fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, place, strict)
        except Py4JJavaError:
            if not self._fs.exists(place):
                raise
            self._fs.delete(source, True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once: written aside, then renamed to its name. False, and no change, if that name was committed
        before or another writer commits it first. What a failed writer leaves aside is never read.
        """
        if self.committed(batch):
            return False
        aside = f"{self.root}/aside/{batch}-{uuid.uuid4().hex}"
        changes.select(*[F.col(c) for c in ("source", "lang", "tokenizer", "docs", "tokens")]).write.parquet(aside)
        if not self._placed(aside, f"{self.root}/batches/{batch}"):
            return False
        if len(self._since()[2]) >= self.compact:
            self.snapshot()
        return True

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")))

    def _since(self) -> tuple[int, list[str], list[str]]:
        """The number of the last snapshot (0: none), the batches that it holds and those that it does not."""
        last = max(map(int, self._names("totals")), default=0)
        held = [r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.root}/totals/{last}/batches").collect()] if last else []
        return last, held, sorted(set(self._names("batches")) - set(held))

    def _summed(self, last: int, since: list[str]) -> DataFrame:
        paths = [f"{self.root}/totals/{last}/rows"] * (last > 0) + [f"{self.root}/batches/{n}" for n in since]
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def snapshot(self) -> bool:
        """Makes the next snapshot of the last one and the batches since. False if another writer made it first."""
        last, held, since = self._since()
        aside = f"{self.root}/aside/totals-{uuid.uuid4().hex}"
        self._summed(last, since).write.parquet(f"{aside}/rows")
        self.spark.createDataFrame([(n,) for n in held + since], "batch string").coalesce(1).write.parquet(f"{aside}/batches")
        return self._placed(aside, f"{self.root}/totals/{last + 1}")

    def totals(self) -> DataFrame:
        """docs and tokens by key over all committed batches, without keys that no document is left in."""
        last, _, since = self._since()
        return self._summed(last, since)


def maintain(docs: DataFrame, labels: DataFrame, root: str | None = None, path: str = RANKS) -> DataFrame:
    """Totals after three batches: every document is inserted, toxic ones are deleted, and low-quality ones that remain are
    revised, their counts moving to the source's "/low" part. The deletion is sent twice and counts once.

    Null texts have 0 tokens; null sources and languages are keys of their own (a null source moves to null). Repeated rows count
    each; a label holds for all rows of its doc_id, null ids have none, and of repeated labels the largest toxic and the smallest
    quality count. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    counts = written(count_tokens(docs, path))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rollups = Rollups(spark, root or shared_dir(spark))
    gone = counts.join(marks.where("toxic = 1"), "doc_id", "left_semi")
    low = counts.join(marks.where("quality = 0 and coalesce(toxic, 0) <> 1"), "doc_id", "left_semi")
    rollups.commit("insert", deltas(added=counts))
    rollups.commit("takedown", deltas(removed=gone))
    rollups.commit("revise", deltas(added=low.withColumn("source", F.concat("source", F.lit("/low"))), removed=low))
    rollups.commit("takedown", deltas(removed=gone))
    return rollups.totals()


def op10_token_rollups(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return maintain(read("documents"), read("labels"))


#: The subword vocabulary is beyond SQL; a brute-force test holds it.
SQL = None


def word_rollups(spark, sf_dir: str) -> DataFrame:
    """The part of ``op10_token_rollups`` that SQL can say."""
    return op10_token_rollups(spark, sf_dir).where(F.col("tokenizer") == WORDS).select("source", "lang", "docs", "tokens")


EXTRA = {
    "word_rollups": (
        word_rollups,
        r"""
WITH m AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN quality = 0 THEN source || '/low' ELSE source END AS source, lang, count(*) AS docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS tokens
FROM documents LEFT JOIN m USING (doc_id) WHERE coalesce(toxic, 0) <> 1 GROUP BY 1, 2
""",
    )
}
