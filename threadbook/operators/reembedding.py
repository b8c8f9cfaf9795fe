"""Re-embedding that goes on where it stopped: ranges of ids as pages, each committed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import embed
from ..sources.versions import _Folder

PAGE_ROWS = 100_000
MADE = "id long, vector array<float>, error string"


class EmbeddingLedger:
    """The pages of one re-embedding, in a folder. ``plan`` holds the bounds of the pages, by id, and is committed first, so that every run has the same; pages/<n> holds the vectors of page n and
    is committed by a rename once its rows have been asked for. A run that is repeated after a failure asks for the pages that are missing, and two runs at once never both commit a page.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self._folder = spark, _Folder(spark, root)
        self.root = self._folder.root

    def plan(self, due: DataFrame, page_rows: int = PAGE_ROWS) -> list[tuple[int, int]]:
        """The first and last id of each page: of about ``page_rows`` due rows each, by approximate quantiles."""
        if "plan" not in self._folder.names(""):
            n, low, high = due.agg(F.count("id"), F.min("id"), F.max("id")).first()
            pages = -(-n // page_rows)
            cuts = due.agg(F.percentile_approx("id", [i / pages for i in range(1, pages)], 100_000)).first()[0] if pages > 1 else []
            edges = sorted({low, *(c + 1 for c in cuts if c < high)}) if n else []
            self._folder.put("plan", [f"{a} {b - 1}" for a, b in zip(edges, [*edges[1:], high + 1], strict=True)] if n else [])
        return sorted(tuple(map(int, x.split())) for x in self._folder.lines("plan"))

    def pending(self, pages: int) -> list[int]:
        done = set(self._folder.names("pages"))
        return [n for n in range(pages) if str(n) not in done]

    def made(self) -> DataFrame:
        """id, vector and error of all committed pages."""
        names = self._folder.names("pages")
        return self.spark.read.schema(MADE).parquet(*[f"{self.root}/pages/{n}" for n in names]) if names else self.spark.createDataFrame([], MADE)

    def progress(self, due: DataFrame) -> DataFrame:
        """total, processed and errors so far."""
        done = self.made().agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errors"))
        return due.agg(F.count("*").alias("total")).join(done).select("total", "processed", "errors")  # a row each


def reembed_pages(obs: DataFrame, ledger: EmbeddingLedger, load=None, model_id: int | None = None, only_missing: bool = True, page_rows: int = PAGE_ROWS) -> DataFrame:
    """As ``reembed``, a page of ids at a time: each page is a job of its own whose vectors are written and committed before the next one is asked for, so that what has been asked stays, whatever
    fails later. The result is the observations with all that has been made, and embedding_error; rows without an id keep what they have.
    """
    due = obs.where(F.col("embedding").isNull()) if only_missing else obs
    pages = ledger.plan(due, page_rows)
    for n in ledger.pending(len(pages)):
        first, last = pages[n]
        asked = embed(due.where(F.col("id").between(first, last)).select("id", "raw_text"), "raw_text", "vector", load)
        aside = f"aside/{uuid.uuid4().hex}"
        asked.select("id", "vector", F.col("vector_error").alias("error")).write.parquet(f"{ledger.root}/{aside}")
        ledger._folder.place(aside, f"pages/{n}")
    made = ledger.made().select("id", F.col("vector").alias("_new"), F.col("error").alias("embedding_error"))
    fresh = F.col("_new").isNotNull()
    out = obs.join(made, "id", "left").withColumns({"embedding_model_id": F.when(fresh, F.lit(model_id).cast("long")).otherwise(F.col("embedding_model_id")), "embedding": F.coalesce("_new", "embedding")})
    return out.select(*obs.columns, "embedding_error")
