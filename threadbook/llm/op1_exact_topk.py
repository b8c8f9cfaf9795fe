"""Exact top-k search by no-random-access aggregation over sorted lists, one list a component."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

K = 5
SCALE = 256
#: Vectors whose lists one task holds, and queries it answers.
SHARD = 4096
QUERIES = 4096
#: Frontiers to which all lists are read, as shares of the root mean square of what one list can add.
FRONTIERS = (0.5, 0.3, 0.2, 0.12, 0.09, 0.06, -np.inf)
#: Reading stops when at most so many rows may still qualify; their final scores are resolved.
FEW = 32


class SortedLists:
    """Each component of a shard's vectors as a list of rows by value."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        up = np.argsort(vectors, axis=0, kind="stable")
        values = np.ascontiguousarray(np.take_along_axis(vectors, up, 0).T).astype(np.float64)
        self.rows = np.ascontiguousarray(up.T.astype(np.int32))
        self.largest = np.abs(values).max(axis=1, initial=0)
        self.above = values - values[:, :1]  # how far an entry is above the list's first one
        self.room = np.empty(vectors.size, np.intp), np.empty(vectors.size)  # for the entries of a round
        self.start = 0  # the frontier before the one at which the last query could stop

    def survivors(self, query: np.ndarray, k: int, barred: np.ndarray) -> tuple[np.ndarray, int]:
        """Rows that may be among the k best, and how many list entries were read to know that. No row is looked up on the way.

        All lists are read in rounds, each from the end where it adds most, down to one frontier after another: the entries that add
        so much or more above what the list's entry at the other end adds. An unread entry adds from nothing to the frontier (or to what the list's first entry adds), which
        bounds each row's score from below and above. The bar is the k-th largest lower bound; rows whose upper bound is below it are out, and rows
        not seen at all go the same way, as their upper bound is the sum of the frontiers.

        A query starts at the frontier before the one where the query before it stopped, so most take two rounds. What a row's entries add and
        the number of them are summed as one number where both fit 53 bits.
        """
        n = len(self.vectors)
        use = np.flatnonzero(query)
        open_rows = np.flatnonzero(~barred)
        if not len(use) or not n:
            return open_rows, 0
        weight = query[use].astype(np.float64)
        gain = np.abs(weight)
        most = gain * self.above[use, -1]
        unit = 2.0 ** math.ceil(math.log2(float(most.sum()) + 1))
        one = unit * (len(use) + 1) < 2.0**53
        slack = 1e-12 * float(gain @ self.largest[use])  # rounding of very large sums
        frontiers = np.array([*np.array(FRONTIERS[:-1]) * np.sqrt(np.mean(most**2)), FRONTIERS[-1]])
        up = weight > 0
        far = frontiers[self.start :] / gain[:, None]
        far = np.where(up[:, None], far, self.above[use, -1:] - far)  # entries from it on are read, upwards or downwards
        cuts = np.array([self.above[d].searchsorted(x, "left" if u else "right") for d, x, u in zip(use.tolist(), far, up.tolist(), strict=True)]).T
        offset = (np.where(up, 0.0, most) + unit * one).tolist()
        rows, added = self.room
        seen, count, read = np.zeros(n), np.zeros(n), 0
        low, high = np.zeros(len(use), np.int64), np.full(len(use), n)  # the unread part of each list
        for level, (frontier, cut) in enumerate(zip(frontiers[self.start :].tolist(), cuts, strict=True), self.start):
            a, b = np.where(up, np.minimum(cut, high), low), np.where(up, high, np.maximum(cut, low))
            high, low = np.where(up, a, high), np.where(up, low, b)
            size = b - a
            read += int(size.sum())
            i = 0
            for d, x, y, m, c in zip(use.tolist(), a.tolist(), b.tolist(), weight.tolist(), offset, strict=True):
                if x < y:
                    j = i + y - x
                    rows[i:j] = self.rows[d, x:y]
                    np.multiply(self.above[d, x:y], m, out=added[i:j])
                    added[i:j] += c
                    i = j
            if i:
                both = np.bincount(rows[:i], added[:i], minlength=n)
                number = np.floor(both / unit) if one else np.bincount(rows[:i], minlength=n)
                seen += both - number * (unit * one)
                count += number
            lower = seen[open_rows]
            upper = lower + (np.minimum(frontier, most).sum() - frontier * count[open_rows]) if frontier >= 0 else lower
            bar = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf
            open_rows = open_rows[upper >= bar - slack]
            if len(open_rows) <= max(FEW, k):
                break
        self.start = max(0, level - 1)
        return open_rows, read

    def top(self, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best places but the query's own, equal scores in order of place."""
        rows, _ = self.survivors(query, k, own)
        score = self.vectors[rows] @ query
        best = np.lexsort((rows, -score))[:k]
        return rows[best], score[best]


FOUND = "asked long, row long, score long"


def _search(k: int):
    def run(table: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        sizes = table["vector"].map(len).to_numpy() if len(table) else np.zeros(0, int)
        wanted = queries["sought"].map(len).to_numpy() if len(queries) else np.zeros(0, int)
        for size in np.unique(sizes):
            some = table[sizes == size].sort_values(["last", "place", "row"])
            lists = SortedLists(np.array(some["vector"].tolist(), np.int64).reshape(len(some), size))
            keys = some["row"].to_numpy(np.int64)
            for q, v in queries.loc[wanted == size, ["asked", "sought"]].itertuples(index=False):
                at, score = lists.top(np.asarray(v, np.int64), k, keys == q)
                out += [(q, i, s) for i, s in zip(keys[at].tolist(), score.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["asked", "row", "score"]).astype("int64")

    return lambda table, queries: run(table, queries)


def exact_topk(rows: DataFrame, is_query: Column, k: int = K, shard: int = SHARD, query_chunk: int = QUERIES) -> DataFrame:
    """``rows`` have vec_id and vector (whole numbers); those with ``is_query`` ask. Returns query_id, rank, vec_id, score of each query's k
    best rows but its own by inner product, ties to the smaller vec_id.

    Rows are dealt to shards and every query goes to every shard, ``query_chunk`` at a time; a shard gives its own
    k best, and the best of those are the result. Rows that share an id, or are repeated, are rows of their own: each is a candidate, and asks for itself if it is a query. Rows
    without an id are candidates, after all others of their score. Null vectors take no part, and vectors of different lengths do not meet. Fewer rows than k give all. Empty tables give
    no rows. Scores are 64-bit numbers. Very long vectors are whole lists each, as others are. Other columns are ignored.
    """
    clean = rows.where("vector is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    held = written(clean.withColumn("row", F.monotonically_increasing_id()))
    n = held.agg(F.count("*"), F.count_if("asks")).first()
    shards, chunks = max(1, math.ceil(n[0] / shard)), max(1, math.ceil(n[1] / query_chunk))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    table = held.select("row", "vector", F.col("vec_id").isNull().alias("last"), F.coalesce("vec_id", F.lit(0)).alias("place"), part("row", shards).alias("shard"), every(chunks).alias("chunk"))
    queries = held.where("asks").select(F.col("row").alias("asked"), F.col("vector").alias("sought"), part("row", chunks).alias("chunk"), every(shards).alias("shard"))
    found = table.groupBy("shard", "chunk").cogroup(queries.groupBy("shard", "chunk")).applyInPandas(_search(k), FOUND)
    named = found.join(held.select("row", "vec_id"), "row").join(held.where("asks").select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id")), "asked")
    best = W.partitionBy("asked").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and vector = floor(scale * x) of rows whose components are all finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False))).select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("vector"))


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_topk(rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT row, vec_id, len(v) AS n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (
  SELECT q.row AS asked, q.vec_id AS query_id, r.row, r.vec_id, CAST(sum(q.x * r.x) AS BIGINT) AS score
  FROM c q JOIN c r ON q.i = r.i AND q.n = r.n AND q.row <> r.row WHERE q.vec_id % 50 = 0 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id NULLS LAST, row) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 5
"""
