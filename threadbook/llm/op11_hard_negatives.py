"""Hard-negative mining: inner products of several candidates at once, packed into separate fields of one wide integer a component."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

POSITIVES = NEGATIVES = 5
#: A negative has at least so many hundredths of its positive's score, and not more than all of it.
LEAST = 80
SCALE = 256
#: Rows that one task packs, anchors that meet them, and scores that it holds at once.
SHARD, ANCHORS, BLOCK = 16_384, 4_096, 1 << 21
#: Fields of an integer of any width, for components that are too large for two fields in 63 bits.
WIDE_FIELDS = 16
_LAST = (1 << 63) - 1


class Packed:
    """Candidates (rows of whole numbers) in packed form, for anchors whose components lie between two bounds.

    Components are biased so that none is negative, for candidates and anchors alike. A score of biased components is below 2**width, so the components of several candidates
    stand ``width`` bits apart in one integer, and a product with an anchor's component is a product with each of them: sums never reach the next field.
    """

    def __init__(self, vectors: np.ndarray, anchor_low: int, anchor_high: int):
        self.n, d = vectors.shape
        low, high = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
        self.low, self.anchor_low = low, anchor_low
        self.width = max(1, (d * (high - low) * (anchor_high - anchor_low)).bit_length())
        self.kind = np.int64 if 2 * self.width <= 63 else object
        self.fields = 63 // self.width if self.kind is np.int64 else WIDE_FIELDS
        biased = np.zeros((-(-self.n // self.fields) * self.fields, d), self.kind)
        biased[: self.n] = vectors.astype(self.kind) - low
        self.packed = np.zeros((d, len(biased) // self.fields), self.kind)
        for j in range(self.fields):
            self.packed += biased[j :: self.fields].T << (self.width * j)
        self.extra = anchor_low * biased[: self.n].sum(axis=1) + d * low * anchor_low

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of each anchor with each candidate. One that is beyond 64 bits is the nearest that is not."""
        up = anchors.astype(self.kind) - self.anchor_low
        wide = up @ self.packed
        mask = (1 << self.width) - 1
        out = np.empty((len(anchors), wide.shape[1] * self.fields), self.kind)
        for j in range(self.fields):
            out[:, j :: self.fields] = (wide >> (self.width * j)) & mask
        out = out[:, : self.n] + self.low * up.sum(axis=1)[:, None] + self.extra
        return out if self.kind is np.int64 else np.clip(out, -_LAST - 1, _LAST).astype(np.int64)


def best_of(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores among the allowed ones, equal ones in order of place."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        some = scores[at]
        at = at[some >= np.partition(some, len(at) - k)[len(at) - k]]
    return at[np.lexsort((at, ~scores[at]))[:k]]  # ~x falls as x rises, with no overflow


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), size)


def _met(rows: pa.Table, anchors: pa.Table):
    """For rows and anchors with vectors of the same length: the rows by id (nulls last), and blocks of anchors with their scores."""
    sizes, wanted = (pc.list_value_length(c).to_numpy() for c in (rows.column("vector"), anchors.column("asked")))
    for d in np.intersect1d(sizes, wanted).tolist():
        here = rows.filter(pa.array(sizes == d)).sort_by([("vec_id", "ascending"), ("row", "ascending")])
        asked = anchors.filter(pa.array(wanted == d))
        a = _matrix(asked.column("asked"), d)
        packed = Packed(_matrix(here.column("vector"), d), int(a.min(initial=0)), int(a.max(initial=0)))
        own, label = here.column("row").to_numpy(), here.column("label").to_numpy()
        step = max(1, BLOCK // len(own))
        for i in range(0, len(a), step):
            yield here, own, label, asked.slice(i, step), packed.scores(a[i : i + step])


def _table(schema: dict, here: list) -> pa.Table:
    empty = pa.table({n: pa.array([], t) for n, t in schema.items()})
    return pa.concat_tables([empty, *here])


_FOUND = {"anchor": pa.int64(), "n": pa.int32(), "row": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
FOUND = "anchor long, n int, row long, vec_id long, score long"


def _picked(here: pa.Table, anchor: int, n: int, at: np.ndarray, scores: np.ndarray) -> pa.Table:
    ids = here.column("vec_id").take(pa.array(at))
    return pa.table([pa.array(np.full(len(at), anchor)), pa.array(np.full(len(at), n, np.int32)), here.column("row").take(pa.array(at)), ids, pa.array(scores[at])], list(_FOUND))


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            for here, own, label, some, scores in _met(rows, anchors):
                for anchor, kind, s in zip(some.column("anchor").to_pylist(), some.column("kind").to_pylist(), scores, strict=True):
                    out.append(_picked(here, anchor, 0, best_of(s, (label == kind) & (own != anchor), k), s))
        return _table(_FOUND, out)

    return run


def _negatives(k: int, least: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            for here, _, label, some, scores in _met(rows, anchors):
                columns = (some.column(c).to_pylist() for c in ("anchor", "kind", "positives"))
                for anchor, kind, positives, s in zip(*columns, scores, strict=True):
                    other = label != kind
                    for p in positives:
                        floor = -(-least * p["score"] // 100)  # the least whole number of that share
                        if floor <= p["score"]:
                            out.append(_picked(here, anchor, p["n"], best_of(s, other & (s >= floor) & (s <= p["score"]), k), s))
        return _table(_FOUND, out)

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, shard: int = SHARD, chunk: int = ANCHORS) -> DataFrame:
    """``rows`` have vec_id, label and vector (whole numbers). For each anchor and each of its ``positives`` best rows of the same label: the ``negatives`` best rows of other
    labels whose score is at most the positive's and at least ``least`` hundredths of it: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows go to shards and anchors to chunks; each shard meets each chunk once for positives and, with their scores known, once for negatives, and sends only its best. A label decides
    nothing about where a row goes. Rows without label or vector, or with a null component, take no part. Repeated rows, and rows that share an id, are rows of their own: only the anchor's own
    row is not its positive. A row without an id is after all others of its score, and vectors of different lengths do not meet. Fewer rows than asked for give all; a positive with a negative score has
    no negatives. Empty tables give no rows, other columns are ignored. Very long vectors are whole; scores beyond 64 bits count as the nearest number of 64 bits.
    """
    clean = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~F.exists("vector", lambda x: x.isNull()))
    clean = clean.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    held = written(clean.withColumn("row", F.monotonically_increasing_id()))
    n = held.agg(F.count("*"), F.count_if("is_anchor")).first()
    shards, chunks = max(1, math.ceil(n[0] / shard)), max(1, math.ceil(n[1] / chunk))
    part = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    anchors = held.where("is_anchor").select(F.col("row").alias("anchor"), F.col("label").alias("kind"), F.col("vector").alias("asked"))
    candidates = held.select("row", "vec_id", "label", "vector", part("row", shards).alias("shard"), every(chunks).alias("chunk")).groupBy("shard", "chunk")
    met = lambda asked: candidates.cogroup(asked.withColumn("chunk", part("anchor", chunks)).withColumn("shard", every(shards)).groupBy("shard", "chunk"))
    best = lambda *keys: W.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    first = lambda found, k, *keys: found.withColumn("rank", F.row_number().over(best(*keys))).where(F.col("rank") <= k)
    near = written(first(met(anchors).applyInArrow(_positives(positives), FOUND), positives, "anchor").select("anchor", F.col("rank").alias("n"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    bars = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("n", F.col("positive_score").alias("score")))).alias("positives"))  # ``positives`` of them
    hard = first(met(anchors.join(bars, "anchor")).applyInArrow(_negatives(negatives, least), FOUND), negatives, "anchor", "n")
    named = held.where("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = hard.select("anchor", "n", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["anchor", "n"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and vector = floor(scale * x) of rows with a label whose components are all finite numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return good.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("vector"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = labelled_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT row, vec_id, label, len(v) AS d, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM r),
s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label AS kind, b.row, b.vec_id, b.label, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM c a JOIN c b ON a.i = b.i AND a.d = b.d AND a.row <> b.row WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (SELECT anchor, anchor_id, kind, row, vec_id AS positive_id, score AS positive_score FROM s WHERE label = kind QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND s.label <> p.kind AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score QUALIFY rank <= 5
"""
