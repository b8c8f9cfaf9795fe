"""Exact and approximate nearest neighbours by cosine similarity."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as X
from ..scratch import written

#: Queries up to which each task takes all of them in one expression; more go in blocks by matrix product.
FEW_QUERIES = 64
SHARD, CHUNK = 16_384, 1_024
#: Queries that a task scores at once.
ASKED = 128
#: Digits of a similarity that decide ranks, the id beyond.
DIGITS = 6
SCORED = "query_id long, id long, score double"


def _vectors(df: DataFrame, key: str, vector: str, *keep: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), X.unit_vector(vector).alias("unit"), *keep).where("unit is not null")


def _matrix(units: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    units = units.combine_chunks()
    flat, n = units.flatten().to_numpy(zero_copy_only=False), len(units)
    if n and (np.diff(units.offsets.to_numpy()) * n != len(flat)).any():
        raise ValueError("vectors that are compared must have the same length")
    return flat.reshape(n, -1)


def _best(score: np.ndarray, ids: np.ndarray, k: int, slack: float = 0.0, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of the k highest finite scores of each row, ties to the smaller id. With ``digits`` scores are rounded before they are compared; ``slack`` is what rounding may move two of them."""
    n = score.shape[1]
    if n > k:
        least = np.partition(score, n - k, axis=1)[:, n - k, None] - slack
        row, at = np.nonzero((score >= least) & (score > -np.inf))
    else:
        row, at = np.nonzero(score > -np.inf)
    value, held = score[row, at], ids[at]
    if digits is not None:
        value = np.round(value, digits) + 0.0
    order = np.lexsort((held, -value, row))
    row, held, value = row[order], held[order], value[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], held[kept], value[kept]


def _by_blocks(k: int):
    def run(corpus: pa.Table, queries: pa.Table) -> pa.Table:
        found = [([], [], [])]
        if len(corpus) and len(queries):
            a, b = _matrix(queries["unit"]), _matrix(corpus["unit"])
            asked, ids = queries["query_id"].to_numpy(), corpus["id"].to_numpy()
            for i in range(0, len(a), ASKED):
                row, held, value = _best(a[i : i + ASKED] @ b.T, ids, k, 2 * 10.0**-DIGITS, DIGITS)
                found.append((asked[i + row], held, value))
        query_id, held, value = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "id": pa.array(held, pa.int64()), "score": pa.array(value, pa.float64())})

    return lambda corpus, queries: run(corpus, queries)


def _shards(spark: SparkSession, rows: int, shard: int, chunks: int) -> int:
    """Parts of a corpus of ``rows``: as many as bound what a task holds, or as give every core work. Every part meets all queries, so more would cost more."""
    return max(1, math.ceil(rows / shard), math.ceil(2 * spark.sparkContext.defaultParallelism / chunks))


def _each(n: int) -> Column:
    """A row for each of 0..n-1."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _deal(*key_and_n) -> Column:
    *key, n = key_and_n
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, path: str | None = None, by: str | None = None) -> DataFrame:
    """The k most similar rows of ``corpus`` (id, embedding) for each query (query_id, vector): query_id, id, score, rank from 0.

    Only ids and vectors move. With few queries (path "sql") the corpus stays where it is; with many, or by path "matmul", shards
    of the corpus meet blocks of queries, and each pair keeps k rows a query. ``by`` is a column of both sides that must be
    equal, such as a project. Filters belong on the corpus, so that they are applied before the cut.
    """
    spark = corpus.sparkSession
    keep = [by] if by else []
    q = _vectors(queries, "query_id", "vector", *keep)
    c = _vectors(corpus, "id", "embedding", *keep)
    if path is None:
        path = "sql"
    if path == "sql" and q.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES:
        q = q.withColumnRenamed("unit", "q_unit")
        pairs = c.join(F.broadcast(q), by) if by else c.join(F.broadcast(q))  # FEW_QUERIES vectors at most
        scored = pairs.select("query_id", "id", F.round(X.dot("q_unit", "unit"), DIGITS).alias("score"))
    else:
        chunks = max(1, math.ceil(q.count() / CHUNK))
        shards = _shards(spark, c.count(), SHARD, chunks)
        left = c.select("id", "unit", *keep, _deal("id", shards).alias("shard"), _each(chunks).alias("chunk"))
        right = q.select("query_id", "unit", *keep, _deal("query_id", chunks).alias("chunk"), _each(shards).alias("shard"))
        keys = [*keep, "shard", "chunk"]
        scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_by_blocks(k), SCORED)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "score", (F.col("rank") - 1).cast("int").alias("rank"))


# ---------------------------------------------------------------- approximate search by cells

#: Vectors that an index is fitted on, at most: those with the smallest hashes of their ids. Every row is indexed.
SAMPLE = 16_384
#: Rows that a cell should hold, cells of the first level and their parts at most, and rows of one cell that are stored together.
CELL_ROWS, FIRST, PARTS, BLOCK_ROWS = 256, 1_024, 1_024, 4_096
#: Numbers of a vector that share one byte of its code, and values of that byte.
PIECE, WORDS = 4, 256
#: The share of true neighbours within the sample whose cells a search looks into, and rows a result whose whole vectors it compares.
REACH, WHOLE = 0.97, 20
#: Coded rows and queries that meet in one task, and queries that it scores at once.
CODED, CODED_CHUNK, CODED_ASKED = 65_536, 512, 32
BLOCKS = "cell long, block int, rows array<struct<id: long, code: binary>>"


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(x), np.int64), 0.5 * (centres**2).sum(1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmax(x[i : i + 4096] @ centres.T - half, 1)
    return out


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k centres of a bounded sample by Lloyd's rounds; an empty one stays where it is."""
    r = np.random.default_rng(seed)
    out = x[np.sort(r.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        own = _nearest(x, out)
        n = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


@dataclass(frozen=True)
class AnnModel:
    """What an index is made by; its size does not depend on the corpus. A cell is a centre and, where cells would be too large, one of the parts that all centres
    share: the vectors nearest to centre + part. What is left of a vector is coded by a byte for each ``PIECE`` numbers. ``probes`` cells are looked into.
    """

    first: np.ndarray
    parts: np.ndarray
    words: list[np.ndarray]
    probes: int

    @property
    def dims(self) -> int:
        return self.first.shape[1]

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        a = _nearest(x, self.first)
        return a * len(self.parts) + (_nearest(x - self.first[a], self.parts) if len(self.parts) > 1 else 0)

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.first[cell // len(self.parts)] + self.parts[cell % len(self.parts)]

    def codes_of(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = x - self.centre(cell)
        return np.stack([_nearest(left[:, i * PIECE : (i + 1) * PIECE], w) for i, w in enumerate(self.words)], 1).astype(np.uint8)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The cells whose centres are most similar to the vector."""
        score = (self.first @ q)[:, None] + (self.parts @ q)[None, :]
        return np.argsort(-score.ravel(), kind="stable")[:probes]

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each piece of the code the similarity of every value with each vector. No matrix products: equal codes have equal scores wherever they are."""
        pieces = [q[:, i * PIECE : (i + 1) * PIECE] for i in range(len(self.words))]
        return [sum(p[:, j, None] * w[None, :, j] for j in range(p.shape[1])) for p, w in zip(pieces, self.words, strict=True)]

    def scores(self, q: np.ndarray, tables: list[np.ndarray], cell: int, codes: np.ndarray) -> np.ndarray:
        """Similarities of vectors with the coded rows of a cell; ``tables`` are those of the vectors."""
        out = np.repeat((q * self.centre(np.array([cell]))).sum(1)[:, None], len(codes), 1)
        for i, t in enumerate(tables):
            out += t[:, codes[:, i]]
        return out


def fit_ann(corpus: DataFrame, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, first: int = FIRST, seed: int = 7, dims: int | None = None) -> AnnModel | None:
    """An index model of ``corpus`` (id, embedding), or None if it has no vectors. Fitted on ``sample`` vectors at most, of ``dims`` numbers (those of the
    first vector), by k-means. The number of probes is what finds ``REACH`` of the nearest neighbours within the sample.
    """
    held = _vectors(corpus, "id", "embedding")
    if dims is None:
        one = held.select(F.size("unit")).first()
        if one is None:
            return None
        dims = one[0]
    held = held.where(F.size("unit") == dims)
    n = held.count()
    if not n:
        return None
    some = held.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    cells = max(1, min(first, math.ceil(math.sqrt(n)), math.ceil(n / 8)))
    ready = some.select("unit", array_to_vector("unit").alias("features")).persist()
    x = np.array([r.unit for r in ready.select("unit").toLocalIterator()], np.float64).reshape(-1, dims)
    k = min(cells, max(1, len(np.unique(x, axis=0)) - 1))
    centres = KMeans(k=k, seed=seed, maxIter=8, initMode="random").fit(ready).clusterCenters() if k > 1 else [x.mean(0)]
    ready.unpersist()
    centres = np.array(centres, np.float64)
    parts = min(PARTS, math.ceil(n / (len(centres) * cell_rows * 4)))
    left = x - centres[_nearest(x, centres)]
    shared = _centres(left, min(parts, len(x)), seed) if parts > 1 else np.zeros((1, dims))
    model = AnnModel(centres, shared, [np.zeros((1, min(PIECE, dims - i))) for i in range(0, dims, PIECE)], 1)
    own = model.cells_of(x)
    left = x - model.centre(own)
    words = [_centres(left[:, i : i + PIECE], min(WORDS, len(x)), seed + i) for i in range(0, dims, PIECE)]
    return AnnModel(centres, shared, words, _probes(model, x, own))


def _probes(model: AnnModel, x: np.ndarray, own: np.ndarray, asked: int = 256, k: int = 10) -> int:
    """How many cells have to be looked into, so that ``REACH`` of the k nearest of some vectors of the sample are there."""
    q = x[:: max(1, len(x) // asked)]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : k + 1]
    cells = len(model.first) * len(model.parts)
    needed = []
    for v, ids in zip(q, near, strict=True):
        place = np.empty(cells, np.int64)
        place[model.probed(v, cells)] = np.arange(cells)
        needed.append(place[own[ids]])
    return int(np.quantile(np.concatenate(needed), REACH, method="higher")) + 1


def build_ann(corpus: DataFrame, model: AnnModel) -> DataFrame:
    """The index of ``corpus`` (id, embedding) by a model: blocks of coded rows of a cell, for every row with a vector of its length. A cell of many rows, such as copies of
    one vector, is many blocks.
    """

    def coded(s: pd.Series) -> pd.DataFrame:
        x = np.stack(s.to_list()) if len(s) else np.zeros((0, model.dims))
        cell = model.cells_of(x)
        return pd.DataFrame({"cell": cell, "code": [c.tobytes() for c in model.codes_of(x, cell)]})

    rows = _vectors(corpus, "id", "embedding").where(F.size("unit") == model.dims)
    rows = rows.select("id", F.pandas_udf(coded, "cell long, code binary")("unit").alias("c")).select("id", "c.cell", "c.code")
    rows = written(rows)
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("blocks"))
    dealt = rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return dealt.groupBy("cell", "block").agg(F.array_sort(F.collect_list(F.struct("id", "code"))).alias("rows"))


def write_ann(index: DataFrame, path: str, mode: str = "overwrite", model: AnnModel | None = None) -> None:
    """Stores an index in files sorted by cell, so that a search reads the row groups of its cells; ``mode`` append adds blocks. The model goes with it."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.repartitionByRange(n, "cell", "block").sortWithinPartitions("cell", "block").write.mode(mode).parquet(f"{path}/blocks")
    if model is not None:
        flat = lambda m: [float(v) for v in m.ravel()]
        row = (model.dims, model.probes, flat(model.first), flat(model.parts), [flat(w) for w in model.words])
        index.sparkSession.createDataFrame([row], "dims int, probes int, first array<double>, parts array<double>, words array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def read_ann(spark: SparkSession, path: str) -> tuple[AnnModel, DataFrame]:
    """A stored model and its index."""
    r = spark.read.parquet(f"{path}/model").first()
    words = [np.array(w).reshape(-1, min(PIECE, r.dims - i * PIECE)) for i, w in enumerate(r.words)]
    return AnnModel(np.array(r.first).reshape(-1, r.dims), np.array(r.parts).reshape(-1, r.dims), words, r.probes), spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def _coded_blocks(k: int, model: AnnModel):
    """The k best rows by codes of each query, among the blocks of a shard that it asks for."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = [([], [], [])]
        if len(index) and len(queries):
            rows = index["rows"].combine_chunks()
            ends, flat = rows.offsets.to_numpy(), rows.values
            ids = flat.field("id").to_numpy()
            codes = np.frombuffer(b"".join(flat.field("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            cell, number = index["cell"].to_numpy(), {}
            blocks = list(zip(cell.tolist(), index["block"].to_pylist(), strict=True))
            for i, x in enumerate(blocks):  # what was appended may have blocks of the same name
                number.setdefault(x, []).append(i)
            units, asked = _matrix(queries["unit"]), queries["query_id"].to_numpy()
            looked = np.zeros((len(units), len(blocks)), bool)
            for i, x in enumerate(queries["asked"].to_pylist()):
                looked[i, [n for a in x for n in number.get((a["cell"], a["block"]), ())]] = True
            for i in range(0, len(units), CODED_ASKED):
                q, some = units[i : i + CODED_ASKED], looked[i : i + CODED_ASKED]
                tables, score = model.tables(q), np.full((len(q), len(ids)), -np.inf)
                for n in np.flatnonzero(some.any(0)):
                    own = np.flatnonzero(some[:, n])
                    score[own, ends[n] : ends[n + 1]] = model.scores(q[own], [t[own] for t in tables], cell[n], codes[ends[n] : ends[n + 1]])
                row, held, value = _best(score, ids, k)
                found.append((asked[i + row], held, value))
        query_id, held, value = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": pa.array(query_id, pa.int64()), "id": pa.array(held, pa.int64()), "score": pa.array(value, pa.float64())})

    return lambda index, queries: run(index, queries)


def _looked_into(queries: DataFrame, model: AnnModel, index: DataFrame, probes: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The queries' vectors, the cells that each looks into (query_id, cell, last, n), and the size of all cells."""

    def asked(s: pd.Series) -> pd.Series:
        return pd.Series([model.probed(np.asarray(q), probes or model.probes) for q in s])

    q = _vectors(queries, "query_id", "vector").where(F.size("unit") == model.dims)
    held = index.groupBy("cell").agg(F.max("block").alias("last"), F.sum(F.size("rows")).alias("n"))  # a cell's blocks are many keys
    return q, q.select("query_id", F.explode(F.pandas_udf(asked, "array<long>")("unit")).alias("cell")).join(held, "cell"), held


def _candidates(queries: DataFrame, k: int, model: AnnModel, index: DataFrame, probes: int | None, whole: int) -> DataFrame:
    """query_id, id of the ``whole`` * k rows whose codes score highest. Shards of blocks meet chunks of queries, and each pair keeps as many rows a query."""
    q, cells, held = _looked_into(queries, model, index, probes)
    chunks = max(1, math.ceil(q.count() / CODED_CHUNK))
    shards = _shards(index.sparkSession, held.agg(F.sum("n")).first()[0] or 0, CODED, chunks)
    wanted = cells.withColumn("block", F.explode(F.sequence(F.lit(0), "last"))).groupBy("query_id", _deal("cell", "block", shards).alias("shard"))
    wanted = wanted.agg(F.collect_list(F.struct("cell", "block")).alias("asked"))
    right = q.join(wanted, "query_id").select("query_id", "unit", "asked", "shard", _deal("query_id", chunks).alias("chunk"))
    left = index.select("cell", "block", "rows", _deal("cell", "block", shards).alias("shard"), _each(chunks).alias("chunk"))
    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(_coded_blocks(whole * k, model), SCORED)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= whole * k).select("query_id", "id")


def ann_candidates(queries: DataFrame, k: int, model: AnnModel, index: DataFrame, probes: int | None = None, whole: int = WHOLE) -> DataFrame:
    """query_id, id, seen: for each query the ``whole`` * k rows whose codes score highest in the cells that it looks into; ``seen`` counts the rows of all those cells."""
    seen = _looked_into(queries, model, index, probes)[1].groupBy("query_id").agg(F.sum("n").alias("seen"))
    return _candidates(queries, k, model, index, probes, whole).join(seen, "query_id").select("query_id", "id", "seen")


def ann_topk(queries: DataFrame, corpus: DataFrame, k: int, model: AnnModel | None = None, index: DataFrame | None = None, probes: int | None = None, whole: int = WHOLE) -> DataFrame:
    """About the k most similar rows: shape as of vector_topk. A query looks into the cells whose centres are nearest to it, scores their rows by codes, and compares the
    whole vectors of the best ``whole`` * k. A search costs cells and codes: rows of other cells are not touched.

    ``model`` and ``index`` are those of ``fit_ann`` and ``build_ann`` (or ``read_ann``), else both are made here. How many cells are looked into is found when a model is fitted: few where vectors
    lie in clusters, most of them where they have no structure at all. Tests measure a recall of 0.9 and more on either.
    """
    model = model or fit_ann(corpus)
    if model is None:
        return vector_topk(queries, corpus, k, "matmul")
    index = written(build_ann(corpus, model)) if index is None else index
    pairs = _candidates(queries, k, model, index, probes, whole)
    q = _vectors(queries, "query_id", "vector").withColumnRenamed("unit", "q_unit")
    scored = pairs.join(_vectors(corpus, "id", "embedding"), "id").join(q, "query_id")
    scored = scored.select("query_id", "id", F.round(X.dot("q_unit", "unit"), DIGITS).alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "score", (F.col("rank") - 1).cast("int").alias("rank"))
