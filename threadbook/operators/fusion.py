"""Fusion of ranked lists and the boost of recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RECENCY_DAYS, RRF_K


def rrf_fuse(*lists: DataFrame, k0: int = RRF_K) -> DataFrame:
    """Lists (query_id, id, rank from 0) in order of precedence, as query_id, id, rrf, src, src_rank. rrf sums 1 / (k0 + rank); src and src_rank
    say where a row stands first, which orders equal scores.
    """
    parts = [x.select("query_id", "id", "rank", F.lit(i).alias("src")) for i, x in enumerate(lists)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    first = F.min(F.struct("src", "rank"))
    return union.groupBy("query_id", "id").agg(F.sum(1.0 / (k0 + F.col("rank"))).alias("rrf"), first.alias("first")).select("query_id", "id", "rrf", F.col("first.src").alias("src"), F.col("first.rank").alias("src_rank"))


def recency(created_at: str | Column, now: str | Column, days: float = RECENCY_DAYS) -> Column:
    """1 + exp(-age / days), the age at least 0; 1 without a time."""
    age = F.greatest((F.unix_timestamp(F.to_timestamp(F.lit(now) if isinstance(now, str) else now)) - F.unix_timestamp(created_at)) / 86400.0, F.lit(0.0))
    return F.when(F.col(created_at).isNull() if isinstance(created_at, str) else created_at.isNull(), F.lit(1.0)).otherwise(1.0 + F.exp(-age / days))


def recency_boost(df: DataFrame, now: str, score: str = "rrf", days: float = RECENCY_DAYS) -> DataFrame:
    return df.withColumn(score, F.col(score) * recency("created_at", now, days))
