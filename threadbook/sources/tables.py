"""Readers and writers of the memory tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as X
from ..schemas import LISTS, TABLES, TOOL_CALL


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables below ``root``, by their declared schemas."""
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in TABLES.items()}


def read_tool_calls(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Tool-call payloads, one JSON object a line; tool_input stays JSON text."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(TOOL_CALL).json(path)


def replay_spool(spark: SparkSession, path: str, delay: str = "1 hour", streaming: bool = True) -> DataFrame:
    """Payloads that were put aside when delivery failed, each once: delivery is at least once, so equal payloads are one.
    ``delay`` bounds how long a stream remembers a payload.
    """
    calls = read_tool_calls(spark, path, streaming)
    keyed = calls.withColumn("payload_hash", payload_hash(*calls.columns))
    if not streaming:
        return keyed.dropDuplicates(["payload_hash"])
    return keyed.withColumn("received_at", F.current_timestamp()).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["payload_hash"])


def payload_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def read_legacy_observations(df: DataFrame) -> DataFrame:
    """Rows of the older store in the present form: JSON lists parsed (bad or empty: none), types mapped, times in UTC, and
    raw_text filled from title, subtitle and narrative, without facts, where the old row has no text.
    """
    lists = [F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")).alias(c) for c in LISTS]
    text = F.coalesce(X.filled("text"), F.concat_ws("\n", X.filled("title"), X.filled("subtitle"), X.filled("narrative")))
    return df.select("id", "title", "subtitle", X.normalize_type("type").alias("type"), "narrative", *lists, text.alias("raw_text"), "project", "memory_session_id", X.parse_legacy_ts("created_at").alias("created_at"))


def legacy_sessions(df: DataFrame) -> DataFrame:
    """One row for each legacy session: the project it was first seen in, and its smallest time as text."""
    pairs = df.groupBy("memory_session_id", "project").agg(F.min("created_at").alias("started_at"))
    first = W.partitionBy("memory_session_id").orderBy(F.col("started_at").asc_nulls_last(), F.col("project").asc_nulls_last())
    return pairs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def snapshot_tables(tables: dict[str, DataFrame], root: str, at: datetime, skip: tuple[str, ...] = ("schema_migrations",)) -> DataFrame:
    """Copies every table to ``<name>_bak_YYYYmmdd_HHMM`` below ``root``, replacing a copy of that name, and reports row
    counts. Earlier copies and the tables in ``skip`` are left out.
    """
    counts = []
    for name, df in sorted(tables.items()):
        if name in skip or "_bak_" in name:
            continue
        target = f"{name}_bak_{at:%Y%m%d_%H%M}"
        df.write.mode("overwrite").parquet(f"{root}/{target}")
        copy = df.sparkSession.read.schema(df.schema).parquet(f"{root}/{target}")
        counts.append(copy.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(target).alias("copy"), "rows"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def append_observations(df: DataFrame, path: str) -> None:
    """Adds finished observations to a table that is partitioned by project, rows in each file by time."""
    df.repartition("project_id", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("project_id", "created_at").write.mode("append").partitionBy("project_id").parquet(path)


def search_json(df: DataFrame, key: str = "query_id") -> DataFrame:
    """Ranked results of each query as one JSON array; null fields are kept."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*[c for c in df.columns if c not in (key, "rank")]).alias("row")))), lambda x: x["row"])
    return df.groupBy(key).agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("results"))
