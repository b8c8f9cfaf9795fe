"""Usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ingest import legacy_new_rows, with_project


def admin_stats(observations: DataFrame, sessions: DataFrame, projects: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of totals; one pass over each table."""
    status = lambda s: F.count_if(F.col("status") == s).alias(f"queue_{s}")
    o = observations.agg(F.count("*").alias("observations"), F.count("embedding").alias("with_embedding"), F.count_if(F.col("embedding").isNull()).alias("without_embedding"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return o.join(one(sessions, "sessions")).join(one(projects, "projects")).join(queue.agg(*map(status, ("pending", "done", "failed"))))


def count_by_type(observations: DataFrame) -> DataFrame:
    return observations.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def count_by_project(observations: DataFrame, projects: DataFrame) -> DataFrame:
    """Counts by project name, from counts by id, so the join sees a row a project."""
    counts = observations.groupBy("project_id").agg(F.count("*").alias("n"))
    return with_project(counts, projects).groupBy("project_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "project_name")


def queue_depth(queue: DataFrame, observations: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("status") == "pending").alias("pending")).join(observations.agg(F.count("*").alias("observations")))


def legacy_new_by_project(legacy: DataFrame, existing: DataFrame) -> DataFrame:
    return legacy_new_rows(legacy, existing).groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project")


def import_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
