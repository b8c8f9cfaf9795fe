"""Filters and state changes of the ingest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.udfs import pattern_ok
from ..schemas import CAPTURED_TOOLS, CHECKED_TOOLS, LISTS, MAX_RETRIES, SKIPPED_TOOLS

LIST_LIMIT = 100


def skip_low_value(df: DataFrame, tool: str = "tool_name") -> DataFrame:
    """Drops calls of tools that teach nothing. A null tool stays."""
    return df.where(~F.coalesce(F.col(tool), F.lit("")).isin(*SKIPPED_TOOLS))


def capture_allowlist(df: DataFrame, tools: tuple[str, ...] = CAPTURED_TOOLS, tool: str = "tool_name") -> DataFrame:
    return df.where(F.col(tool).isin(*tools))


def lesson_checked(df: DataFrame, tool: str = "tool_name") -> DataFrame:
    """Calls of the tools that lessons are held against."""
    return capture_allowlist(df, CHECKED_TOOLS, tool)


def observation_defaults(df: DataFrame) -> DataFrame:
    """Absent title, type and lists get their defaults."""
    filled = {"title": F.coalesce("title", F.lit("Untitled")), "type": F.coalesce("type", F.lit("discovery"))}
    return df.withColumns(filled | {c: F.coalesce(c, F.array().cast("array<string>")) for c in LISTS if c in df.columns})


def list_observations(obs: DataFrame, projects: DataFrame, project: str | None = None, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of observations, newest first, with the project's name and a flag in place of the vector."""
    out = with_project(obs, projects)
    if project is not None:
        out = out.where(F.col("project_name") == project)
    if kind is not None:
        out = out.where(F.col("type") == kind)
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in LISTS if c in out.columns}
    out = out.withColumns(lists | {"has_embedding": F.col("embedding").isNotNull()}).drop("embedding")
    return out.orderBy(F.desc("created_at"), "id").offset(offset).limit(min(limit, LIST_LIMIT))


def validate_observations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that hold the table's constraints, and the others."""
    good = F.coalesce(X.known_type() & F.col("title").isNotNull() & F.col("raw_text").isNotNull(), F.lit(False))
    return df.where(good), df.where(~good)


def validate_trigger_pattern(df: DataFrame, pattern: str = "trigger_pattern") -> DataFrame:
    """Adds pattern_ok: no pattern, or one of at most 500 characters that compiles."""
    return df.withColumn("pattern_ok", X.short_pattern(pattern) & pattern_ok(pattern))


def get_observation(obs: DataFrame, projects: DataFrame, key: int) -> DataFrame:
    return with_project(obs.where(F.col("id") == key), projects)


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "created_at") -> DataFrame:
    """Rows from start to end, both inclusive."""
    if start is not None:
        df = df.where(F.col(column) >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.where(F.col(column) <= F.to_timestamp(F.lit(end)))
    return df


def pending_embedding(df: DataFrame, only_missing: bool = True, after_id: int | None = None, n: int | None = None) -> DataFrame:
    """Rows to embed: those without a vector, or all. ``after_id`` and ``n`` give one page by id."""
    if only_missing:
        df = df.where(F.col("embedding").isNull())
    if after_id is not None:
        df = df.where(F.col("id") > after_id)
    return df.orderBy("id").limit(n) if n is not None else df


def advance_queue(queue: DataFrame, outcomes: DataFrame, at: str, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The queue after a batch. ``outcomes`` has id and outcome: ok ends as done, skip as skipped, error counts a retry and is pending
    again, or failed once ``max_retries`` were counted before.
    """
    out = queue.join(outcomes.select("id", "outcome"), "id", "left")
    failed = F.col("outcome") == "error"
    status = F.when(F.col("outcome") == "ok", "done").when(F.col("outcome") == "skip", "skipped").when(failed & (F.col("retry_count") >= max_retries), "failed").when(failed, "pending").otherwise(F.col("status"))
    when = F.when(F.col("outcome").isNotNull(), F.to_timestamp(F.lit(at))).otherwise(F.col("processed_at"))
    return out.withColumns({"status": status, "retry_count": F.col("retry_count") + F.coalesce(failed.cast("int"), F.lit(0)), "processed_at": when}).select(*queue.columns)


def with_project(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds project_name; rows without a project go."""
    return df.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")


def with_optional_project(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds project_name; rows without a project stay, with null."""
    return df.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id", "left")


def get_observations(obs: DataFrame, ids: DataFrame) -> DataFrame:
    """Full rows of the wanted ids, oldest first. Missing ids are ignored, repeated ones count once."""
    return obs.join(ids.select("id"), "id", "left_semi").orderBy("created_at", "id")


def legacy_new_rows(legacy: DataFrame, existing: DataFrame) -> DataFrame:
    """Legacy rows whose title, time to the second and project are not there yet; nulls equal nulls."""
    second = lambda: F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    a = legacy.withColumn("_at", second()).alias("a")
    b = existing.select(F.col("title").alias("_title"), second().alias("_second"), F.col("project").alias("_project")).alias("b")
    same = F.col("a.title").eqNullSafe(F.col("b._title")) & F.col("a._at").eqNullSafe(F.col("b._second")) & F.col("a.project").eqNullSafe(F.col("b._project"))
    return a.join(b, same, "left_anti").drop("_at")


def resolve_session_project(queue: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds session_key and project_id by the session's text id; outcome is error where there is no such session."""
    keys = sessions.select("session_id", F.col("id").alias("session_key"), "project_id")
    return queue.join(keys, "session_id", "left").withColumn("outcome", F.when(F.col("session_key").isNull(), "error"))
