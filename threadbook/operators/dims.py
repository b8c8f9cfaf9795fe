"""Maintenance of small tables as functions from table to table: get-or-create, updates, ids, re-embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.udfs import embed
from ..schemas import SESSION_STATUS
from ..scratch import written
from .ingest import observation_defaults, validate_observations, validate_trigger_pattern


def assign_ids(df: DataFrame, order: list[str], base: int = 0, name: str = "id") -> DataFrame:
    """Dense ids from ``base`` + 1 in the given order, without sorting all rows in one task: rows are dealt to ranges, written, and
    numbered within their range above the sizes of the ranges before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    numbered = rows.withColumn("_place", place).join(F.broadcast(starts), "_range")  # a row a range
    return numbered.withColumn(name, (F.lit(base) + F.col("_start") + F.col("_place")).cast("long")).drop("_range", "_place", "_start")


def _top(df: DataFrame, column: str = "id") -> int:
    return df.agg(F.max(column)).first()[0] or 0


def ensure_projects(projects: DataFrame, names: DataFrame) -> DataFrame:
    """The projects and one new row for each name that is missing. ``names`` has name and may have full_path; a project that is there keeps its own."""
    path = F.max("full_path") if "full_path" in names.columns else F.lit(None).cast("string")
    new = names.where("name is not null").groupBy("name").agg(path.alias("full_path")).join(projects, "name", "left_anti")
    return projects.unionByName(assign_ids(new, ["name"], _top(projects)), allowMissingColumns=True)


def ensure_sessions(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """The sessions and one new row for each session_id that is missing, from its first event (session_id, project_id, agent_type, created_at)."""
    first = events.groupBy("session_id").agg(F.min_by(F.struct("project_id", "agent_type"), F.struct("created_at", F.coalesce("project_id", F.lit(-1)))).alias("e"), F.min("created_at").alias("started_at"))
    new = first.join(sessions, "session_id", "left_anti").select("session_id", "e.project_id", "e.agent_type", F.lit("active").alias("status"), "started_at")
    return sessions.unionByName(assign_ids(new, ["started_at", "session_id"], _top(sessions)), allowMissingColumns=True)


def create_sessions(sessions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows for requests whose session_id is free, and the requests that conflict."""
    known = sessions.select("session_id")
    new = assign_ids(requests.join(known, "session_id", "left_anti"), ["session_id"], _top(sessions))
    return new, requests.join(known, "session_id", "left_semi")


def update_sessions(sessions: DataFrame, patches: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """The sessions with non-empty status and summary set; a status of completed sets completed_at. Also the patches that could
    not be applied, with reason: unknown session, or no field.
    """
    p = patches.select("session_id", X.filled("status").alias("_status"), X.filled("summary").alias("_summary"))
    out = sessions.join(p, "session_id", "left")
    ended = F.when(F.col("_status") == SESSION_STATUS[1], F.to_timestamp(F.lit(at))).otherwise(F.col("completed_at"))
    new = out.withColumns({"completed_at": ended, "status": F.coalesce("_status", "status"), "summary": F.coalesce("_summary", "summary")}).select(*sessions.columns)
    known = p.join(sessions.select("session_id", F.lit(True).alias("_known")), "session_id", "left")
    reason = F.when(F.col("_known").isNull(), "not found").when(F.col("_status").isNull() & F.col("_summary").isNull(), "no fields")
    return new, known.select("session_id", reason.alias("reason")).where("reason is not null")


def update_lessons(lessons: DataFrame, patches: DataFrame, load=None) -> DataFrame:
    """The lessons with each non-null field set. A new title or rule rebuilds raw_text (an empty one keeps the old words there) and the vector."""
    fields = ("title", "rule", "severity", "trigger_tool", "trigger_pattern", "active")
    p = patches.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    out = lessons.join(p, "id", "left")
    changed = F.col("_title").isNotNull() | F.col("_rule").isNotNull()
    words = lambda c: F.coalesce(X.filled(f"_{c}"), F.col(c))
    text = F.when(changed, F.concat_ws("\n", words("title"), words("rule"))).otherwise(F.col("raw_text"))
    out = out.withColumn("_changed", changed).withColumn("raw_text", text).withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    done = out.where(~F.col("_changed")).select(*lessons.columns)
    again = embed(out.where("_changed"), "raw_text", "embedding", load).select(*lessons.columns)
    return done.unionByName(again)


def record_triggers(lessons: DataFrame, hits: DataFrame) -> DataFrame:
    """The lessons with a count more for each hit (lesson_id, at) and the time of the last."""
    seen = hits.groupBy(F.col("lesson_id").alias("id")).agg(F.count("*").alias("_n"), F.max("at").alias("_last"))
    out = lessons.join(seen, "id", "left")
    return out.withColumns({"trigger_count": F.col("trigger_count") + F.coalesce("_n", F.lit(0)), "last_triggered_at": F.coalesce("_last", "last_triggered_at")}).select(*lessons.columns)


# Fixed values.
MEMORY_SESSION, MEMORY_PROJECT, AGENT = "manual-memories", "manual", "claude-code"


def save_memories(df: DataFrame, load=None) -> DataFrame:
    """Free texts (text, title, project) as observations of one shared session: title given or the first 80 characters."""
    text = F.col("text")
    rows = df.select(F.coalesce(X.filled("title"), F.substring(text, 1, 80)).alias("title"), F.coalesce(X.filled("project"), F.lit(MEMORY_PROJECT)).alias("project"), F.lit(MEMORY_SESSION).alias("session_id"), F.lit("discovery").alias("type"), text.alias("narrative"), text.alias("raw_text"), *[c for c in df.columns if c not in ("text", "title", "project")])
    return embed(rows, load=load)


def create_lessons(df: DataFrame, load=None) -> DataFrame:
    """Lessons from rules (rule, title, severity, project, trigger_tool, trigger_pattern): title given or the first 80 characters of the
    rule, unknown severity as warning, no project for a global one.
    """
    title = F.coalesce(X.filled("title"), F.substring("rule", 1, 80))
    rows = df.withColumn("severity", X.known_severity("severity")).withColumn("title", title).withColumn("project", X.filled("project"))
    return embed(rows.withColumn("raw_text", F.concat_ws("\n", "title", "rule")).withColumn("active", F.lit(True)).withColumn("trigger_count", F.lit(0).cast("long")), load=load)


def create_observations(df: DataFrame, load=None) -> DataFrame:
    """Observations given directly: raw_text is built and embedded; a row whose embedding fails is kept without."""
    return embed(df.withColumn("raw_text", X.build_raw_text()), load=load)


def with_ids(rows: DataFrame, projects: DataFrame, sessions: DataFrame | None, at: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``rows`` (project and, with ``sessions``, session_id) with project_id and session_key, and the tables with a new row for each project and
    session that was missing. A null project stays without one. A session's project is the first seen, by name.
    """
    projects = written(ensure_projects(projects, rows.select(F.col("project").alias("name"))))
    out = rows.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project", "left")
    if sessions is None:
        return out, projects, None
    when = F.to_timestamp(F.lit(at)).alias("created_at")
    events = out.where("session_id is not null").select("session_id", "project_id", F.lit(AGENT).alias("agent_type"), when)
    sessions = written(ensure_sessions(sessions, events))
    return out.join(sessions.select("session_id", F.col("id").alias("session_key")), "session_id", "left"), projects, sessions


def store_memories(df: DataFrame, projects: DataFrame, sessions: DataFrame, at: str, load=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``save_memories`` with the ids of project and session, both made where they are missing; and the tables after it."""
    return with_ids(save_memories(df, load), projects, sessions, at)


def store_lessons(df: DataFrame, projects: DataFrame, at: str, load=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``create_lessons`` with the project's id, made where it is missing (global lessons have none); the projects after it; and the rules
    that are refused for their pattern.
    """
    held = validate_trigger_pattern(df)
    rows, projects, _ = with_ids(create_lessons(held.where("pattern_ok").drop("pattern_ok"), load), projects, None, at)
    return rows, projects, held.where("not pattern_ok").drop("pattern_ok")


def store_observations(df: DataFrame, projects: DataFrame, sessions: DataFrame, at: str, load=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``create_observations`` with defaults for what is absent and the ids of project and session, both made where they are missing; the
    tables after it; and the rows that break the constraints of the table.
    """
    made = observation_defaults(df).withColumn("raw_text", X.build_raw_text())
    ok, rejects = validate_observations(made)
    rows, projects, sessions = with_ids(embed(ok, load=load), projects, sessions, at)
    return rows, projects, sessions, rejects


def register_model(models: DataFrame, name: str, dimensions: int, provider: str | None = None) -> DataFrame:
    """The models with ``name`` as the only default, added if it is new."""
    is_it = F.col("model_name") == name
    kept = models.withColumn("is_default", is_it).withColumn("dimensions", F.when(is_it, F.lit(dimensions)).otherwise(F.col("dimensions")).cast("int"))
    top = models.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.coalesce(F.max(is_it.cast("int")), F.lit(0)).alias("there"))
    new = top.where("there = 0").select((F.col("top") + 1).alias("id"), F.lit(name).alias("model_name"), F.lit(dimensions).cast("int").alias("dimensions"), F.lit(provider).cast("string").alias("provider"), F.lit(True).alias("is_default"))
    return kept.unionByName(new, allowMissingColumns=True)


def reembed(obs: DataFrame, load=None, model_id: int | None = None, only_missing: bool = True) -> DataFrame:
    """The observations with vectors made anew from raw_text, and embedding_error. Rows of a failing batch keep their old vector."""
    due = F.col("embedding").isNull() if only_missing else F.lit(True)
    rest = obs.where(~due).withColumn("embedding_error", F.lit(None).cast("string"))
    made = embed(obs.where(due), "raw_text", "_new", load)
    done = made.withColumns({"embedding": F.coalesce("_new", "embedding"), "embedding_model_id": F.when(F.col("_new").isNotNull(), F.lit(model_id).cast("long")).otherwise(F.col("embedding_model_id"))}).withColumn("embedding_error", F.col("_new_error"))
    return rest.unionByName(done.select(*rest.columns))


def reembed_progress(before: DataFrame, after: DataFrame, only_missing: bool = True) -> DataFrame:
    """total, processed and errors of a re-embedding."""
    total = before.agg(F.count_if(F.col("embedding").isNull() if only_missing else F.lit(True)).alias("total"))
    errors = after.agg(F.count_if(F.col("embedding_error").isNotNull()).alias("errors"))
    return total.join(errors).select("total", (F.col("total") - F.col("errors")).alias("processed"), "errors")
