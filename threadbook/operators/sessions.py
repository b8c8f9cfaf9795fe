"""Sessions and their time lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .dims import assign_ids
from .ingest import LIST_LIMIT, with_project


def list_sessions(sessions: DataFrame, projects: DataFrame, project: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    out = with_project(sessions, projects)
    for column, value in (("project_name", project), ("status", status)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(F.desc("started_at"), "id").limit(min(limit, LIST_LIMIT))


def timeline(obs: DataFrame, anchors: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """For each anchor (anchor_id): the observation itself and its neighbours in the session's time, ``before`` earlier and ``after``
    later ones. Rows at the anchor's own time are left out. Columns: anchor_id, position (0 is the anchor), and those of obs.

    Only ids and times are looked at until the end. Rows of the anchors' sessions get numbers in order of session, time and id, range by
    range, so that no task holds a session; rows of one time are a run of numbers, and a neighbour is found by its number. The rows
    themselves are fetched by id.
    """
    sessions = anchors.select(F.col("anchor_id").alias("id")).join(obs.select("id", "session_id"), "id").select("session_id").distinct()
    narrow = obs.select("id", "session_id", "created_at").join(sessions, "session_id", "left_semi")
    placed = written(assign_ids(narrow, ["session_id", "created_at", "id"], name="_on"))
    runs = written(placed.groupBy("session_id", "created_at").agg(F.min("_on").alias("_first"), F.max("_on").alias("_last")))
    own = anchors.select(F.col("anchor_id").alias("id")).distinct().join(placed, "id").join(runs, ["session_id", "created_at"]).select(F.col("id").alias("anchor_id"), "session_id", "_first", "_last")
    step = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    found = [own.select("anchor_id", F.lit(0).alias("position"), F.col("anchor_id").alias("id"))]
    if before > 0:  # later times first, smaller ids first among equal times: a run is gone through from its start
        wanted = own.select("anchor_id", "session_id", "_first", step(before).alias("n")).select("anchor_id", "session_id", (-F.col("n")).alias("position"), (F.col("_first") - F.col("n")).alias("_on"))
        at = wanted.join(placed.select("_on", "session_id", "created_at"), ["_on", "session_id"]).join(runs, ["session_id", "created_at"])
        at = at.select("anchor_id", "position", (F.col("_first") + F.col("_last") - F.col("_on")).alias("_on"))
        found.append(at.join(placed.select("id", "_on"), "_on").select("anchor_id", "position", "id"))
    if after > 0:
        wanted = own.select("anchor_id", "session_id", "_last", step(after).alias("n")).select("anchor_id", "session_id", F.col("n").alias("position"), (F.col("_last") + F.col("n")).alias("_on"))
        found.append(wanted.join(placed.select("id", "session_id", "_on"), ["session_id", "_on"]).select("anchor_id", "position", "id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.join(obs, "id").select("anchor_id", "position", *obs.columns)
