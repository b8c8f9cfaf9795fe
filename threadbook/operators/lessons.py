"""Lessons: matching against tool calls, listing, rendering."""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.patterns import Pattern, PatternIndex, pattern_analysis
from ..scratch import written
from .ingest import LIST_LIMIT, with_optional_project

#: Rules, and bytes of their patterns, that one index holds; larger tables are matched in several passes.
INDEX_ROWS, INDEX_BYTES = 100_000, 8 << 20
_HITS = pa.list_(pa.struct([("level", pa.int32()), ("lesson_id", pa.int64()), ("no", pa.int64())]))
_indexes: dict[str, PatternIndex] = {}


def _index(shipped, k: int) -> PatternIndex:
    """The index of a broadcast, made once in each worker; the last one is kept."""
    name, rules = shipped.value
    if name not in _indexes:
        _indexes.clear()
        known = lambda text, words, linear, narrow: None if text is None else Pattern(text, frozenset(words) if words else None, linear, narrow)
        _indexes[name] = PatternIndex([((level, lesson, no), (tool, project), known(*pattern)) for level, lesson, no, tool, project, *pattern in rules], k)
    return _indexes[name]


def _hits_of(shipped, k: int):
    def run(tools: pa.Array, projects: pa.Array, previews: pa.Array) -> pa.Array:
        keys = [[(t, p) for t in dict.fromkeys(("", tool)) for p in dict.fromkeys((None, project))] for tool, project in zip(tools.to_pylist(), projects.to_pylist(), strict=True)]
        hits = _index(shipped, k).match(previews.to_pylist(), keys)
        return pa.array([[dict(zip(("level", "lesson_id", "no"), h, strict=True)) for h in some] for some in hits], _HITS)

    return F.arrow_udf(run, "array<struct<level: int, lesson_id: long, no: long>>")


def match_lessons(calls: DataFrame, lessons: DataFrame, projects: DataFrame, k: int = 5, candidate_limit: int | None = None, limit_rows: int = INDEX_ROWS, limit_bytes: int = INDEX_BYTES) -> DataFrame:
    """The lessons that each call (call_id, tool_name, project, preview) hits: active, for its tool or any, for its project or global,
    and without a pattern or with one found in the preview, in any case. Critical first, then by id; at most k a call.

    Calls are not joined with rules. An index of the rules goes to the tasks: an automaton finds, in one pass over a preview, the words that patterns need, and only patterns with a word
    there are tested, by a matcher that takes linear time. Calls stay where they are; the texts of rules are fetched for hits. An index holds ``limit_rows`` rules and ``limit_bytes`` of patterns
    at most; more rules take several passes, each of which keeps k hits a call. Patterns are those of Python's ``re``; what does not compile, or is too long, never hits. Those that need
    backtracking (references, assertions about what surrounds) have a second for a preview. With a ``candidate_limit`` only so many lessons in that order are tried.
    """
    spark = calls.sparkSession
    rules = with_optional_project(lessons.where("active"), projects)
    rules = rules.select(F.col("id").cast("long").alias("lesson_id"), "severity", "rule", F.col("project_name").alias("lesson_project"), F.col("project_id").isNull().alias("is_global"), F.col("trigger_pattern").alias("pattern"), F.coalesce("trigger_tool", F.lit("")).alias("tool_key"), X.severity_order().cast("int").alias("level"))
    if candidate_limit is not None:
        rules = rules.orderBy("level", "lesson_id").limit(candidate_limit)
    rules = rules.where("is_global or lesson_project is not null").withColumns({"no": F.monotonically_increasing_id(), "known": pattern_analysis("pattern")})
    rules = written(rules.where("pattern is null or known is not null"))  # each pattern is looked at once
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    passes = max(1, math.ceil(n / max(1, limit_rows)), math.ceil(size / max(1, limit_bytes)))
    asked = [F.coalesce("tool_name", F.lit("")), F.col("project"), F.coalesce("preview", F.lit(""))]
    held = calls.select("call_id", "tool_name", "project", "preview").withColumn("hits", F.array().cast("array<struct<level: int, lesson_id: bigint, no: bigint>>"))
    for turn in range(passes):
        some = rules.where(F.pmod(F.xxhash64("no"), F.lit(passes)) == turn)
        some = some.select("level", "lesson_id", "no", "tool_key", F.when(~F.col("is_global"), F.col("lesson_project")), "known.*").collect()  # limit_rows rules
        new = _hits_of(spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in some])), k)(*asked)
        held = held.withColumn("hits", F.slice(F.array_sort(F.concat("hits", new)), 1, k) if passes > 1 else new)
        if turn < passes - 1:
            held = written(held)
    hits = held.select("call_id", F.posexplode("hits").alias("place", "hit")).select("call_id", (F.col("place") + 1).alias("rank"), F.col("hit.no").alias("no"))
    return hits.join(rules.select("no", "lesson_id", "severity", "rule", "lesson_project"), "no").select("call_id", "rank", "lesson_id", "severity", "rule", "lesson_project")


def format_lesson_hits(hits: DataFrame) -> DataFrame:
    """One text for each call: a heading and a line for each hit."""
    line = F.concat(F.upper("severity"), F.lit(" ["), F.coalesce("lesson_project", F.lit("global")), F.lit("]: "), F.col("rule"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    heading = F.lit("## Active Lessons")  # fixed value
    return hits.groupBy("call_id").agg(F.concat_ws("\n", heading, lines).alias("message"))


def list_lessons(lessons: DataFrame, projects: DataFrame, project: str | None = None, severity: str | None = None, active: bool | None = True, limit: int = 50) -> DataFrame:
    """Lessons by severity, then newest first. A project leaves out global lessons."""
    out = with_optional_project(lessons, projects)
    for column, value in (("project_name", project), ("severity", severity), ("active", active)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(X.severity_order(), F.desc("created_at"), "id").limit(min(limit, LIST_LIMIT))
