"""Streams over tool calls, lesson hits and session events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import columns as X
from ..functions.udfs import embed, extract
from ..operators.ingest import advance_queue, observation_defaults, resolve_session_project, validate_observations
from ..operators.lessons import match_lessons
from ..schemas import MAX_RETRIES, SKIPPED_TOOLS
from ..scratch import cleared, mark, written
from ..sources.tables import payload_hash


def process_queue(queue: DataFrame, extractor: Callable[[str], str | None], at: str, load=None, fallback=None, sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One batch of queue rows: finished observations, and the queue after it. Low-value tools and answers that say so are skipped;
    a missing or broken answer, or one that breaks the table's constraints, is an error and is tried again later.

    With ``sessions`` the project is that of the row's session, and a row without one is an error that no model is asked about; else it is
    named after the working directory. The model is asked once a row: answers are written before anything is derived from them.
    """
    due = queue.where("status = 'pending'")
    skipped = F.coalesce(F.col("tool_name"), F.lit("")).isin(*SKIPPED_TOOLS)
    outcomes = [due.where(skipped).select("id", F.lit("skip").alias("outcome"))]
    work, project = due.where(~skipped), X.derive_project("cwd").alias("project")
    if sessions is not None:
        held = resolve_session_project(work, sessions)
        outcomes.append(held.where("outcome = 'error'").select("id", "outcome"))
        work, project = held.where("outcome is null").drop("outcome", "session_key"), F.col("project_id")
    asked = extract(work.withColumn("prompt", X.extraction_prompt()), extractor, fallback)
    asked = written(asked.select("id", "session_id", project, "tool_name", "created_at", "outcome", "data"))
    made = asked.where("outcome = 'ok'").select(F.col("id").alias("queue_id"), "session_id", asked.columns[2], "tool_name", "created_at", "data.*").drop("skip")
    made, rejects = validate_observations(observation_defaults(made).withColumn("raw_text", X.build_raw_text()))
    outcomes += [asked.where("outcome <> 'ok'").select("id", "outcome"), made.select(F.col("queue_id").alias("id"), F.lit("ok").alias("outcome")), rejects.select(F.col("queue_id").alias("id"), F.lit("error").alias("outcome"))]
    return embed(made, load=load), advance_queue(queue, reduce(DataFrame.unionByName, outcomes), at)


def stream_observations(queue: DataFrame, extractor: Callable[[str], str | None], sink: str, checkpoint: str, at: str, load=None, fallback=None, sessions: DataFrame | None = None, retry: bool = False) -> StreamingQuery:
    """The queue as a stream. Each micro-batch writes its observations and queue rows to a folder of its number, so a batch that runs
    again replaces what it wrote. Rows that have to be retried stay pending below ``sink``/queue.

    With ``retry``, they go into the next batch, and only rows that are through stay below ``sink``/queue; those that wait are in
    ``sink``/pending, and ``finish_retries`` sees to them when no more batches come.
    """

    def run(batch: DataFrame, number: int) -> None:
        step = mark(spark := batch.sparkSession)
        held = _waiting(spark, sink, number - 1, batch.schema) if retry and number else None
        batch = written(batch if held is None else batch.unionByName(held))
        try:
            _process(batch, str(number), extractor, sink, at, load, fallback, sessions, retry)
        finally:
            cleared(spark, step)

    return queue.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _process(batch: DataFrame, name: str, extractor, sink: str, at: str, load, fallback, sessions, retry: bool) -> int:
    """Writes one batch under ``name``; gives the number of rows that wait."""
    made, after = process_queue(batch, extractor, at, load, fallback, sessions)
    save = lambda df, folder: df.write.mode("overwrite").parquet(f"{sink}/{folder}/batch={name}")
    save(made, "observations")
    if not retry:
        save(after, "queue")
        return 0
    waits = after.where("status = 'pending'")
    save(after.where("status <> 'pending'"), "queue")
    save(waits, "pending")
    return batch.sparkSession.read.schema(batch.schema).parquet(f"{sink}/pending/batch={name}").count()


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName().removeprefix("batch=") for s in store.listStatus(path)] if store.exists(path) else []


def _waiting(spark: SparkSession, sink: str, number: int, schema) -> DataFrame | None:
    """The rows that wait after batch ``number`` and what ``finish_retries`` did after it."""
    after = [n for n in _names(spark, f"{sink}/pending") if n.split(".")[0] == str(number)]
    last = max(after, key=lambda n: int((n.split(".") + ["0"])[1]), default=None)
    return None if last is None else spark.read.schema(schema).parquet(f"{sink}/pending/batch={last}")


def finish_retries(spark: SparkSession, schema, extractor: Callable[[str], str | None], sink: str, at: str, load=None, fallback=None, sessions: DataFrame | None = None) -> int:
    """Processes what waits below ``sink``/pending again until nothing does: a row ends as done, skipped or failed after ``MAX_RETRIES`` retries
    at most. ``schema`` is the queue's. For a stream that is not running. Returns the number of rounds.
    """
    for step in range(MAX_RETRIES + 2):
        number = max((int(n.split(".")[0]) for n in _names(spark, f"{sink}/pending")), default=None)
        held = None if number is None else _waiting(spark, sink, number, schema)
        if held is None or not held.limit(1).count():
            return step
        last = max(int((n.split(".") + ["0"])[1]) for n in _names(spark, f"{sink}/pending") if n.split(".")[0] == str(number))
        _process(held, f"{number}.{last + 1}", extractor, sink, at, load, fallback, sessions, True)
    return MAX_RETRIES + 2


def retry_failed(queue: DataFrame) -> DataFrame:
    """Rows of a finished batch that go into the next one."""
    return queue.where("status = 'pending' and retry_count > 0")


def stream_lesson_matches(calls: DataFrame, lessons: DataFrame, projects: DataFrame, sink: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Lesson hits of upcoming calls; the ranking of a call's hits is complete within its micro-batch."""

    def run(batch: DataFrame, number: int) -> None:
        step = mark(batch.sparkSession)
        try:
            match_lessons(batch, lessons, projects, k).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        finally:
            cleared(batch.sparkSession, step)

    return calls.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_replays(events: DataFrame, columns: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Events without repeated deliveries: equal payloads within ``delay`` are one."""
    return events.withColumn("payload_hash", payload_hash(*columns)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["payload_hash"])


def stream_trigger_counts(hits: DataFrame) -> DataFrame:
    """Running count and last time of each lesson (lesson_id, at). For update or complete mode."""
    return hits.groupBy("lesson_id").agg(F.count("*").alias("trigger_count"), F.max("at").alias("last_triggered_at"))


def stream_session_state(events: DataFrame) -> DataFrame:
    """State of each session from start and end events (session_id, kind, at), in whatever order they come."""
    started, ended = F.min(F.when(F.col("kind") == "start", F.col("at"))), F.max(F.when(F.col("kind") == "end", F.col("at")))
    state = events.groupBy("session_id").agg(started.alias("started_at"), ended.alias("completed_at"))
    return state.withColumn("status", F.when(F.col("completed_at").isNotNull(), "completed").otherwise("active"))


def session_lifecycle(events: DataFrame, timeout: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions from start and end events (session_id, kind, at), with state that ends: a row whenever a session changes, for update mode.

    A start makes a session active, an end completed, in whatever order they come. One whose end has not come ``timeout`` after its start, by the watermark, is failed. State leaves then, and
    ``late`` after an end; so what is held is bounded by the sessions of that time, not by all there ever were. An end that comes after its session has failed completes it by a row
    of its own, and ``latest_sessions`` puts them together. Events later than the watermark are dropped; those without session or time, or of another kind, say nothing.
    """
    spark = events.sparkSession
    micros = lambda span: spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {span}) AS us").first().us
    patience, grace = micros(timeout), micros(late)

    def run(key, batches, state):
        if state.hasTimedOut:
            started, ended = state.get
            state.remove()
            if ended is None:
                yield pd.DataFrame({"session_id": [key[0]], "status": ["failed"], "started": pd.array([started], "Int64"), "ended": pd.array([None], "Int64")})
            return
        started, ended = before = tuple(state.get) if state.exists else (None, None)
        for b in batches:
            for kind, us in zip(b["kind"], b["us"], strict=True):
                if kind == "start":
                    started = us if started is None else min(started, us)
                else:
                    ended = us if ended is None else max(ended, us)
        started, ended = (None if x is None else int(x) for x in (started, ended))
        state.update((started, ended))
        due = ended + grace if ended is not None else started + patience
        state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        if (started, ended) != before:
            yield pd.DataFrame({"session_id": [key[0]], "status": ["active" if ended is None else "completed"], "started": pd.array([started], "Int64"), "ended": pd.array([ended], "Int64")})

    known = events.where("session_id is not null and at is not null and kind in ('start', 'end')").withWatermark("at", late)
    kind = events.schema["session_id"].dataType.simpleString()
    made = known.select("session_id", "kind", "at", F.unix_micros("at").alias("us")).groupBy("session_id")
    out = made.applyInPandasWithState(run, f"session_id {kind}, status string, started long, ended long", "started long, ended long", "update", GroupStateTimeout.EventTimeTimeout)
    return out.select("session_id", "status", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("ended").alias("completed_at"))


def latest_sessions(rows: DataFrame) -> DataFrame:
    """One row a session of all that ``session_lifecycle`` has given: completed before failed before active."""
    order = F.when(F.col("status") == "completed", 2).when(F.col("status") == "failed", 1).otherwise(0)
    return rows.groupBy("session_id").agg(F.max_by("status", order).alias("status"), F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"))


def session_outcomes(events: DataFrame, watermark: str, timeout: str = "6 hours") -> DataFrame:
    """What ``session_lifecycle`` comes to for a table of events, once the watermark is there."""
    state = stream_session_state(events.where("session_id is not null and at is not null and kind in ('start', 'end')"))
    over = F.expr(f"started_at + INTERVAL {timeout}") < F.to_timestamp(F.lit(watermark))
    return state.withColumn("status", F.when(F.col("completed_at").isNotNull(), "completed").when(over, "failed").otherwise("active")).select("session_id", "status", "started_at", "completed_at")


def queue_throughput(events: DataFrame, time: str = "created_at", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by status in tumbling windows; what comes later than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")
