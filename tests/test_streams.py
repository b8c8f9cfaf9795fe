"""Streams over file sources, a batch a file."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import DATA
from threadbook import queries
from threadbook.fixtures import NOW, Fixtures
from threadbook.sources import tables
from threadbook.streaming import streams


def stream_of(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/f{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_stream_equals_batch(spark, tmp_path):
    x = Fixtures(spark, f"{DATA}/sf0.001")
    stream = queries._stream(x, x.queue, 3)
    streams.stream_observations(stream, queries._answer, f"{tmp_path}/sink", f"{tmp_path}/state", NOW).awaitTermination()
    made, after = streams.process_queue(x.queue, queries._answer, NOW)
    keep = ["queue_id", "title", "raw_text", "project"]
    assert sorted(spark.read.parquet(f"{tmp_path}/sink/observations").select(*keep).collect()) == sorted(made.select(*keep).collect())
    assert sorted(spark.read.parquet(f"{tmp_path}/sink/queue").select("id", "status").collect()) == sorted(after.select("id", "status").collect())


def test_repeated_payload_is_one(spark, tmp_path):
    at = datetime(2024, 1, 1)
    s = stream_of(spark, str(tmp_path / "in"), [[("a", at)], [("a", at), ("b", at)]], "p string, at timestamp")
    assert queries._drained(streams.dedup_replays(s, ["p"], "at")).count() == 2


def test_late_rows_do_not_count(spark, tmp_path):
    rows = [[("ok", datetime(2024, 1, 1, 10, 5))], [("ok", datetime(2024, 1, 1, 15, 0))], [("ok", datetime(2024, 1, 1, 10, 6))], [("ok", datetime(2024, 1, 1, 20, 0))]]
    path = str(tmp_path / "in")
    schema = "status string, created_at timestamp"
    out = f"{tmp_path}/out"
    for r in rows:  # a run a file, so that the watermark moves in between
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(path)
        s = spark.readStream.schema(schema).parquet(path)
        streams.queue_throughput(s).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(out).awaitTermination()
    got = {r.start.hour: r.n for r in spark.read.parquet(out).collect()}
    assert got[10] == 1


def test_end_before_start(spark, tmp_path):
    s = stream_of(spark, str(tmp_path / "in"), [[("s", "end", datetime(2024, 1, 1, 12))], [("s", "start", datetime(2024, 1, 1, 9))]], "session_id string, kind string, at timestamp")
    r = queries._drained(streams.stream_session_state(s), "complete").first()
    assert (r.status, r.started_at) == ("completed", datetime(2024, 1, 1, 9))


def test_counts_over_batches(spark, tmp_path):
    s = stream_of(spark, str(tmp_path / "in"), [[(1, datetime(2024, 1, 1))], [(1, datetime(2024, 1, 3)), (2, datetime(2024, 1, 2))]], "lesson_id long, at timestamp")
    got = {r.lesson_id: (r.trigger_count, r.last_triggered_at.day) for r in queries._drained(streams.stream_trigger_counts(s), "complete").collect()}
    assert got == {1: (2, 3), 2: (1, 2)}


def test_spool(spark, tmp_path):
    calls = spark.createDataFrame([("s", "Bash", "{}", None, "/w", None)] * 3 + [("s", "Bash", "{}", None, "/v", None)], "session_id string, tool_name string, tool_input string, tool_response_preview string, cwd string, last_user_message string")
    calls.write.json(str(tmp_path / "spool"))
    assert tables.replay_spool(spark, str(tmp_path / "spool"), streaming=False).count() == 2
    assert queries._drained(tables.replay_spool(spark, str(tmp_path / "spool")).select("session_id", "cwd")).count() == 2


def test_late_retry(spark):
    queue = spark.createDataFrame([(1, "pending", 1), (2, "pending", 0), (3, "failed", 4)], "id long, status string, retry_count int")
    assert [r.id for r in streams.retry_failed(queue).select(F.col("id")).collect()] == [1]


QUEUE = "id long, session_id string, tool_name string, tool_input string, tool_response_preview string, cwd string, last_user_message string, status string, retry_count int, created_at timestamp, processed_at timestamp"


def queue_row(i, session="s", cwd="/w/p", message=None, tool="Bash", retries=0):
    return (i, session, tool, "{}", None, cwd, message, "pending", retries, datetime(2024, 1, 1), None)


def counted(path):
    """A model that leaves a line for each prompt it is asked."""

    def ask(prompt):
        with open(path, "a") as f:
            f.write("x\n")
        kind = prompt.split("User request: ")[1].split("\n")[0]
        return {"good": '{"title": "t", "type": "change"}', "odd": '{"title": "t", "type": "rumour"}', "skip": '{"skip": true}'}.get(kind)

    return ask


def test_the_model_is_asked_once_a_row(spark, tmp_path):
    rows = [queue_row(i, message=m) for i, m in enumerate(["good", "odd", "skip", "none"] * 5)] + [queue_row(90, message="good", tool="TodoWrite"), queue_row(91, "nowhere", message="good")]
    queue = spark.createDataFrame(rows, QUEUE).repartition(3)
    sessions = spark.createDataFrame([(7, "s", 3)], "id long, session_id string, project_id long")
    made, after = streams.process_queue(queue, counted(f"{tmp_path}/calls"), NOW, sessions=sessions)
    assert {(r.queue_id, r.project_id) for r in made.collect()} == {(i, 3) for i in range(0, 20, 4)}
    status = {r.id: (r.status, r.retry_count) for r in after.collect()}
    want = {"good": ("done", 0), "odd": ("pending", 1), "skip": ("skipped", 0), "none": ("pending", 1)}
    assert status == {**{r[0]: want[r[6]] for r in rows[:20]}, 90: ("skipped", 0), 91: ("pending", 1)}
    assert sum(1 for _ in open(f"{tmp_path}/calls")) == 20


def test_retries_come_back_and_end(spark, tmp_path):
    sink, ask = f"{tmp_path}/sink", counted(f"{tmp_path}/calls")
    batches = [[queue_row(1, message="good"), queue_row(2, message="none")], [queue_row(3, message="odd")], [queue_row(4, message="skip")]]
    s = stream_of(spark, str(tmp_path / "in"), batches, QUEUE)
    streams.stream_observations(s, ask, sink, f"{tmp_path}/state", NOW, retry=True).awaitTermination()
    waits = {r.id: r.retry_count for r in streams._waiting(spark, sink, 2, s.schema).collect()}
    assert set(waits) == {2, 3} and waits[2] >= waits[3] >= 1
    assert streams.finish_retries(spark, s.schema, ask, sink, NOW) >= 1
    assert streams.finish_retries(spark, s.schema, ask, sink, NOW) == 0
    read = lambda t: spark.read.option("recursiveFileLookup", "true").parquet(f"{sink}/{t}")
    assert {r.id: (r.status, r.retry_count) for r in read("queue").collect()} == {1: ("done", 0), 2: ("failed", 4), 3: ("failed", 4), 4: ("skipped", 0)}
    assert [r.queue_id for r in read("observations").collect()] == [1]
    assert sum(1 for _ in open(f"{tmp_path}/calls")) == 1 + 4 + 4 + 1


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    sink, ask = f"{tmp_path}/sink", counted(f"{tmp_path}/calls")
    batch = spark.createDataFrame([queue_row(1, message="good"), queue_row(2, message="none")], QUEUE)
    for _ in (1, 2):
        assert streams._process(batch, "0", ask, sink, NOW, None, None, None, True) == 1
    read = lambda t: spark.read.parquet(f"{sink}/{t}")
    assert (read("observations").count(), read("queue").count(), read("pending").count()) == (1, 1, 1)


def _life(spark, tmp_path, name, batches, known=None):
    """Runs the life of sessions over batches of events, a run a batch; gives all rows and how many states were held after each run."""
    schema = "session_id string, kind string, at timestamp"
    folder, root, held = tmp_path / name, str(tmp_path / f"{name}-out"), []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        save = lambda batch, b, n=n: batch.write.mode("overwrite").parquet(f"{root}/rows/run={n}/batch={b}")
        q = streams.session_lifecycle(stream).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None)
    return spark.read.parquet(f"{root}/rows"), held


def test_sessions_end_and_their_state_leaves(spark, tmp_path):
    day = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches, events = [], []
    for n in range(5):  # every run: one session that ends, one that never does, one whose end comes first
        rows = [(f"a{n}", "start", day(10 * n)), (f"a{n}", "end", day(10 * n + 1)), (f"b{n}", "start", day(10 * n)), (f"c{n}", "end", day(10 * n + 2)), (f"c{n}", "start", day(10 * n + 1)), (None, "start", day(10 * n)), (f"d{n}", "pause", day(10 * n)), (f"e{n}", "start", None)]
        batches.append(rows)
        events += rows
    batches.append([("b0", "end", day(49)), ("z", "start", day(49.5))])  # after its session has failed
    events += batches[-1]
    rows, held = _life(spark, tmp_path, "life", batches)
    got = sorted(map(tuple, streams.latest_sessions(rows).collect()))
    table = spark.createDataFrame(events, "session_id string, kind string, at timestamp")
    assert got == sorted(map(tuple, streams.session_outcomes(table, "2024-01-03 01:20:00").collect()))
    assert {s: status for s, status, *_ in got} == {**{f"a{n}": "completed" for n in range(5)}, **{f"b{n}": "failed" for n in range(1, 5)}, "b0": "completed", **{f"c{n}": "completed" for n in range(5)}, "z": "active"}
    assert max(held) <= 4  # three sessions a run: those of earlier runs have left
