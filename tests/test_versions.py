"""Tables that change: whole versions, writers that race, changes that rewrite few files, ids and names of two writers."""

import threading

import pytest
from pyspark.sql import functions as F

from threadbook.operators import dims, ingest
from threadbook.schemas import TABLES
from threadbook.sources.versions import Conflict, IdRanges, VersionedTable, get_or_create, update_table, with_reserved_ids

SMALL = "id long, name string, n long"


def _table(spark, root, rows=80, files=8):
    table = VersionedTable(spark, str(root), SMALL)
    table.append(spark.range(rows).select("id", F.concat(F.lit("r"), "id").alias("name"), F.lit(0).alias("n")), files=files)
    return table


def _state(table, version=None):
    return {r.id: (r.name, r.n) for r in table.read(version).collect()}


def test_a_change_rewrites_the_files_of_its_keys_only(spark, tmp_path):
    table = _table(spark, tmp_path / "t")
    before = set(table.files())
    assert len(before) == 8
    keys = spark.createDataFrame([(i,) for i in (3, 4, 5, 77)], "id long")
    assert table.change(keys, lambda rows: rows.join(keys.withColumn("hit", F.lit(1)), "id", "left").withColumn("n", F.coalesce("hit", "n"))) == 2
    after = set(table.files())
    assert len(before & after) == 6 and len(after) == 8
    assert _state(table) == {i: (f"r{i}", int(i in (3, 4, 5, 77))) for i in range(80)}
    assert _state(table, 1) == {i: (f"r{i}", 0) for i in range(80)}
    assert table.change(spark.createDataFrame([(999,)], "id long"), lambda rows: rows) == 2  # touches nothing
    assert table.change(keys, lambda rows: rows.join(keys, "id", "left_anti")) == 3  # deletes
    assert set(_state(table)) == set(range(80)) - {3, 4, 5, 77}
    assert table.vacuum() >= 1 and set(_state(table)) == set(range(80)) - {3, 4, 5, 77} and table._folder.names("versions") == ["3"]


def test_one_of_two_writers_is_refused(spark, tmp_path):
    table, other = _table(spark, tmp_path / "t"), VersionedTable(spark, str(tmp_path / "t"), SMALL)
    seen = table.version()
    add = lambda t, i: t.append(spark.createDataFrame([(i, "x", 1)], SMALL), after=seen)
    assert add(other, 100) == 2
    with pytest.raises(Conflict):
        add(table, 101)
    assert 100 in _state(table) and 101 not in _state(table)
    assert table.append(spark.createDataFrame([(102, "y", 1)], SMALL)) == 3  # after whichever is last
    assert {100, 102} <= set(_state(table))


def test_a_change_is_made_again_after_a_conflict(spark, tmp_path):
    table, times = _table(spark, tmp_path / "t", 10, 2), []
    keys = spark.createDataFrame([(1,), (9,)], "id long")

    def how(rows):
        times.append(1)
        if len(times) == 1:  # another writer commits while this one works
            VersionedTable(spark, table.root, SMALL).change(keys, lambda r: r.withColumn("n", F.col("n") + 10))
        return rows.withColumn("n", F.col("n") + 1)

    assert table.change(keys, how) == 3 and len(times) == 2
    assert {n for _, n in _state(table).values()} == {11}


def test_a_lost_writer_leaves_no_version(spark, tmp_path):
    table = _table(spark, tmp_path / "t")
    table._write(table.read(), 2)  # written, never committed
    assert table.version() == 1 and len(_state(table)) == 80
    empty = VersionedTable(spark, str(tmp_path / "none"), SMALL)
    assert empty.version() == 0 and empty.read().count() == 0 and empty.change(table.read().select("id"), lambda r: r) == 0


def test_two_writers_have_no_id_and_no_project_in_common(spark, tmp_path):
    ids = str(tmp_path / "ids")
    projects = VersionedTable(spark, str(tmp_path / "projects"), TABLES["projects"])
    get_or_create(projects, spark.createDataFrame([("p0",)], "name string"), "name", IdRanges(spark, ids))
    failed, observed = [], []

    def run(names):
        try:
            own = VersionedTable(spark, str(tmp_path / "projects"), TABLES["projects"])
            get_or_create(own, spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), "name", IdRanges(spark, ids))
            observed.append([r.id for r in with_reserved_ids(spark.createDataFrame([(n,) for n in names], "name string"), IdRanges(spark, f"{ids}2"), ["name"]).collect()])
        except Exception as e:  # shown below
            failed.append(e)

    writers = [threading.Thread(target=run, args=(x,)) for x in (["p0", "p1", "p2", "p2"], ["p1", "p2", "p3"], ["p3", "p4"])]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    rows = projects.read().collect()
    assert sorted(r.name for r in rows) == ["p0", "p1", "p2", "p3", "p4"] and len({r.id for r in rows}) == 5
    taken = [i for some in observed for i in some]
    assert len(taken) == 9 == len(set(taken))


def test_patches_of_lessons_and_queue_rows_are_stored(spark, tmp_path):
    lessons = VersionedTable(spark, str(tmp_path / "lessons"), TABLES["lessons"])
    lessons.append(spark.range(100).select("id", F.lit("t").alias("title"), F.lit("r").alias("rule"), F.lit("info").alias("severity"), F.lit("t\nr").alias("raw_text"), F.lit(0).alias("trigger_count"), F.lit(True).alias("active"), *[F.lit(None).alias(c) for c in ("project_id", "trigger_tool", "trigger_pattern", "source_observation_id", "embedding", "last_triggered_at", "created_at")]), files=10)
    before = set(lessons.files())
    patches = spark.createDataFrame([(i, None, "new", None, None, None, i != 7) for i in range(10)], "id long, title string, rule string, severity string, trigger_tool string, trigger_pattern string, active boolean")
    assert update_table(lessons, patches, dims.update_lessons) == 2
    assert len(before & set(lessons.files())) == 9
    got = {r.id: r for r in lessons.read().collect()}
    assert len(got) == 100 and all(got[i].rule == ("new" if i < 10 else "r") and (got[i].embedding is not None) == (i < 10) for i in got) and not got[7].active
    queue = VersionedTable(spark, str(tmp_path / "queue"), TABLES["queue"])
    queue.append(spark.range(20).select("id", F.lit("pending").alias("status"), F.lit(3).alias("retry_count"), *[F.lit(None).alias(c) for c in ("session_id", "tool_name", "tool_input", "tool_response_preview", "cwd", "last_user_message", "created_at", "processed_at")]), files=4)
    outcomes = spark.createDataFrame([(1, "ok"), (19, "error")], "id long, outcome string")
    update_table(queue, outcomes, lambda rows, o: ingest.advance_queue(rows, o, "2024-02-15 00:00:00"))
    assert {r.id: r.status for r in queue.read().collect()} == {i: {1: "done", 19: "failed"}.get(i, "pending") for i in range(20)}


def test_a_look_up_by_id_finds_few_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    table = _table(spark, tmp_path / "t", 4000, 16)
    hit = table.read().where("id = 1234")
    assert [r.name for r in hit.collect()] == ["r1234"]
    groups = [g.column(0).statistics for f in table.files() for meta in [pq.ParquetFile(f"{table.root}/{f}").metadata] for g in map(meta.row_group, range(meta.num_row_groups))]
    assert len(groups) >= 16 and sum(s.min <= 1234 <= s.max for s in groups) == 1
