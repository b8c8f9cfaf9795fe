"""Physical plans: what is broadcast, pushed down, cut early, and never multiplied."""

from tests.conftest import DATA
from threadbook.fixtures import Fixtures
from threadbook.operators import ingest, lessons, vector
from threadbook.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_sides_are_broadcast(spark):
    x = Fixtures(spark, f"{DATA}/sf0.001")
    assert "CartesianProduct" not in plan(lessons.match_lessons(x.calls, x.lessons, x.projects))
    assert "BroadcastHashJoin" in plan(lessons.match_lessons(x.calls, x.lessons, x.projects))
    assert "BroadcastNestedLoopJoin" not in plan(lessons.match_lessons(x.calls, x.lessons, x.projects))


def test_top_k_is_cut_before_the_shuffle(spark):
    x = Fixtures(spark, f"{DATA}/sf0.001")
    assert "WindowGroupLimit" in plan(vector.vector_topk(x.queries, x.observations, 5, "sql"))
    assert "CartesianProduct" not in plan(vector.vector_topk(x.queries, x.observations, 5, "matmul"))


def test_lists_take_the_top_without_a_sort_of_all(spark):
    x = Fixtures(spark, f"{DATA}/sf0.001")
    assert "TakeOrderedAndProject" in plan(ingest.list_observations(x.rows.withColumn("embedding", x.rows.id), x.projects, limit=5))


def test_scans_read_what_they_need(spark):
    text = plan(QUERIES["count_by_type"](spark, f"{DATA}/sf0.001"))
    assert "ReadSchema: struct<doc_id:bigint>" in text
    one = plan(QUERIES["get_observation"](spark, f"{DATA}/sf0.001"))
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,42)]" in one


def test_time_lines_have_no_window_over_a_session(spark):
    text = plan(QUERIES["timeline"](spark, f"{DATA}/sf0.001"))
    assert "Window" not in text


def test_cells_meet_without_vectors_of_the_corpus(spark):
    text = plan(QUERIES["write_ann"](spark, f"{DATA}/sf0.001"))
    joined = [line for line in text.splitlines() if "Join" in line and "cell" in line]
    assert joined and not any("embedding" in line for line in joined)


def test_stored_index_is_cut_by_lexemes_first(spark):
    assert "dynamicpruning" in plan(QUERIES["hybrid_search_stored"](spark, f"{DATA}/sf0.001"))
