"""Table functions of SQL give what the functions over DataFrames give."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from threadbook.fixtures import NOW, Fixtures
from threadbook.operators import ingest, lessons, sessions
from threadbook.plans import search, sql


@pytest.fixture(scope="module")
def x(spark):
    x = Fixtures(spark, f"{DATA}/sf0.001")
    sql.register(spark, x.observations, x.projects, x.lessons_with_vectors)
    return x


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def vector(x, key):
    v = x.read("embeddings").where(F.col("vec_id") == key).first().embedding
    return f"array({', '.join(f'{a!r}' for a in v)})"


@pytest.mark.parametrize(("text", "key", "project", "limit"), [("thble thing", 100, None, 20), ("the thing", None, None, 5), ("", 3, "src3", 10), ("of the", None, "src1", 10), ("thing", 100, "src3", 500)])
def test_search(spark, x, text, key, project, limit):
    queries = spark.createDataFrame([(1, text)], "query_id long, text string")
    held = queries.withColumn("vector", F.lit(None).cast("array<float>")) if key is None else queries.join(x.read("embeddings").where(F.col("vec_id") == key).select(F.col("embedding").alias("vector")))
    want = search.hybrid_search(held, x.observations, x.projects, NOW, project=project, limit=limit).select("rank", "id", "title", "type", "project_name", "created_at", "score")
    given = ", ".join([f"'{text}'", vector(x, key) if key is not None else "NULL", f"'{project}'" if project else "NULL"])
    got = spark.sql(f"SELECT * FROM search_memory({given}, TIMESTAMP '{NOW}', {limit})")
    assert rows(got) == rows(want)
    rules = search.search_lessons(held, x.lessons_with_vectors, x.projects, project=project, limit=limit).drop("query_id")
    assert rows(spark.sql(f"SELECT * FROM search_rules({given}, {limit})")) == rows(rules)


def test_look_ups(spark, x):
    got = spark.sql("SELECT * FROM memory_timeline(42, 3, 2)")
    want = sessions.timeline(x.rows, spark.createDataFrame([(42,)], "anchor_id long"), 3, 2).select("position", "id", "session_id", "title", "type", "created_at")
    assert got.count() >= 3 and rows(got) == rows(want)
    got = spark.sql("SELECT id, title FROM get_memories(array(5, 7, 7, 100000))")
    assert rows(got) == rows(ingest.get_observations(x.rows, spark.createDataFrame([(5,), (7,)], "id long")).select("id", "title"))
    got = spark.sql("SELECT id, title, severity, project_name FROM list_rules(NULL, 'critical', 7)")
    assert rows(got) == rows(lessons.list_lessons(x.lessons, x.projects, severity="critical", limit=7).select("id", "title", "severity", "project_name"))
