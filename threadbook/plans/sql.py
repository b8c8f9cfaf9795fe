"""The searches and look-ups as SQL table functions over named views: ``SELECT * FROM search_memory('words', NULL, 'project', now(), 20)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import udfs
from ..operators.ingest import LIST_LIMIT
from ..operators.text import STOP_WORDS, WORD
from ..schemas import FIELD_WEIGHTS, LESSON_WEIGHTS, RECENCY_DAYS, RRF_K
from .search import MAX_LIMIT

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORD = WORD.replace("\\", "\\\\")


def _words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{_WORD}', 0)"


_ASKED = f"array_except(array_distinct({_words('query')}), array({_STOP}))"


def _text_list(rows: str, weights: dict[str, float], k: str) -> str:
    """id, rank and src 1 of the rows that hold every word of the query, by weighted counts."""
    fields = ", ".join(f"{_words(f)} AS w_{f}" for f in weights)
    count = lambda f: f"size(filter(w_{f}, x -> x = w))"
    some = " + ".join(count(f) for f in weights)
    gain = " + ".join(f"{w}D * ({count(f)} / ({count(f)} + 1.0D))" for f, w in weights.items())
    return f"""SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, 1 AS src FROM (
      SELECT id, round(aggregate(asked, 0.0D, (s, w) -> s + ({gain})), 6) AS score FROM (SELECT id, {_ASKED} AS asked, {fields} FROM {rows})
      WHERE size(asked) > 0 AND forall(asked, w -> {some} > 0) ORDER BY score DESC, id LIMIT {k})"""


def _vector_list(rows: str, k: str) -> str:
    """id, rank and src 0 of the rows that are most similar to the vector."""
    wide = lambda v: f"transform({v}, x -> CAST(x AS DOUBLE))"
    norm = lambda v: f"sqrt(aggregate({v}, 0.0D, (s, x) -> s + x * x))"
    unit = lambda v: f"transform({wide(v)}, x -> x / {norm(wide(v))})"
    return f"""SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, 0 AS src FROM (
      SELECT id, round(aggregate(zip_with({unit('vector')}, {unit('embedding')}, (a, b) -> a * b), 0.0D, (s, x) -> s + x), 6) AS score FROM {rows}
      WHERE vector IS NOT NULL AND embedding IS NOT NULL AND {norm(wide('embedding'))} > 0 AND {norm(wide('vector'))} > 0
      ORDER BY score DESC, id LIMIT {k})"""


def _fused(rows: str, weights: dict[str, float], most: int) -> str:
    lists = [f"SELECT * FROM ({make}) WHERE rank < 2 * least(n, {most})" for make in (_vector_list(rows, str(2 * most)), _text_list(rows, weights, str(2 * most)))]
    return f"SELECT id, sum(1.0D / ({RRF_K} + rank)) AS rrf, min(src) AS src, min_by(rank, src) AS src_rank FROM ({' UNION ALL '.join(lists)}) GROUP BY id"


def _functions() -> dict[str, str]:
    boost = f"1.0D + CASE WHEN o.created_at IS NULL THEN 0.0D ELSE exp(-greatest((unix_micros(at) - unix_micros(o.created_at)) / 86400000000.0D, 0.0D) / {RECENCY_DAYS}D) END"
    place = "CAST(row_number() OVER (ORDER BY rrf DESC, src, src_rank) AS INT) AS rank"
    mine = "(SELECT o.*, p.name AS project_name FROM observations o JOIN projects p ON p.id = o.project_id WHERE project IS NULL OR p.name = project)"
    theirs = "(SELECT l.*, p.name AS project_name FROM lessons l LEFT JOIN projects p ON p.id = l.project_id WHERE l.active AND (project IS NULL OR p.name = project OR l.project_id IS NULL))"
    side = lambda sign, order, limit: f"""SELECT CAST({sign}n AS INT) AS position, id FROM (
      SELECT o.id, row_number() OVER (ORDER BY o.created_at {order}, o.id) AS n FROM observations o JOIN observations a ON a.id = anchor AND o.session_id = a.session_id AND o.created_at {'<' if sign == '-' else '>'} a.created_at)
      WHERE n <= {limit}"""  # noqa: E731
    return {
        "search_memory(query STRING, vector ARRAY<FLOAT>, project STRING, at TIMESTAMP, n INT) RETURNS TABLE (rank INT, id BIGINT, title STRING, type STRING, project_name STRING, created_at TIMESTAMP, score DOUBLE)": f"""
      SELECT rank, o.id, o.title, o.type, o.project_name, o.created_at, round(rrf, 4) FROM (
        SELECT id, rrf, {place} FROM (SELECT f.id, f.rrf * ({boost}) AS rrf, src, src_rank FROM ({_fused(mine, FIELD_WEIGHTS, MAX_LIMIT)}) f JOIN observations o ON o.id = f.id)) t
      JOIN {mine} o ON o.id = t.id WHERE rank <= least(n, {MAX_LIMIT})""",
        "search_rules(query STRING, vector ARRAY<FLOAT>, project STRING, n INT) RETURNS TABLE (rank INT, id BIGINT, title STRING, rule STRING, severity STRING, project_name STRING, score DOUBLE)": f"""
      SELECT rank, l.id, l.title, l.rule, l.severity, l.project_name, round(rrf, 4) FROM (SELECT id, rrf, {place} FROM ({_fused(theirs, LESSON_WEIGHTS, 50)})) t
      JOIN {theirs} l ON l.id = t.id WHERE rank <= least(n, 50)""",
        "memory_timeline(anchor BIGINT, before INT, after INT) RETURNS TABLE (position INT, id BIGINT, session_id BIGINT, title STRING, type STRING, created_at TIMESTAMP)": f"""
      SELECT position, o.id, o.session_id, o.title, o.type, o.created_at FROM (
        SELECT 0 AS position, anchor AS id UNION ALL {side('-', 'DESC', 'before')} UNION ALL {side('', 'ASC', 'after')}) t JOIN observations o ON o.id = t.id""",
        "get_memories(ids ARRAY<BIGINT>) RETURNS TABLE (id BIGINT, title STRING, type STRING, narrative STRING, raw_text STRING, created_at TIMESTAMP)": """
      SELECT id, title, type, narrative, raw_text, created_at FROM observations o WHERE array_contains(ids, o.id)""",
        "list_rules(project STRING, severity STRING, n INT) RETURNS TABLE (place INT, id BIGINT, title STRING, severity STRING, project_name STRING, created_at TIMESTAMP)": f"""
      SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY CASE l.severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, l.created_at DESC, l.id) AS INT) AS place,
        l.id, l.title, l.severity, p.name AS project_name, l.created_at FROM lessons l LEFT JOIN projects p ON p.id = l.project_id
        WHERE l.active AND (list_rules.project IS NULL OR p.name = list_rules.project) AND (list_rules.severity IS NULL OR l.severity = list_rules.severity))
      WHERE place <= least(n, {LIST_LIMIT})""",
    }


def register(spark: SparkSession, observations: DataFrame, projects: DataFrame, lessons: DataFrame) -> None:
    """Names for SQL: the views observations, projects and lessons, the scalar functions of ``udfs.register``, and a table function for each search and look-up:
    search_memory, search_rules, memory_timeline, get_memories and list_rules. Each answers one request; a null vector or a query without words leaves the other list, a null project is any.
    Tables of requests go through the functions of ``plans.search``, which answer all of them in one pass.
    """
    udfs.register(spark)
    for name, df in (("observations", observations), ("projects", projects), ("lessons", lessons)):
        df.createOrReplaceTempView(name)
    for head, body in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
