"""Retrieval plans: hybrid search, lesson search, time lines around a query, and the context of a new session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import fusion, text
from ..operators.ingest import date_range, with_optional_project, with_project
from ..operators.sessions import timeline
from ..operators.vector import vector_topk
from ..schemas import FIELD_WEIGHTS, LESSON_WEIGHTS

MAX_LIMIT = 100


@dataclass(frozen=True)
class Search:
    """What to look at, and how. ``types`` is one value or several; ``cross_project`` switches the project filter off."""

    mode: str = "hybrid"
    project: str | None = None
    cross_project: bool = False
    types: tuple[str, ...] | str | None = None
    start: str | None = None
    end: str | None = None
    limit: int = 20
    cover: bool = False
    stem: bool = False
    first_words: int | None = None
    #: Tasks that texts are dealt to where there is no index, for tables in few row groups.
    tasks: int | None = None


def _filtered(obs: DataFrame, projects: DataFrame, s: Search) -> DataFrame:
    out = with_project(obs, projects)
    if s.project is not None and not s.cross_project:
        out = out.where(F.col("project_name") == s.project)
    if s.types:
        out = out.where(F.col("type").isin(*([s.types] if isinstance(s.types, str) else s.types)))
    return date_range(out, s.start, s.end)


def _branches(queries: DataFrame, corpus: DataFrame, weights: dict[str, float], s: Search, k: int, postings: DataFrame | None) -> list[DataFrame]:
    out = []
    if s.mode in ("hybrid", "vector") and "embedding" in corpus.columns:
        out.append(vector_topk(queries, corpus, k))
    if s.mode in ("hybrid", "fts"):
        index = text.build_postings(corpus, weights, s.stem, only=text.query_lexemes(queries, s.first_words), tasks=s.tasks) if postings is None else postings
        within = None if postings is None else corpus.select("id")  # the lexemes have cut the index to its hits
        out.append(text.fts_topk(queries, index, k, s.first_words, s.stem, s.cover, within))
    return out


def hybrid_search(queries: DataFrame, obs: DataFrame, projects: DataFrame, now: str, search: Search | None = None, postings: DataFrame | None = None, full: bool = False, **options) -> DataFrame:
    """Answers queries (query_id, text, vector): vector and text top 2 * limit, fused by reciprocal rank, recent rows boosted, the best ``limit`` of
    each query with rank from 1 and score to four digits. Modes hybrid, vector and fts; any other gives nothing.

    Both branches rank ids alone; title, type, project and time (or the whole row, with ``full``) are fetched for the winners. A corpus
    without vectors, or all of them null, leaves the text results. ``postings`` is a prepared index of the same rows.
    """
    s = search or Search(**options)
    limit = min(s.limit, MAX_LIMIT)
    rows = _filtered(obs, projects, s)
    lists = _branches(queries, rows, FIELD_WEIGHTS, s, 2 * limit, postings)
    columns = [c for c in rows.columns if c != "embedding"] if full else ["id", "title", "type", "project_name", "created_at"]
    wanted = rows.select(*columns)
    if not lists:
        empty = queries.where("false").select("query_id", F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
        return empty.join(wanted.where("false")).select("query_id", "rank", *columns, "score")
    fused = fusion.rrf_fuse(*lists).join(rows.select("id", "created_at"), "id")
    boosted = fusion.recency_boost(fused, now)
    best = W.partitionBy("query_id").orderBy(F.desc("rrf"), "src", "src_rank")
    top = boosted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "id", "rank", F.round("rrf", 4).alias("score"))
    return top.join(wanted, "id").select("query_id", "rank", *columns, "score")


def fallback_search(queries: DataFrame, obs: DataFrame, projects: DataFrame, now: str, **options) -> DataFrame:
    """Search over rows whose vectors cannot be used: the text branch answers alone."""
    return hybrid_search(queries, obs.withColumn("embedding", F.lit(None).cast("array<float>")), projects, now, **options)


def search_lessons(queries: DataFrame, lessons: DataFrame, projects: DataFrame, project: str | None = None, limit: int = 10, stem: bool = False) -> DataFrame:
    """As hybrid search, over active lessons of the project or global ones, without the boost."""
    rows = with_optional_project(lessons.where("active"), projects)
    if project is not None:
        rows = rows.where((F.col("project_name") == project) | F.col("project_id").isNull())
    limit = min(limit, 50)
    lists = _branches(queries, rows, LESSON_WEIGHTS, Search(stem=stem), 2 * limit, None)
    best = W.partitionBy("query_id").orderBy(F.desc("rrf"), "src", "src_rank")
    top = fusion.rrf_fuse(*lists).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return top.join(rows.select("id", "title", "rule", "severity", "project_name"), "id").select("query_id", "rank", "id", "title", "rule", "severity", "project_name", F.round("rrf", 4).alias("score"))


def timeline_by_query(obs: DataFrame, queries: DataFrame, before: int = 3, after: int = 3, project_ids: tuple[int, ...] | None = None) -> DataFrame:
    """The time line around each query's most similar observation. ``project_ids`` narrows where it is looked for."""
    corpus = obs if project_ids is None else obs.where(F.col("project_id").isin(*project_ids))
    top = vector_topk(queries, corpus, 1).select("query_id", F.col("id").alias("anchor_id"))
    return top.join(timeline(obs, top.select("anchor_id"), before, after), "anchor_id")


def session_context(obs: DataFrame, lessons: DataFrame, projects: DataFrame, recent: int = 5, own: int = 10, overall: int = 5) -> DataFrame:
    """What a new session of each project is told: critical lessons (the overall top and the project's own, each once) and the last observations,
    oldest first, as one text.
    """
    newest = lambda *keys: W.partitionBy(*keys).orderBy(F.desc("created_at"), "id")
    rules = with_optional_project(lessons.where("active and severity = 'critical'"), projects)
    scope = F.coalesce("project_name", F.lit("global"))
    line = F.concat(F.upper("severity"), F.lit(" ["), scope, F.lit("]: "), F.col("rule"))
    top_all = rules.orderBy(F.desc("created_at"), "id").limit(overall).select("id", "created_at", line.alias("line"))
    shared = top_all.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("o"), "id", "line"))).alias("shared"))  # ``overall`` lines
    mine = rules.where("project_id is not null").withColumn("n", F.row_number().over(newest("project_id"))).where(F.col("n") <= own)
    mine = mine.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("o"), "id", line.alias("line")))).alias("mine"))
    last = obs.withColumn("n", F.row_number().over(newest("project_id"))).where(F.col("n") <= recent)
    said = F.concat(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.col("type"), F.lit("] "), F.col("title"))
    last = last.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("created_at", (-F.col("id")).alias("o"), said.alias("line")))).alias("last"))
    out = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")).join(mine, "project_id", "left").join(last, "project_id", "left").join(F.broadcast(shared))
    none = F.array().cast("array<struct<o:bigint,id:bigint,line:string>>")
    known = F.transform("shared", lambda x: x["id"])
    both = F.concat(F.coalesce("shared", none), F.filter(F.coalesce("mine", none), lambda x: ~F.array_contains(known, x["id"])))
    numbered = lambda a: F.concat_ws("\n", F.transform(a, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["line"])))
    heading = F.concat(F.lit('Recent memory for "'), F.col("project"), F.lit('" ('), F.size("last").cast("string"), F.lit(" entries):"))
    parts = (F.when(F.size(both) > 0, F.concat_ws("\n", F.lit("## Active Lessons"), numbered(both))), F.when(F.size("last") > 0, F.concat_ws("\n", heading, numbered(F.col("last")))))
    return out.select("project", F.concat_ws("\n\n", *parts).alias("context"))
