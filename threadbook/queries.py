"""One query for each operator over the mapped tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import NOW, TEXTS, Fixtures, with_tables
from .functions import columns as X
from .functions import udfs
from .operators import dims, fusion, ingest, lessons, reembedding, sessions, stats, text, text_index, vector
from .plans import search, sql
from .schemas import CAPTURED_TOOLS, FIELD_WEIGHTS, LESSON_WEIGHTS, LISTS, SKIPPED_TOOLS, TABLES, TOOL_CALL, schema
from .scratch import shared_dir
from .sources import tables, versions
from .streaming import streams

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.strip("_")
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def at(c: str = "created_at") -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def sat(c: str = "created_at") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c.rpartition('.')[2]}"


def joined(c: str) -> F.Column:
    return F.concat_ws("|", c).alias(c)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's declared columns, null where the mapping has none."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(TABLES[name]).fields])


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def tasks(x: Fixtures) -> int:
    """The test tables are single row groups."""
    return int(x.spark.conf.get("spark.sql.shuffle.partitions"))


def memory_tables(x: Fixtures) -> dict[str, DataFrame]:
    return {n: conform(getattr(x, {"embedding_models": "models"}.get(n, n)), n) for n in TABLES}


# ---------------------------------------------------------------- sources and sinks

_COUNTS = """SELECT 'embedding_models' AS name, (SELECT count(DISTINCT label) FROM embeddings) AS rows
UNION ALL SELECT 'lessons', count(*) FROM benchmark UNION ALL SELECT 'observations', count(*) FROM observations UNION ALL SELECT 'projects', count(*) FROM projects
UNION ALL SELECT 'queue', count(*) FROM events UNION ALL SELECT 'sessions', count(*) FROM sessions UNION ALL SELECT 'user_prompts', count(*) FROM conversations WHERE role = 'user'"""


@query(with_tables("observations projects sessions", _COUNTS))
def load_tables(x):
    root = shared_dir(x.spark)
    for name, df in memory_tables(x).items():
        df.write.parquet(f"{root}/{name}")
    held = tables.load_tables(x.spark, root)
    out = None
    for name, df in held.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_tables("observations projects sessions", f"SELECT name, name || '_bak_20240215_0930' AS copy, rows FROM ({_COUNTS})"))
def snapshot_tables(x):
    held = memory_tables(x)
    held["queue_bak_20240101_0000"] = held["queue"]
    return tables.snapshot_tables(held, shared_dir(x.spark), datetime(2024, 2, 15, 9, 30))


def _spooled(x, *times: int) -> str:
    """Payloads as JSON lines, written once for each of ``times``."""
    root = shared_dir(x.spark)
    for _ in times:
        x.queue.select(*schema(TOOL_CALL).names).write.mode("append").json(root)
    return root


@query(with_tables("queue", "SELECT session_id, tool_name, tool_input, cwd, last_user_message FROM queue"))
def read_tool_calls(x):
    return tables.read_tool_calls(x.spark, _spooled(x, 1)).select("session_id", "tool_name", "tool_input", "cwd", "last_user_message")


@query(with_tables("queue", "SELECT DISTINCT session_id, tool_name, tool_input, cwd, last_user_message FROM queue"))
def replay_spool(x):
    stream = tables.replay_spool(x.spark, _spooled(x, 1, 2))
    return _drained(stream).select("session_id", "tool_name", "tool_input", "cwd", "last_user_message")


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives once its input is used up."""
    spark, root = stream.sparkSession, shared_dir(stream.sparkSession)
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/rows")
    save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/rows")
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi").drop("batch")


_LEGACY = """SELECT id, title, subtitle, CASE WHEN type IN ('pattern', 'gotcha') THEN 'discovery' ELSE type END AS type,
  CASE WHEN id % 7 IN (0, 1) THEN '' ELSE array_to_string(facts, '|') END AS facts, 0 AS n_files,
  CASE WHEN id % 3 = 1 AND raw_text <> '' THEN raw_text ELSE concat_ws(chr(10), nullif(title, ''), nullif(subtitle, ''), nullif(narrative, '')) END AS raw_text, project, created_at FROM l"""
_L = "SELECT id, CASE WHEN id % 50 <> 0 THEN title END AS title, subtitle, type, narrative, facts, raw_text, 'src' || project_id AS project, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM observations"


@query(with_tables("observations", _LEGACY, l=_L))
def read_legacy_observations(x):
    out = tables.read_legacy_observations(x.legacy)
    return out.select("id", "title", "subtitle", "type", joined("facts"), (F.size("files_read") + F.size("files_modified")).alias("n_files"), "raw_text", "project", at())


@query(with_tables("observations", "SELECT memory_session_id, project, started_at FROM p QUALIFY row_number() OVER (PARTITION BY memory_session_id ORDER BY started_at, project) = 1", p="SELECT 'm' || session_id AS memory_session_id, 'src' || project_id AS project, strftime(min(created_at), '%Y-%m-%dT%H:%M:%SZ') AS started_at FROM observations GROUP BY ALL"))
def legacy_sessions(x):
    return tables.legacy_sessions(x.legacy)


@query(with_tables("observations", "SELECT project_id, count(*) AS n, CAST(sum(len(facts)) AS BIGINT) AS n_facts FROM observations GROUP BY 1"))
def append_observations(x):
    path = shared_dir(x.spark)
    for part in (0, 1):
        tables.append_observations(conform(x.rows, "observations").where(F.col("id") % 2 == part), path)
    return x.spark.read.schema(TABLES["observations"]).parquet(path).groupBy("project_id").agg(F.count("*").alias("n"), F.sum(F.size("facts")).alias("n_facts"))


_CONTENT = f"id, session_id, project_id, title, subtitle, type, narrative, array_to_string(facts, '|') AS facts, raw_text, tool_name, {sat()}, round(CAST(embedding[1] AS DOUBLE), 5) AS first, len(embedding) AS dimensions"


def _content(df: DataFrame) -> DataFrame:
    """What observations hold, by column."""
    return df.select("id", "session_id", "project_id", "title", "subtitle", "type", "narrative", joined("facts"), "raw_text", "tool_name", at(), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"), F.size("embedding").cast("long").alias("dimensions"))


@query(with_tables("observations", f"SELECT {_CONTENT} FROM observations"))
def appended_rows(x):
    path = shared_dir(x.spark)
    for part in (0, 1):
        tables.append_observations(conform(x.observations, "observations").where(F.col("id") % 2 == part), path)
    return _content(x.spark.read.schema(TABLES["observations"]).parquet(path))


@query(SQL["appended_rows"])
def loaded_rows(x):
    root = shared_dir(x.spark)
    for name, df in (memory_tables(x) | {"observations": conform(x.observations, "observations")}).items():
        df.write.parquet(f"{root}/{name}")
    return _content(tables.load_tables(x.spark, root)["observations"])


@query(SQL["appended_rows"])
def snapshot_rows(x):
    root = shared_dir(x.spark)
    tables.snapshot_tables({"observations": conform(x.observations, "observations")}, root, datetime(2024, 2, 15, 9, 30))
    return _content(x.spark.read.schema(TABLES["observations"]).parquet(f"{root}/observations_bak_20240215_0930"))


# ---------------------------------------------------------------- search, in parts

_VECTORS = {
    "v": "SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM observations WHERE embedding IS NOT NULL",
    "w": "SELECT query_id, text, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM queries",
    "s": "SELECT query_id, id, round(list_dot_product(w.v, v.v) / sqrt(list_dot_product(w.v, w.v)) / sqrt(list_dot_product(v.v, v.v)), 6) AS score FROM w, v",
}


def _vec(k: int, source: str = "s") -> dict[str, str]:
    return {"vec": f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM {source} QUALIFY rank < {k}"}


def _postings(weights: dict[str, float], source: str) -> dict[str, str]:
    stop = quoted(text.STOP_WORDS)
    union = " UNION ALL ".join(f"SELECT id, '{f}' AS field, CAST({w} AS DOUBLE) AS weight, regexp_extract_all(lower(coalesce({f}, '')), '[\\p{{L}}\\p{{N}}]+') AS words FROM {source}" for f, w in weights.items())
    return {
        "fields": union,
        "words": "SELECT id, field, weight, unnest(words) AS lexeme, generate_subscripts(words, 1) - 1 AS position FROM fields",
        "postings": f"SELECT lexeme, id, field, weight, count(*) AS tf, string_agg(position, ',' ORDER BY position) AS positions FROM words WHERE lexeme NOT IN ({stop}) GROUP BY ALL",
    }


_LEXEMES = {
    "ql": "SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS lexeme FROM queries",
    "qs": f"SELECT query_id, lexeme, count(*) OVER (PARTITION BY query_id) AS needed FROM ql WHERE lexeme NOT IN ({quoted(text.STOP_WORDS)})",
    "m": "SELECT query_id, id, round(sum(weight * (tf / (tf + CAST(1 AS DOUBLE)))), 6) AS score FROM postings JOIN qs USING (lexeme) GROUP BY query_id, id HAVING count(DISTINCT lexeme) = any_value(needed)",
}


def _fts(k: int) -> dict[str, str]:
    return {"fts": f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM m QUALIFY rank < {k}"}


_FUSED = {
    "lists": "SELECT query_id, id, rank, 0 AS src FROM vec UNION ALL SELECT query_id, id, rank, 1 FROM fts",
    "rrf": "SELECT query_id, id, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS rrf, min(src) AS src, arg_min(rank, src) AS src_rank FROM lists GROUP BY query_id, id",
}
_BOOSTED = {"boosted": f"SELECT r.query_id, r.id, r.rrf * (1 + exp(-greatest(epoch(TIMESTAMP '{NOW}' - o.created_at) / 86400, 0) / 10)) AS rrf, src, src_rank FROM rrf r JOIN observations o USING (id)"}


@query(with_tables("observations queries", "SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM vec", **_VECTORS, **_vec(20)))
def vector_topk(x):
    return vector.vector_topk(x.queries, x.observations, 20, "sql")


_ALL = "SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0"
_FLIP = "SELECT query_id, '' AS text, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM many"


def _many(x):
    """The query vectors of _ALL."""
    return x.read("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(with_tables("observations", "SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM vec", many=_ALL, **(_VECTORS | {"w": _FLIP}), **_vec(20)))
def vector_topk_matmul(x):
    return vector.vector_topk(_many(x), x.observations, 20, "matmul")


@query()
def ann_topk(x):
    return vector.ann_topk(_many(x), x.observations, 20)


@query()
def write_ann(x):
    path, model = shared_dir(x.spark), vector.fit_ann(x.observations)
    vector.write_ann(vector.build_ann(x.observations.where("id % 2 = 0"), model), path, model=model)
    vector.write_ann(vector.build_ann(x.observations.where("id % 2 = 1"), model), path, "append")
    return vector.ann_topk(_many(x), x.observations, 20, *vector.read_ann(x.spark, path))


@query(with_tables("observations", "SELECT lexeme, id, field, weight, tf, positions FROM postings", **_postings(FIELD_WEIGHTS, "observations")))
def build_postings(x):
    return text.build_postings(x.rows, tasks=tasks(x)).select("lexeme", "id", "field", "weight", "tf", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))).alias("positions"))


@query()
def build_postings_stemmed(x):
    return text.build_postings(x.rows, stem=True)


def _sought(x, first_words: int | None = None) -> DataFrame:
    """The postings that the queries look for: a search without a stored index builds no others."""
    return text.build_postings(x.rows, only=text.query_lexemes(x.queries, first_words), tasks=tasks(x))


@query(with_tables("observations queries", "SELECT query_id, id FROM m", **_postings(FIELD_WEIGHTS, "observations"), **_LEXEMES))
def fts_match(x):
    return text.fts_match(x.queries, _sought(x))


@query(with_tables("observations queries", "SELECT query_id, id, score FROM m", **_postings(FIELD_WEIGHTS, "observations"), **_LEXEMES))
def fts_rank(x):
    return text.fts_rank(x.queries, _sought(x))


@query(SQL["fts_rank"])
def write_postings(x):
    path = shared_dir(x.spark)
    text.write_postings(text.build_postings(x.rows, tasks=tasks(x)), path)
    return text.fts_rank(x.queries, text.read_postings(x.spark, path))


@query(SQL["build_postings"])
def text_index_follows(x):
    """Inserted in two parts, one of which is indexed with other texts first; what is not in the table is removed; then merged."""
    index = text_index.TextIndex(x.spark, shared_dir(x.spark))
    rows = x.rows.select("id", *FIELD_WEIGHTS)
    index.put(rows.where("id % 2 = 0"), fresh=True)
    index.put(rows.where("id % 2 = 1").withColumn("title", F.lit("an older title")), fresh=True)
    index.put(rows.where("id % 2 = 1"))
    index.put(rows.where("id < 100").withColumn("id", -F.col("id") - 1), fresh=True)
    index.remove(rows.where("id < 100").select((-F.col("id") - 1).alias("id")))
    index.merge((2, 5))
    return index.postings().select("lexeme", "id", "field", "weight", "tf", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))).alias("positions"))


_COVERS = {
    "h": "SELECT query_id, id, field, weight, lexeme, needed, position FROM words JOIN qs USING (lexeme)",
    "ok": "SELECT query_id, id, any_value(needed) AS needed FROM h GROUP BY query_id, id HAVING count(DISTINCT lexeme) = any_value(needed)",
    "ends": "SELECT query_id, id, field, weight, max(position) + 1000000 AS fin FROM h GROUP BY ALL",
    "offsets": "SELECT query_id, id, field, coalesce(sum(fin) OVER (PARTITION BY query_id, id ORDER BY weight DESC, field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ends",
    "spots": "SELECT query_id, id, lexeme, weight, position + off AS at FROM h JOIN ok USING (query_id, id) JOIN offsets USING (query_id, id, field)",
    "lasts": "SELECT a.query_id, a.id, a.at AS r, b.lexeme, max(b.at) AS last FROM spots a JOIN spots b ON a.query_id = b.query_id AND a.id = b.id AND b.at <= a.at GROUP BY ALL",
    "spans": "SELECT query_id, id, r, min(last) AS l FROM lasts JOIN ok USING (query_id, id) GROUP BY query_id, id, r HAVING count(*) = any_value(needed)",
    "covers": "SELECT query_id, id, l, min(r) AS r FROM spans GROUP BY query_id, id, l",
    "weighed": "SELECT c.query_id, c.id, l, r, avg(weight) AS w FROM covers c JOIN spots s ON s.query_id = c.query_id AND s.id = c.id AND s.at BETWEEN l AND r GROUP BY ALL",
}


@query(with_tables("observations queries", "SELECT query_id, id, round(sum(w / (r - l + 1)), 6) AS score FROM weighed GROUP BY query_id, id", **_postings(FIELD_WEIGHTS, "observations"), **_LEXEMES, **_COVERS))
def fts_cover_rank(x):
    return text.fts_cover_rank(x.queries, _sought(x, 10), first_words=10)


def _lists(x):
    vec = vector.vector_topk(x.queries, x.observations, 40)
    fts = text.fts_topk(x.queries, _sought(x), 40)
    return vec, fts


_PARTS = _VECTORS | _vec(40) | _postings(FIELD_WEIGHTS, "observations") | _LEXEMES | _fts(40) | _FUSED


@query(with_tables("observations queries", "SELECT query_id, id, round(rrf, 9) AS rrf, src, CAST(src_rank AS INTEGER) AS src_rank FROM rrf", **_PARTS))
def rrf_fuse(x):
    return fusion.rrf_fuse(*_lists(x)).withColumn("rrf", F.round("rrf", 9))


@query(with_tables("observations", f"SELECT id, round(1 + exp(-greatest(epoch(TIMESTAMP '{NOW}' - created_at) / 86400, 0) / 10), 6) AS boost FROM observations"))
def recency_boost(x):
    return fusion.recency_boost(x.rows.withColumn("boost", F.lit(1.0)), NOW, "boost").select("id", F.round("boost", 6).alias("boost"))


def _top(limit: int, source: str = "boosted") -> dict[str, str]:
    return {"top": f"SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, src, src_rank) AS INTEGER) AS rank, round(rrf, 4) AS score FROM {source} QUALIFY rank <= {limit}"}


_INDEX = f"SELECT query_id, rank, t.id, title, type, 'src' || project_id AS project_name, {sat()}, score FROM top t JOIN observations o ON o.id = t.id"


def _index(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "id", "title", "type", "project_name", at(), "score")


@query(with_tables("observations queries", _INDEX, **_PARTS, **_BOOSTED, **_top(20)))
def hybrid_search(x):
    return _index(search.hybrid_search(x.queries, x.observations, x.projects, NOW, tasks=tasks(x)))


@query(SQL["hybrid_search"])
def hybrid_search_stored(x):
    path = shared_dir(x.spark)
    text.write_postings(text.build_postings(x.rows, tasks=tasks(x)), path)
    return _index(search.hybrid_search(x.queries, x.observations, x.projects, NOW, postings=text.read_postings(x.spark, path)))


_NARROW = "project_id = 3 AND type IN ('decision', 'bugfix', 'refactor', 'pattern', 'gotcha') AND created_at >= TIMESTAMP '2024-01-02 00:00:00' AND created_at <= TIMESTAMP '2024-02-20 00:00:00'"


@query(with_tables("observations queries", _INDEX, o2=f"SELECT * FROM observations WHERE {_NARROW}", **(_VECTORS | {"v": "SELECT id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM o2 WHERE embedding IS NOT NULL"}), **_vec(20), **_postings(FIELD_WEIGHTS, "o2"), **_LEXEMES, **_fts(20), **_FUSED, **_BOOSTED, **_top(10)))
def hybrid_search_filtered(x):
    return _index(search.hybrid_search(x.queries, x.observations, x.projects, NOW, project="src3", types=("decision", "bugfix", "refactor", "pattern", "gotcha"), start="2024-01-02 00:00:00", end="2024-02-20 00:00:00", limit=10))


@query(with_tables("observations queries", "SELECT query_id, t.rank, t.id, raw_text, session_id, score FROM top t JOIN observations o ON o.id = t.id", **_VECTORS, **_vec(40), rrf="SELECT query_id, id, CAST(1 AS DOUBLE) / (60 + rank) AS rrf, 0 AS src, rank AS src_rank FROM vec", **_BOOSTED, **_top(20)))
def hybrid_search_vector_full(x):
    return search.hybrid_search(x.queries, x.observations, x.projects, NOW, mode="vector", cross_project=True, project="src1", full=True).select("query_id", "rank", "id", "raw_text", "session_id", "score")


@query(with_tables("observations queries", _INDEX, **_postings(FIELD_WEIGHTS, "observations"), **_LEXEMES, **_fts(40), rrf="SELECT query_id, id, CAST(1 AS DOUBLE) / (60 + rank) AS rrf, 0 AS src, rank AS src_rank FROM fts", **_BOOSTED, **_top(20)))
def fallback_search(x):
    return _index(search.fallback_search(x.queries, x.observations, x.projects, NOW))


_ASKED = "SELECT i - 1 AS query_id, t[i] AS text FROM (SELECT " + str(list(TEXTS)) + " AS t), range(1, 11) r(i)"


@query(with_tables("observations", _INDEX, queries=_ASKED, **_postings(FIELD_WEIGHTS, "observations"), **_LEXEMES, **_fts(40), rrf="SELECT query_id, id, CAST(1 AS DOUBLE) / (60 + rank) AS rrf, 0 AS src, rank AS src_rank FROM fts", **_BOOSTED, **_top(20)))
def sql_search(x):
    sql.register(x.spark, x.observations, x.projects, x.lessons_with_vectors)
    one = "SELECT CAST({i} AS BIGINT) AS query_id, * FROM search_memory('{t}', CAST(NULL AS ARRAY<FLOAT>), NULL, TIMESTAMP '{now}', 20)"
    return _index(x.spark.sql(" UNION ALL ".join(one.format(i=i, t=t, now=NOW) for i, t in enumerate(TEXTS))))


@query(with_tables("observations", f"SELECT id, title, {sat()} FROM observations o WHERE id IN (5, 42, 130)"))
def sql_get_memories(x):
    sql.register(x.spark, x.observations, x.projects, x.lessons_with_vectors)
    return x.spark.sql("SELECT id, title, created_at FROM get_memories(array(5, 42, 130, 42, -1))").select("id", "title", at())


@query(with_tables("observations", f"""SELECT position, id, title, {sat()} FROM (
  SELECT CAST(0 AS INTEGER) AS position, * FROM observations WHERE id = 42
  UNION ALL SELECT CAST(-row_number() OVER (ORDER BY o.created_at DESC, o.id) AS INTEGER), o.* FROM observations o JOIN observations a ON a.id = 42 AND o.session_id = a.session_id AND o.created_at < a.created_at
  UNION ALL SELECT CAST(row_number() OVER (ORDER BY o.created_at, o.id) AS INTEGER), o.* FROM observations o JOIN observations a ON a.id = 42 AND o.session_id = a.session_id AND o.created_at > a.created_at) o WHERE position BETWEEN -3 AND 3"""))
def sql_timeline(x):
    sql.register(x.spark, x.observations, x.projects, x.lessons_with_vectors)
    return x.spark.sql("SELECT position, id, title, created_at FROM memory_timeline(42, 3, 3)").select("position", "id", "title", at())


@query(with_tables("lessons projects", f"SELECT CAST(row_number() OVER (ORDER BY level, l.created_at DESC, l.id) AS INTEGER) AS place, l.id, title, severity, p.name AS project_name, {sat('l.created_at')} FROM lessons l LEFT JOIN projects p ON p.id = l.project_id WHERE active QUALIFY place <= 50"))
def sql_list_rules(x):
    sql.register(x.spark, x.observations, x.projects, x.lessons_with_vectors)
    return x.spark.sql("SELECT * FROM list_rules(NULL, NULL, 50)").select("place", "id", "title", "severity", "project_name", at())


_LESSON_PARTS = {
    "ls": "SELECT * FROM lessons WHERE active AND (project_id = 3 OR project_id IS NULL)",
    **(_VECTORS | {"v": "SELECT l.id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM ls l JOIN embeddings e ON e.vec_id = l.id"}),
    **_vec(20), **_postings(LESSON_WEIGHTS, "ls"), **_LEXEMES, **_fts(20), **_FUSED, **_top(10, "rrf"),
}


@query(with_tables("lessons queries", "SELECT query_id, rank, t.id, title, rule, severity, 'src' || project_id AS project_name, score FROM top t JOIN lessons l ON l.id = t.id", **_LESSON_PARTS))
def search_lessons(x):
    return search.search_lessons(x.queries, x.lessons_with_vectors, x.projects, "src3")


@query(with_tables("observations", "SELECT project_id AS query_id, CAST(to_json(list({'id': id, 'type': type} ORDER BY id)) AS VARCHAR) AS results FROM observations GROUP BY 1"))
def search_json(x):
    return tables.search_json(x.rows.select(F.col("project_id").alias("query_id"), F.col("id").alias("rank"), "id", "type"))


# ---------------------------------------------------------------- ingest


@query(with_tables("queue", f"SELECT id, tool_name FROM queue WHERE coalesce(tool_name, '') NOT IN ({quoted(SKIPPED_TOOLS)})"))
def skip_low_value(x):
    return ingest.skip_low_value(x.queue).select("id", "tool_name")


@query(with_tables("queue", f"SELECT id, tool_name FROM queue WHERE tool_name IN ({quoted(CAPTURED_TOOLS)})"))
def capture_allowlist(x):
    return ingest.capture_allowlist(x.queue).select("id", "tool_name")


@query(with_tables("queue", "SELECT id, tool_name FROM queue WHERE tool_name IN ('Edit', 'Write', 'Bash', 'NotebookEdit')"))
def lesson_checked(x):
    return ingest.lesson_checked(x.queue).select("id", "tool_name")


_PROJECT = "CASE WHEN coalesce(cwd, '') = '' THEN 'unknown' ELSE regexp_extract(rtrim(cwd, '/'), '[^/]*$') END"


@query(with_tables("queue", f"SELECT id, {_PROJECT} AS project FROM queue"))
def derive_project(x):
    return x.queue.select("id", X.derive_project("cwd").alias("project"))


@query("SELECT doc_id, substr(CASE WHEN doc_id % 10 = 0 THEN CAST(to_json({'doc_id': doc_id, 'lang': lang}) AS VARCHAR) ELSE text END, 1, 2000) AS preview FROM documents")
def truncate_preview(x):
    whole = F.when(F.col("doc_id") % 10 != 0, F.col("text"))
    return x.documents.select("doc_id", X.truncate_preview(whole, 2000, F.struct("doc_id", "lang")).alias("preview"))


@query(with_tables("queue", "SELECT id, coalesce(substr(CASE WHEN tool_name = 'Bash' THEN concat_ws(' ', event_type, props) WHEN tool_name IN ('Edit', 'Write') THEN concat_ws(' ', '/work/f' || id, substr(nullif(props, ''), 1, 500)) ELSE substr(tool_input, 1, 500) END, 1, 1000), '') AS preview FROM queue"))
def tool_input_preview(x):
    return x.queue.select("id", X.tool_input_preview("tool_name", "tool_input").alias("preview"))


@query(with_tables("queue", "SELECT id, concat_ws(chr(10) || chr(10), 'Working directory: ' || nullif(cwd, ''), 'User request: ' || substr(nullif(last_user_message, ''), 1, 500), 'Tool: ' || coalesce(tool_name, ''), 'Input: ' || substr(nullif(tool_input, ''), 1, 1500)) AS prompt FROM queue"))
def extraction_prompt(x):
    return x.queue.select("id", X.extraction_prompt().alias("prompt"))


def _answers(x) -> DataFrame:
    i, title = F.col("doc_id"), F.concat("lang", F.lit(" "), F.col("doc_id").cast("string"))
    whole = F.to_json(F.struct(F.lit(False).alias("skip"), title.alias("title"), F.array(F.col("source")).alias("facts")))
    answer = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(i % 4 == 1, '{"skip": true}').when(i % 4 == 2, F.concat(F.lit("oops "), title)).otherwise(F.concat(F.lit("  "), F.to_json(F.struct(title.alias("title")))))
    return x.documents.select("doc_id", answer.alias("answer"))


@query("SELECT doc_id, (['ok', 'skip', 'error', 'ok'])[1 + doc_id % 4] AS outcome, CASE WHEN doc_id % 4 IN (0, 3) THEN lang || ' ' || doc_id END AS title, CASE WHEN doc_id % 4 = 0 THEN source ELSE '' END AS facts FROM documents")
def parse_extraction(x):
    p = _answers(x).select("doc_id", X.parse_extraction("answer").alias("p"))
    return p.select("doc_id", "p.outcome", "p.data.title", F.concat_ws("|", "p.data.facts").alias("facts"))


@query(with_tables("observations", "SELECT id, CASE WHEN id % 50 = 0 THEN 'Untitled' ELSE title END AS title, CASE WHEN id % 5 = 0 THEN 'discovery' ELSE type END AS type, CASE WHEN id % 7 = 0 THEN 0 ELSE len(facts) END AS n_facts FROM observations"))
def observation_defaults(x):
    i = F.col("id")
    given = x.rows.withColumns({"title": F.when(i % 50 != 0, F.col("title")), "type": F.when(i % 5 != 0, F.col("type")), "facts": F.when(i % 7 != 0, F.col("facts"))})
    return ingest.observation_defaults(given).select("id", "title", "type", F.size("facts").cast("long").alias("n_facts"))


@query(with_tables("observations", "SELECT id, concat_ws(chr(10), title, nullif(subtitle, ''), nullif(narrative, ''), nullif(array_to_string(list_transform(facts, lambda f: '- ' || f), chr(10)), '')) AS raw_text FROM observations"))
def build_raw_text(x):
    return x.rows.select("id", X.build_raw_text().alias("raw_text"))


@query(with_tables("observations", f"SELECT id, title, type, 'src' || project_id AS project_name, array_to_string(facts, '|') AS facts, embedding IS NOT NULL AS has_embedding, {sat()} FROM observations o WHERE project_id = 3 ORDER BY o.created_at DESC, id LIMIT 50 OFFSET 2"))
def list_observations(x):
    page = ingest.list_observations(x.observations, x.projects, "src3", limit=50, offset=2)
    return page.select("id", "title", "type", "project_name", joined("facts"), "has_embedding", at())


@query(with_tables("observations", "SELECT id, CASE WHEN type IN ('pattern', 'gotcha') THEN 'discovery' ELSE type END AS type FROM observations"))
def normalize_type(x):
    return x.rows.select("id", X.normalize_type("type").alias("type"))


@query(with_tables("observations", "SELECT id, CASE WHEN id % 5 = 3 THEN NULL WHEN id % 5 = 4 THEN strftime(created_at - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS parsed FROM observations"))
def parse_legacy_ts(x):
    i, iso = F.col("id") % 5, F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(i == 0, F.concat(iso, F.lit("Z"))).when(i == 1, F.concat(iso, F.lit(".076Z"))).when(i == 2, iso).when(i == 3, "no time").otherwise(F.concat(iso, F.lit("+02:00")))
    return x.rows.select("id", F.date_format(X.parse_legacy_ts(given), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(with_tables("observations", "SELECT id % 11 <> 0 AND id % 50 <> 0 AS ok, count(*) AS n FROM observations GROUP BY 1"))
def validate_observations(x):
    i = F.col("id")
    given = x.rows.withColumns({"type": F.when(i % 11 == 0, "other").otherwise(F.col("type")), "title": F.when(i % 50 != 0, F.col("title"))})
    ok, rejects = ingest.validate_observations(given)
    return ok.select(F.lit(True).alias("ok")).unionByName(rejects.select(F.lit(False).alias("ok"))).groupBy("ok").agg(F.count("*").alias("n"))


@query(with_tables("lessons", "SELECT id, id % 7 <> 0 AND id % 7 <> 1 AS pattern_ok FROM lessons"))
def validate_trigger_pattern(x):
    given = x.lessons.withColumn("trigger_pattern", F.when(F.col("id") % 7 == 0, "(").when(F.col("id") % 7 == 1, F.repeat(F.lit("a"), 501)).otherwise(F.col("trigger_pattern")))
    return ingest.validate_trigger_pattern(given).select("id", "pattern_ok")


@query(with_tables("observations", "SELECT id, title, 'src' || project_id AS project_name, raw_text FROM observations WHERE id = 42"))
def get_observation(x):
    return ingest.get_observation(x.rows, x.projects, 42).select("id", "title", "project_name", "raw_text")


@query(with_tables("observations", f"SELECT id, {sat()} FROM observations o WHERE o.created_at >= TIMESTAMP '2024-01-03 00:00:00' AND o.created_at <= TIMESTAMP '2024-01-20 12:00:00'"))
def date_range(x):
    return ingest.date_range(x.rows, "2024-01-03 00:00:00", "2024-01-20 12:00:00").select("id", at())


@query(with_tables("observations", "SELECT id, length(raw_text) AS n FROM observations WHERE embedding IS NULL"))
def pending_embedding(x):
    return ingest.pending_embedding(x.observations).select("id", F.length("raw_text").cast("long").alias("n"))


@query(with_tables("queue outcomes", f"SELECT id, CASE WHEN outcome = 'ok' THEN 'done' WHEN outcome = 'skip' THEN 'skipped' WHEN retry_count >= 3 THEN 'failed' ELSE 'pending' END AS status, retry_count + CASE WHEN outcome = 'error' THEN 1 ELSE 0 END AS retry_count, '{NOW}' AS processed_at FROM queue JOIN outcomes USING (id)"))
def advance_queue(x):
    return ingest.advance_queue(x.queue, x.outcomes, NOW).select("id", "status", "retry_count", at("processed_at"))


@query(with_tables("queue outcomes", "SELECT id, CAST(retry_count + 1 AS INTEGER) AS retry_count FROM queue JOIN outcomes USING (id) WHERE outcome = 'error' AND retry_count < 3"))
def retry_failed(x):
    return streams.retry_failed(ingest.advance_queue(x.queue, x.outcomes, NOW)).select("id", "retry_count")


@query(with_tables("queue", "SELECT id, CASE WHEN user_id % 2 = 0 THEN user_id % 20 END AS project_id, CASE WHEN user_id % 2 = 1 THEN 'error' END AS outcome FROM queue"))
def resolve_session_project(x):
    known = x.read("events").select("user_id").distinct().where("user_id % 2 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("user_id").alias("id"), (F.col("user_id") % 20).alias("project_id"))
    return ingest.resolve_session_project(x.queue, known).select("id", "project_id", "outcome")


# ---------------------------------------------------------------- small tables


@query(with_tables("projects", "SELECT id, name, full_path FROM projects WHERE id < 10 UNION ALL SELECT 9 + row_number() OVER (ORDER BY name), name, full_path FROM projects WHERE id >= 10"))
def ensure_projects(x):
    return dims.ensure_projects(x.projects.where("id < 10"), x.projects.drop("id"))


_FIRST = "SELECT session_id, min(created_at) AS started_at, arg_min(event_id % 20, (created_at, event_id % 20)) AS project_id FROM (SELECT *, id AS event_id FROM queue) GROUP BY 1"


@query(with_tables("queue", f"SELECT user_id AS id, session_id, user_id % 20 AS project_id, '{NOW}' AS started_at FROM (SELECT DISTINCT user_id, session_id FROM queue WHERE user_id % 2 = 0) UNION ALL SELECT t.top + row_number() OVER (ORDER BY f.started_at, session_id), session_id, project_id, {sat('f.started_at')} FROM f, t WHERE session_id NOT IN (SELECT session_id FROM queue WHERE user_id % 2 = 0)", f=_FIRST, t="SELECT max(user_id) AS top FROM queue WHERE user_id % 2 = 0"))
def ensure_sessions(x):
    users = x.read("events").select("user_id").distinct().where("user_id % 2 = 0")
    held = users.select(F.col("user_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), (F.col("user_id") % 20).alias("project_id"), F.lit("agent").alias("agent_type"), F.lit("active").alias("status"), F.to_timestamp(F.lit(NOW)).alias("started_at"))
    events = x.queue.select("session_id", (F.col("id") % 20).alias("project_id"), F.lit("agent").alias("agent_type"), "created_at")
    return dims.ensure_sessions(held, events).select("id", "session_id", "project_id", at("started_at"))


@query(with_tables("sessions", "SELECT id, session_id, 'conflict' AS result FROM sessions WHERE id % 2 = 0 UNION ALL SELECT t.top + row_number() OVER (ORDER BY session_id), session_id, 'new' FROM sessions, t WHERE id % 2 = 1", t="SELECT max(id) AS top FROM sessions WHERE id % 2 = 0"))
def create_sessions(x):
    held = x.sessions.where("id % 2 = 0")
    new, conflicts = dims.create_sessions(held, x.sessions.select("session_id", "project_id"))
    return new.select("id", "session_id", F.lit("new").alias("result")).unionByName(conflicts.join(held, "session_id", "left_semi").join(held.select("session_id", "id"), "session_id").select("id", "session_id", F.lit("conflict").alias("result")))


@query(with_tables("sessions", f"SELECT session_id, CASE id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE status END AS status, CASE WHEN id % 4 IN (1, 2) THEN 'done ' || id END AS summary, CASE WHEN id % 4 = 0 THEN '{NOW}' END AS completed_at, CASE WHEN id % 4 = 3 THEN 'no fields' END AS reason FROM sessions UNION ALL SELECT 'nowhere', NULL, NULL, NULL, 'not found'"))
def update_sessions(x):
    new, refused = dims.update_sessions(x.sessions, _session_patches(x), NOW)
    return new.select("session_id", "status", "summary", at("completed_at")).join(refused, "session_id", "full")


def _session_patches(x):
    i = F.col("id") % 4
    status = F.when(i == 0, "completed").when(i == 1, "failed").otherwise("")
    patches = x.sessions.select("session_id", status.alias("status"), F.when(i.isin(1, 2), F.concat(F.lit("done "), F.col("id").cast("string"))).alias("summary"))
    return patches.unionByName(x.sessions.where("id = 0").select(F.lit("nowhere").alias("session_id"), F.lit("failed").alias("status"), F.lit("").alias("summary")))


@query(with_tables("lessons", "SELECT id, title, CASE WHEN id % 4 = 0 THEN 'new rule ' || id WHEN id % 4 = 1 THEN '' ELSE rule END AS rule, CASE WHEN id % 4 = 2 THEN 'info' ELSE severity END AS severity, CASE WHEN id % 4 = 0 THEN title || chr(10) || 'new rule ' || id ELSE raw_text END AS raw_text FROM lessons"))
def update_lessons(x):
    return dims.update_lessons(x.lessons_with_vectors, _lesson_patches(x)).select("id", "title", "rule", "severity", "raw_text")


def _lesson_patches(x):
    i, none = F.col("id") % 4, F.lit(None).cast("string")
    rule = F.when(i == 0, F.concat(F.lit("new rule "), F.col("id").cast("string"))).when(i == 1, "")
    return x.lessons.where("id % 4 < 3").select("id", none.alias("title"), rule.alias("rule"), F.when(i == 2, "info").alias("severity"), none.alias("trigger_tool"), none.alias("trigger_pattern"), F.lit(None).cast("boolean").alias("active"))


def _stored(x, name: str, rows: DataFrame, key: str = "id") -> versions.VersionedTable:
    """The table as the first version of one that changes."""
    held = versions.VersionedTable(x.spark, f"{shared_dir(x.spark)}/{name}", TABLES[name], key)
    held.append(conform(rows, name))
    return held


@query(SQL["update_lessons"])
def stored_lesson_patches(x):
    held, patches = _stored(x, "lessons", x.lessons_with_vectors), _lesson_patches(x)
    for part in (0, 1):
        versions.update_table(held, patches.where(F.col("id") % 2 == part), dims.update_lessons)
    return held.read().select("id", "title", "rule", "severity", "raw_text")


@query(with_tables("sessions", f"SELECT session_id, CASE id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE status END AS status, CASE WHEN id % 4 IN (1, 2) THEN 'done ' || id END AS summary, CASE WHEN id % 4 = 0 THEN '{NOW}' END AS completed_at FROM sessions"))
def stored_session_patches(x):
    held = _stored(x, "sessions", x.sessions, "session_id")
    versions.update_table(held, _session_patches(x), lambda rows, patches: dims.update_sessions(rows, patches, NOW)[0])
    return held.read().select("session_id", "status", "summary", at("completed_at"))


@query(SQL["advance_queue"])
def stored_queue_outcomes(x):
    held = _stored(x, "queue", x.queue)
    versions.update_table(held, x.outcomes, lambda rows, outcomes: ingest.advance_queue(rows, outcomes, NOW))
    return held.read().select("id", "status", "retry_count", at("processed_at"))


@query(SQL["ensure_projects"])
def stored_projects(x):
    held, ids = _stored(x, "projects", x.projects.where("id < 10")), versions.IdRanges(x.spark, f"{shared_dir(x.spark)}/ids", 10)
    versions.get_or_create(held, x.projects.drop("id"), "name", ids)
    return held.read().select("id", "name", "full_path")


@query("SELECT b.item_id AS id, count(e.event_id) AS trigger_count, strftime(max(e.ts), '%Y-%m-%d %H:%M:%S') AS last_triggered_at FROM benchmark b LEFT JOIN events e ON e.user_id % 40 = b.item_id GROUP BY 1")
def record_triggers(x):
    hits = x.read("events").select((F.col("user_id") % 40).alias("lesson_id"), F.col("ts").cast("timestamp").alias("at"))
    return dims.record_triggers(x.lessons, hits).select("id", "trigger_count", at("last_triggered_at"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE substr(text, 1, 80) END AS title, CASE WHEN doc_id % 4 = 0 THEN 'manual' ELSE source END AS project, 'manual-memories' AS session_id, 'discovery' AS type, text AS raw_text FROM documents")
def save_memories(x):
    i = F.col("doc_id")
    given = x.documents.select("doc_id", "text", F.when(i % 3 == 0, F.col("lang")).alias("title"), F.when(i % 4 != 0, F.col("source")).alias("project"))
    return dims.save_memories(given).select("doc_id", "title", "project", "session_id", "type", "raw_text")


@query("SELECT item_id, substr(text, 1, 80) AS title, CASE item_id % 2 WHEN 0 THEN 'warning' ELSE 'critical' END AS severity, CASE WHEN item_id % 3 <> 0 THEN 'p' || item_id END AS project, substr(text, 1, 80) || chr(10) || text AS raw_text, true AS active FROM benchmark")
def create_lessons(x):
    i = F.col("item_id")
    given = x.read("benchmark").select("item_id", F.col("text").alias("rule"), F.lit(None).cast("string").alias("title"), F.when(i % 2 == 0, "urgent").otherwise("critical").alias("severity"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("p"), i.cast("string"))).alias("project"))
    return dims.create_lessons(given).select("item_id", "title", "severity", "project", "raw_text", "active")


@query(SQL["build_raw_text"])
def create_observations(x):
    return dims.create_observations(x.rows.drop("raw_text")).select("id", "raw_text")


_NEW_PROJECTS = "SELECT name, 9 + row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT name FROM n WHERE name NOT IN (SELECT name FROM projects WHERE id < 10)) UNION ALL SELECT name, id FROM projects WHERE id < 10"


@query(with_tables("projects", "SELECT g.doc_id, g.title, p.id AS project_id, 1 AS session_key FROM g JOIN p ON p.name = g.name", g="SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE substr(text, 1, 80) END AS title, CASE WHEN doc_id % 4 = 0 THEN 'manual' ELSE source END AS name FROM documents", n="SELECT name FROM g", p=_NEW_PROJECTS))
def store_memories(x):
    i = F.col("doc_id")
    given = x.documents.select("doc_id", "text", F.when(i % 3 == 0, F.col("lang")).alias("title"), F.when(i % 4 != 0, F.col("source")).alias("project"))
    rows, _, _ = dims.store_memories(given, x.projects.where("id < 10"), conform(x.sessions.where("false"), "sessions"), NOW)
    return rows.select("doc_id", "title", "project_id", "session_key")


@query(with_tables("projects", "SELECT g.item_id, p.id AS project_id, g.pattern AS trigger_pattern, g.refused FROM g LEFT JOIN p ON p.name = g.name AND NOT g.refused", g="SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN 'p' || item_id END AS name, CASE item_id % 5 WHEN 0 THEN '(' WHEN 1 THEN 'a+' END AS pattern, item_id % 5 = 0 AS refused FROM benchmark", n="SELECT name FROM g WHERE name IS NOT NULL AND NOT refused", p=_NEW_PROJECTS))
def store_lessons(x):
    i = F.col("item_id")
    given = x.read("benchmark").select("item_id", F.col("text").alias("rule"), F.lit(None).cast("string").alias("title"), F.lit("info").alias("severity"), F.when(i % 3 != 0, F.concat(F.lit("p"), i.cast("string"))).alias("project"), F.when(i % 5 == 0, "(").when(i % 5 == 1, "a+").alias("trigger_pattern"))
    rows, _, refused = dims.store_lessons(given, x.projects.where("id < 10"), NOW)
    kept = rows.select("item_id", "project_id", "trigger_pattern", F.lit(False).alias("refused"))
    return kept.unionByName(refused.select("item_id", F.lit(None).cast("long").alias("project_id"), "trigger_pattern", F.lit(True).alias("refused")))


@query(with_tables("observations projects", "SELECT o.id, title, p.id AS project_id, dense_rank() OVER (ORDER BY 's' || session_id) AS session_key, o.id % 11 = 0 AS refused FROM o JOIN p ON p.name = o.name WHERE o.id % 11 <> 0 UNION ALL SELECT id, title, NULL, NULL, true FROM o WHERE id % 11 = 0", o="SELECT id, session_id, CASE WHEN id % 50 = 0 THEN 'Untitled' ELSE title END AS title, 'src' || project_id AS name FROM observations", n="SELECT name FROM o WHERE id % 11 <> 0", p=_NEW_PROJECTS))
def store_observations(x):
    i = F.col("id")
    given = x.rows.withColumns({"title": F.when(i % 50 != 0, F.col("title")), "type": F.when(i % 11 == 0, "other").otherwise(F.col("type")), "project": F.concat(F.lit("src"), F.col("project_id").cast("string")), "session_id": F.concat(F.lit("s"), F.col("session_id").cast("string"))}).drop("raw_text", "project_id")
    rows, _, _, rejects = dims.store_observations(given, x.projects.where("id < 10"), conform(x.sessions.where("false"), "sessions"), NOW)
    kept = rows.select("id", "title", "project_id", "session_key", F.lit(False).alias("refused"))
    return kept.unionByName(rejects.select("id", "title", F.lit(None).cast("long").alias("project_id"), F.lit(None).cast("long").alias("session_key"), F.lit(True).alias("refused")))


@query("SELECT CAST(label AS BIGINT) AS id, 'model-' || label AS model_name, label = 3 AS is_default, CASE WHEN label = 3 THEN 128 ELSE 64 END AS dimensions FROM (SELECT DISTINCT label FROM embeddings)")
def register_model(x):
    return dims.register_model(x.models, "model-3", 128).select("id", "model_name", "is_default", "dimensions")


@query("SELECT row_number() OVER (ORDER BY source, doc_id) + 100 AS id, doc_id FROM documents")
def assign_ids(x):
    return dims.assign_ids(x.documents.select("source", "doc_id"), ["source", "doc_id"], 100).select("id", "doc_id")


@query(with_tables("observations", "SELECT id, embedding IS NULL AS made, 64 AS dimensions FROM observations"))
def reembed(x):
    before = x.observations.withColumn("embedding_model_id", F.lit(1).cast("long"))
    out = dims.reembed(before, udfs.hashed_embedder(64), 2)
    return out.select("id", (F.col("embedding_model_id") == 2).alias("made"), F.size("embedding").alias("dimensions"))


@query(SQL["reembed"])
def stored_reembedding(x):
    before, ledger = x.observations.withColumn("embedding_model_id", F.lit(1).cast("long")), reembedding.EmbeddingLedger(x.spark, shared_dir(x.spark))
    out = reembedding.reembed_pages(before, ledger, udfs.hashed_embedder(64), 2)
    return out.select("id", (F.col("embedding_model_id") == 2).alias("made"), F.size("embedding").alias("dimensions"))


def _failing():
    """An embedder that fails on batches with a very long text."""
    inner = udfs.hashed_embedder(64)

    def load():
        model = inner()

        def run(texts):
            if any(len(t) > 10_000 for t in texts):
                raise ValueError("too long")
            return model(texts)

        return run

    return load


@query(with_tables("observations", "SELECT count(*) AS total, count(*) - count(*) FILTER (length(raw_text) > 10000) AS processed, count(*) FILTER (length(raw_text) > 10000) AS errors FROM observations WHERE embedding IS NULL"))
def reembed_progress(x):
    before = x.observations.withColumn("embedding_model_id", F.lit(1).cast("long"))
    return dims.reembed_progress(before, dims.reembed(before, _failing(), 2))


# ---------------------------------------------------------------- joins and lists


@query(with_tables("observations projects", "SELECT o.id, p.name AS project_name FROM observations o JOIN projects p ON p.id = o.project_id"))
def with_project(x):
    return ingest.with_project(x.rows, x.projects).select("id", "project_name")


@query(with_tables("lessons projects", "SELECT l.id, p.name AS project_name FROM lessons l LEFT JOIN projects p ON p.id = l.project_id"))
def with_optional_project(x):
    return ingest.with_optional_project(x.lessons, x.projects).select("id", "project_name")


@query(with_tables("observations", f"SELECT id, title, raw_text, array_to_string(facts, '|') AS facts, {sat()} FROM observations WHERE id IN (SELECT item_id * 3 FROM benchmark)"))
def get_observations(x):
    wanted = x.read("benchmark").select((F.col("item_id") * 3).alias("id"))
    return ingest.get_observations(x.rows, wanted.unionByName(wanted)).select("id", "title", "raw_text", joined("facts"), at())


_NEW = "SELECT l.* FROM legacy l WHERE NOT EXISTS (SELECT 1 FROM legacy e WHERE e.id % 2 = 0 AND e.title IS NOT DISTINCT FROM l.title AND e.created_at = l.created_at AND e.project = l.project)"


@query(with_tables("legacy", f"SELECT id, title, project, {sat()} FROM n", n=_NEW))
def legacy_new_rows(x):
    return ingest.legacy_new_rows(x.legacy_rows, x.legacy_rows.where("id % 2 = 0")).select("id", "title", "project", at())


@query(with_tables("legacy", "SELECT project, count(*) AS n FROM n GROUP BY 1", n=_NEW))
def legacy_new_by_project(x):
    return stats.legacy_new_by_project(x.legacy_rows, x.legacy_rows.where("id % 2 = 0"))


_HITS = """SELECT call_id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY level, l.id) AS INTEGER) AS rank, l.id AS lesson_id, severity, rule, p.name AS lesson_project
FROM calls c JOIN lessons l ON (l.trigger_tool IS NULL OR l.trigger_tool = c.tool_name) LEFT JOIN projects p ON p.id = l.project_id
WHERE l.active AND (l.project_id IS NULL OR p.name = c.project) AND (l.trigger_pattern IS NULL OR regexp_matches(c.preview, l.trigger_pattern, 'i')) QUALIFY rank <= 5"""


@query(with_tables("calls lessons projects", _HITS))
def match_lessons(x):
    return lessons.match_lessons(x.calls, x.lessons, x.projects)


@query(with_tables("calls lessons projects", "SELECT call_id, '## Active Lessons' || chr(10) || string_agg(upper(severity) || ' [' || coalesce(lesson_project, 'global') || ']: ' || rule, chr(10) ORDER BY rank) AS message FROM h GROUP BY 1", h=_HITS))
def format_lesson_hits(x):
    return lessons.format_lesson_hits(lessons.match_lessons(x.calls, x.lessons, x.projects))


@query(with_tables("lessons projects", f"SELECT l.id, title, severity, p.name AS project_name, {sat('l.created_at')} FROM lessons l LEFT JOIN projects p ON p.id = l.project_id WHERE active ORDER BY level, l.created_at DESC, l.id LIMIT 50"))
def list_lessons(x):
    return lessons.list_lessons(x.lessons, x.projects).select("id", "title", "severity", "project_name", at())


@query(with_tables("sessions", f"SELECT session_id, 'src' || project_id AS project_name, {sat('started_at')} FROM sessions s WHERE status = 'completed' ORDER BY s.started_at DESC, id LIMIT 100"))
def list_sessions(x):
    return sessions.list_sessions(x.sessions, x.projects, status="completed", limit=1000).select("session_id", "project_name", at("started_at"))


_AROUND = """SELECT anchor_id, 0 AS position, o.id, a.created_at FROM a JOIN o ON o.id = anchor_id
UNION ALL SELECT anchor_id, -row_number() OVER (PARTITION BY anchor_id ORDER BY o.created_at DESC, o.id) AS p, o.id, o.created_at FROM a JOIN o ON o.session_id = a.session_id AND o.created_at < a.created_at QUALIFY p >= -3
UNION ALL SELECT anchor_id, row_number() OVER (PARTITION BY anchor_id ORDER BY o.created_at, o.id) AS p, o.id, o.created_at FROM a JOIN o ON o.session_id = a.session_id AND o.created_at > a.created_at QUALIFY p <= 3"""
# times cut to days, so that rows of a session share them
_TIED = "SELECT * REPLACE (date_trunc('day', created_at) AS created_at) FROM observations"


@query(with_tables("observations", f"SELECT anchor_id, CAST(position AS INTEGER) AS position, id, {sat()} FROM t t0", o=_TIED, a="SELECT id AS anchor_id, session_id, created_at FROM o", t=_AROUND))
def timeline(x):
    tied = x.rows.withColumn("created_at", F.date_trunc("day", "created_at"))
    return sessions.timeline(tied, tied.select(F.col("id").alias("anchor_id"))).select("anchor_id", "position", "id", at())


@query(with_tables("observations queries", "SELECT b.query_id, anchor_id, CAST(position AS INTEGER) AS position, t.id FROM t JOIN b USING (anchor_id)", **_VECTORS, **_vec(1), b="SELECT query_id, id AS anchor_id FROM vec", o="SELECT * FROM observations", a="SELECT DISTINCT anchor_id, session_id, created_at FROM b JOIN o ON o.id = anchor_id", t=_AROUND))
def timeline_by_query(x):
    return search.timeline_by_query(x.observations, x.queries).select("query_id", "anchor_id", "position", "id")


_CONTEXT = {
    "rules": "SELECT l.id, project_id, l.created_at, upper(severity) || ' [' || coalesce(p.name, 'global') || ']: ' || rule AS line FROM lessons l LEFT JOIN projects p ON p.id = l.project_id WHERE active AND severity = 'critical'",
    "shared": "SELECT * FROM rules ORDER BY created_at DESC, id LIMIT 5",
    "own": "SELECT * FROM rules WHERE project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) <= 10",
    "every": "SELECT p.id AS project_id, 0 AS part, s.id, s.created_at, s.line FROM projects p, shared s UNION ALL SELECT project_id, 1, id, created_at, line FROM own WHERE id NOT IN (SELECT id FROM shared)",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY part, created_at DESC, id) AS n FROM every",
    "told": "SELECT project_id, '## Active Lessons' || chr(10) || string_agg('  ' || n || '. ' || line, chr(10) ORDER BY n) AS lessons FROM numbered GROUP BY 1",
    "last": "SELECT project_id, id, created_at, title, type FROM observations QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) <= 5",
    "placed": "SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id DESC) AS n FROM last",
    "recent": "SELECT project_id, count(*) AS k, string_agg('  ' || n || '. ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' [' || type || '] ' || title, chr(10) ORDER BY n) AS lines FROM placed GROUP BY 1",
}


@query(with_tables("observations lessons projects", "SELECT p.name AS project, concat_ws(chr(10) || chr(10), lessons, 'Recent memory for \"' || p.name || '\" (' || k || ' entries):' || chr(10) || lines) AS context FROM projects p LEFT JOIN told t ON t.project_id = p.id LEFT JOIN recent r ON r.project_id = p.id", **_CONTEXT))
def session_context(x):
    return search.session_context(x.rows, x.lessons, x.projects)


# ---------------------------------------------------------------- statistics


_STATUS = "(['pending', 'done', 'failed', 'skipped'])[1 + id % 4]"


def _mixed_queue(x) -> DataFrame:
    return x.queue.withColumn("status", F.element_at(F.array(*map(F.lit, ("pending", "done", "failed", "skipped"))), (F.col("id") % 4 + 1).cast("int")))


@query(with_tables("observations sessions projects queue", f"SELECT count(*) AS observations, count(embedding) AS with_embedding, count(*) - count(embedding) AS without_embedding, (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM queue WHERE {_STATUS} = 'pending') AS queue_pending, (SELECT count(*) FROM queue WHERE {_STATUS} = 'done') AS queue_done, (SELECT count(*) FROM queue WHERE {_STATUS} = 'failed') AS queue_failed FROM observations"))
def admin_stats(x):
    return stats.admin_stats(x.observations, x.sessions, x.projects, _mixed_queue(x))


@query(with_tables("observations", "SELECT type, count(*) AS n FROM observations GROUP BY 1"))
def count_by_type(x):
    return stats.count_by_type(x.rows)


@query(with_tables("observations projects", "SELECT p.name AS project_name, count(*) AS n FROM observations o JOIN projects p ON p.id = o.project_id GROUP BY 1"))
def count_by_project(x):
    return stats.count_by_project(x.rows, x.projects)


@query(with_tables("observations queue", f"SELECT count(*) AS pending, (SELECT count(*) FROM observations) AS observations FROM queue WHERE {_STATUS} = 'pending'"))
def queue_depth(x):
    return stats.queue_depth(_mixed_queue(x), x.rows)


@query(with_tables("outcomes", "SELECT CASE outcome WHEN 'ok' THEN 'migrated' WHEN 'skip' THEN 'skipped' ELSE 'errors' END AS outcome, count(*) AS n FROM outcomes GROUP BY 1"))
def import_summary(x):
    name = F.when(F.col("outcome") == "ok", "migrated").when(F.col("outcome") == "skip", "skipped").otherwise("errors")
    return stats.import_summary(x.outcomes.withColumn("outcome", name))


# ---------------------------------------------------------------- streams


def _stream(x, df: DataFrame, files: int = 3) -> DataFrame:
    """The rows as a stream of some files, a file a batch."""
    path = shared_dir(x.spark)
    df.repartition(files).write.parquet(path)
    return x.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _answer(prompt: str) -> str | None:
    """A stand-in for a model: the prompt's length decides between an answer, a skip and no answer."""
    if len(prompt) % 10 == 0:
        return None
    return '{"skip": true}' if len(prompt) % 10 == 1 else '```json\n{"title": "seen ' + str(len(prompt)) + '", "type": "change", "facts": ["a", "b"]}\n```'


@query(with_tables("queue", "SELECT 'done' AS status, 'change' AS type, 'seen ' || n || chr(10) || '- a' || chr(10) || '- b' AS raw_text, project, count(*) AS n FROM p WHERE n % 10 > 1 GROUP BY ALL UNION ALL SELECT CASE WHEN n % 10 = 1 THEN 'skipped' WHEN retry_count >= 3 THEN 'failed' ELSE 'pending' END, NULL, NULL, NULL, count(*) FROM p WHERE n % 10 < 2 GROUP BY 1 UNION ALL SELECT 'low value', NULL, NULL, NULL, count(*) FROM queue WHERE tool_name = 'TodoWrite'", p=f"SELECT *, length(concat_ws(chr(10) || chr(10), 'Working directory: ' || nullif(cwd, ''), 'User request: ' || last_user_message, 'Tool: ' || coalesce(tool_name, ''), 'Input: ' || substr(tool_input, 1, 1500))) AS n, {_PROJECT} AS project FROM queue WHERE coalesce(tool_name, '') <> 'TodoWrite'"))
def stream_observations(x):
    root = shared_dir(x.spark)
    streams.stream_observations(_stream(x, x.queue), _answer, f"{root}/sink", f"{root}/state", NOW).awaitTermination()
    made = x.spark.read.parquet(f"{root}/sink/observations").groupBy(F.lit("done").alias("status"), "type", "raw_text", "project").agg(F.count("*").alias("n"))
    after = x.spark.read.parquet(f"{root}/sink/queue").where("status <> 'done'")
    low = F.when(F.col("tool_name") == "TodoWrite", "low value").otherwise(F.col("status"))
    none = F.lit(None).cast("string")
    return made.unionByName(after.groupBy(low.alias("status")).agg(F.count("*").alias("n")).select("status", none.alias("type"), none.alias("raw_text"), none.alias("project"), "n"))


_WORKED = {
    "p": f"SELECT *, length(concat_ws(chr(10) || chr(10), 'Working directory: ' || nullif(cwd, ''), 'User request: ' || last_user_message, 'Tool: ' || coalesce(tool_name, ''), 'Input: ' || substr(tool_input, 1, 1500))) AS n FROM queue",
    "o": "SELECT *, CASE WHEN tool_name = 'TodoWrite' THEN 'skipped' WHEN user_id % 2 = 1 THEN 'failed' WHEN n % 10 = 1 THEN 'skipped' WHEN n % 10 IN (0, 2) THEN 'failed' ELSE 'done' END AS outcome FROM p",
}


@query(with_tables("queue", "SELECT id, outcome AS status, CASE WHEN outcome = 'failed' THEN greatest(retry_count + 1, 4) ELSE retry_count END AS retry_count, CASE WHEN outcome = 'done' THEN user_id % 20 END AS project_id, CASE WHEN outcome = 'done' THEN 'seen ' || n || chr(10) || '- a' || chr(10) || '- b' END AS raw_text FROM o", **_WORKED))
def stream_queue(x):
    """The queue worker with sessions, constraints and retries until every row is through."""
    root, odd = shared_dir(x.spark), F.col("user_id") % 2 == 1
    sessions = x.read("events").select("user_id").distinct().where(~odd).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("user_id").alias("id"), (F.col("user_id") % 20).alias("project_id"))

    def answer(prompt: str) -> str | None:  # one answer in ten has a type that the table does not take
        return '{"title": "t", "type": "rumour"}' if len(prompt) % 10 == 2 else _answer(prompt)

    streams.stream_observations(_stream(x, x.queue), answer, f"{root}/sink", f"{root}/state", NOW, sessions=sessions, retry=True).awaitTermination()
    streams.finish_retries(x.spark, x.queue.schema, answer, f"{root}/sink", NOW, sessions=sessions)
    after = x.spark.read.option("recursiveFileLookup", "true").schema(x.queue.schema).parquet(f"{root}/sink/queue")
    made = x.spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/sink/observations").select(F.col("queue_id").alias("id"), "project_id", "raw_text")
    return after.select("id", "status", "retry_count").join(made, "id", "left")


@query(with_tables("calls lessons projects", _HITS))
def stream_lesson_matches(x):
    root = shared_dir(x.spark)
    streams.stream_lesson_matches(_stream(x, x.calls), x.lessons, x.projects, f"{root}/sink", f"{root}/state").awaitTermination()
    return x.spark.read.parquet(f"{root}/sink").drop("batch")


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def dedup_replays(x):
    e = x.read("events").select("user_id", "event_type", "props", F.to_timestamp(F.lit(NOW)).alias("at"))
    return _drained(streams.dedup_replays(_stream(x, e.unionByName(e)), ["user_id", "event_type", "props"], "at")).select("user_id", "event_type", "props")


@query("SELECT user_id % 40 AS lesson_id, count(*) AS trigger_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_triggered_at FROM events GROUP BY 1")
def stream_trigger_counts(x):
    hits = x.read("events").select((F.col("user_id") % 40).alias("lesson_id"), F.col("ts").cast("timestamp").alias("at"))
    return _drained(streams.stream_trigger_counts(_stream(x, hits)), "complete").select("lesson_id", "trigger_count", at("last_triggered_at"))


@query("SELECT user_id AS session_id, strftime(min(ts) FILTER (event_type = 'click'), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts) FILTER (event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS completed_at, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'completed' ELSE 'active' END AS status FROM events GROUP BY 1")
def stream_session_state(x):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "end")
    events = x.read("events").select(F.col("user_id").alias("session_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    return _drained(streams.stream_session_state(_stream(x, events)), "complete").select("session_id", at("started_at"), at("completed_at"), "status")


_LIFE = """WITH s AS (SELECT user_id AS session_id, min(ts) FILTER (event_type = 'click') AS started, max(ts) FILTER (event_type = 'purchase') AS ended FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1),
w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events WHERE event_type IN ('click', 'purchase'))
SELECT session_id, CASE WHEN ended IS NOT NULL THEN 'completed' WHEN epoch_ms(started + INTERVAL 6 HOUR) < epoch_ms(mark) THEN 'failed' ELSE 'active' END AS status, strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(ended, '%Y-%m-%d %H:%M:%S') AS completed_at FROM s, w"""


@query(_LIFE)
def session_lifecycle(x):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "end")
    events = _stream(x, x.read("events").select(F.col("user_id").alias("session_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at")), 1)
    root = shared_dir(x.spark)
    save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
    streams.session_lifecycle(events).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return streams.latest_sessions(x.spark.read.parquet(f"{root}/rows")).select("session_id", "status", at("started_at"), at("completed_at"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def queue_throughput(x):
    events = x.read("events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("status"))
    return _drained(streams.queue_throughput(_stream(x, events, 1)), "complete").select(at("start"), "status", "n")


# ---------------------------------------------------------------- functions


@query("SELECT doc_id, 64 AS dimensions, NOT regexp_matches(coalesce(text, ''), '\\w') AS empty FROM documents")
def embed(x):
    out = udfs.embed(x.documents.select("doc_id", "text"), "text", load=udfs.hashed_embedder(64))
    return out.select("doc_id", F.coalesce(F.size("embedding"), F.lit(64)).alias("dimensions"), F.col("embedding").isNull().alias("empty"))


@query("SELECT doc_id, (['ok', 'skip', 'ok', 'ok'])[1 + doc_id % 4] AS outcome, CASE doc_id % 4 WHEN 1 THEN NULL WHEN 2 THEN 'second' ELSE lang || ' ' || doc_id END AS title FROM documents")
def extract(x):
    out = udfs.extract(_answers(x).withColumnRenamed("answer", "prompt"), lambda p: p, lambda p: '{"title": "second"}')
    return out.select("doc_id", "outcome", "data.title")


@query()
def stem(x):
    words = x.documents.select(F.explode(text.lexemes("text")).alias("word")).distinct()
    return words.select("word", udfs.stem("word").alias("stem"))


@query(with_tables("queue", f"SELECT id, {_PROJECT} AS project, round(CASE WHEN id % 9 = 0 THEN 1 ELSE 1 + exp(-greatest(id % 9 - 1, 0) / CAST(10 AS DOUBLE)) END, 6) AS boost FROM queue"))
def register(x):
    udfs.register(x.spark)
    x.queue.createOrReplaceTempView("threadbook_queue")
    return x.spark.sql("SELECT id, derive_project(cwd) AS project, round(recency(CASE WHEN id % 9 > 0 THEN CAST(id % 9 - 1 AS DOUBLE) END), 6) AS boost FROM threadbook_queue")
