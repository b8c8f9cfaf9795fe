"""The driver's tables as memory tables: the mapping of FIXTURES.md, for DataFrames and for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import OBSERVATION_TYPES, SEVERITIES

NOW = "2024-02-15 00:00:00"
TEXTS = ("thble thing", "ertion", "the", "thing", "ering thing", "tion", "of the thing", "onering", "thble", "the ed thing")


def _pick(values, i) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


class Fixtures:
    """Each table as a DataFrame over the files below ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{table}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def projects(self) -> DataFrame:
        return self.documents.select("source").distinct().select(F.expr("cast(substring(source, 4) as bigint)").alias("id"), F.col("source").alias("name"), F.concat(F.lit("/work/"), "source").alias("full_path"))

    @cached_property
    def rows(self) -> DataFrame:
        """Observations without vectors."""
        i, text = F.col("doc_id"), F.col("text")
        return self.documents.select(
            i.alias("id"),
            ((i % 20) * 3 + i % 3).alias("session_id"),
            (i % 20).alias("project_id"),
            F.substring(text, 1, 80).alias("title"),
            F.when(i % 3 == 0, F.col("lang")).alias("subtitle"),
            _pick(OBSERVATION_TYPES, i % 8).alias("type"),
            F.substring(text, 81, 400).alias("narrative"),
            F.slice(F.split(text, "\n"), 2, 2).alias("facts"),
            text.alias("raw_text"),
            _pick(("Bash", "Edit", "Write", "Read"), i % 4).alias("tool_name"),
            F.expr("timestampadd(HOUR, doc_id, timestamp'2024-01-01 00:00:00')").alias("created_at"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        vectors = self.read("embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return self.rows.join(vectors, "id", "left")

    @cached_property
    def sessions(self) -> DataFrame:
        s = self.rows.groupBy("session_id").agg(F.min("created_at").alias("started_at"), F.min("project_id").alias("project_id"))
        return s.select(F.col("session_id").alias("id"), F.concat(F.lit("s"), F.col("session_id").cast("string")).alias("session_id"), "project_id", _pick(("completed", "failed", "active"), F.col("session_id") % 3).alias("status"), "started_at", F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("summary"))

    @cached_property
    def queue(self) -> DataFrame:
        tool = F.create_map(*[F.lit(x) for p in (("click", "Bash"), ("view", "Read"), ("purchase", "Edit"), ("error", "Write"), ("signup", "TodoWrite")) for x in p])
        said = F.concat_ws(" ", "event_type", "props")
        given = F.to_json(F.struct(said.alias("command"), F.concat(F.lit("/work/f"), F.col("event_id").cast("string")).alias("file_path"), F.col("props").alias("new_string")))
        cwd = F.concat(F.lit("/work/src"), (F.col("user_id") % 20).cast("string"))
        i = F.col("event_id")
        return self.read("events").select(
            i.alias("id"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
            F.try_element_at(tool, F.col("event_type")).alias("tool_name"),
            given.alias("tool_input"),
            F.lit(None).cast("string").alias("tool_response_preview"),
            F.when(i % 7 == 1, F.concat(cwd, F.lit("/"))).when(i % 7 == 2, "/").when(i % 7 == 3, "").when(i % 7 != 4, cwd).alias("cwd"),
            F.when(i % 3 == 0, F.concat(F.lit("please "), F.col("event_type"))).alias("last_user_message"),
            F.lit("pending").alias("status"),
            (i % 5).cast("int").alias("retry_count"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.lit(None).cast("timestamp").alias("processed_at"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        i = F.col("event_id") % 10
        return self.read("events").select(F.col("event_id").alias("id"), F.when(i == 0, "error").when(i == 1, "skip").otherwise("ok").alias("outcome"))

    @cached_property
    def calls(self) -> DataFrame:
        q = self.queue.join(self.read("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("p"), F.concat_ws(" ", "event_type", "props").alias("preview")), "id")
        return q.select(F.col("id").alias("call_id"), "tool_name", F.concat(F.lit("src"), F.col("p").cast("string")).alias("project"), "preview")

    @cached_property
    def lessons(self) -> DataFrame:
        i = F.col("item_id")
        digits = F.concat(F.lit('"K": ['), (i % 10).cast("string"), (i * 3 % 10).cast("string"), F.lit("][0-9]"))
        return self.read("benchmark").select(
            i.alias("id"),
            F.when(i % 2 == 1, i % 20).alias("project_id"),
            F.substring("text", 1, 80).alias("title"),
            F.col("text").alias("rule"),
            _pick(SEVERITIES, i % 3).alias("severity"),
            _pick((None, "Bash", "Edit", "Write", "Read"), i % 5).cast("string").alias("trigger_tool"),
            F.when(i % 3 == 0, "PURCHASE|ERROR").when(i % 11 != 1, digits).alias("trigger_pattern"),
            F.concat_ws("\n", F.substring("text", 1, 80), "text").alias("raw_text"),
            F.lit(0).cast("long").alias("trigger_count"),
            F.lit(None).cast("timestamp").alias("last_triggered_at"),
            (i % 13 != 12).alias("active"),
            F.expr("timestampadd(DAY, item_id, timestamp'2024-01-01 00:00:00')").alias("created_at"),
        )

    @cached_property
    def lessons_with_vectors(self) -> DataFrame:
        return self.lessons.join(self.read("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")

    @cached_property
    def legacy(self) -> DataFrame:
        """Rows of the older store: lists as JSON text, every seventh broken, times as text."""
        i = F.col("id")
        facts = F.when(i % 7 == 0, "oops").when(i % 7 != 1, F.to_json("facts"))
        return self.rows.select("id", F.when(i % 50 != 0, F.col("title")).alias("title"), "subtitle", "type", "narrative", facts.alias("facts"), F.lit("[]").alias("concepts"), F.lit(None).cast("string").alias("files_read"), F.lit("").alias("files_modified"), F.when(i % 3 == 1, F.col("raw_text")).when(i % 3 == 2, "").alias("text"), F.concat(F.lit("src"), F.col("project_id").cast("string")).alias("project"), F.concat(F.lit("m"), F.col("session_id").cast("string")).alias("memory_session_id"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))

    @cached_property
    def legacy_rows(self) -> DataFrame:
        i = F.col("id")
        return self.rows.select("id", F.when(i % 50 != 0, F.col("title")).alias("title"), F.concat(F.lit("src"), F.col("project_id").cast("string")).alias("project"), "created_at")

    @cached_property
    def queries(self) -> DataFrame:
        stated = self.read("embeddings").where(F.col("vec_id") % 100 == 0)  # the stated query set
        return stated.select(F.col("vec_id").alias("query_id"), _pick(TEXTS, F.floor(F.col("vec_id") / 100) % len(TEXTS)).alias("text"), F.col("embedding").alias("vector"))

    @cached_property
    def models(self) -> DataFrame:
        m = self.read("embeddings").groupBy("label").agg(F.max(F.size("embedding")).cast("int").alias("dimensions"))
        return m.select(F.col("label").cast("long").alias("id"), F.concat(F.lit("model-"), F.col("label").cast("string")).alias("model_name"), "dimensions", F.lit("local").alias("provider"), (F.col("label") % 2 == 0).alias("is_default"))

    @cached_property
    def user_prompts(self) -> DataFrame:
        c = self.read("conversations").where("role = 'user'")
        return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("prompt_number"), F.col("text").alias("prompt_text"))


# ---------------------------------------------------------------- the same in SQL


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


CTES = {
    "projects": "SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS name, '/work/' || source AS full_path FROM documents",
    "observations": f"""SELECT d.doc_id AS id, (d.doc_id % 20) * 3 + d.doc_id % 3 AS session_id, d.doc_id % 20 AS project_id,
  substr(d.text, 1, 80) AS title, CASE WHEN d.doc_id % 3 = 0 THEN d.lang END AS subtitle, ({_list(OBSERVATION_TYPES)})[1 + d.doc_id % 8] AS type,
  substr(d.text, 81, 400) AS narrative, list_slice(string_split(d.text, chr(10)), 2, 3) AS facts, d.text AS raw_text,
  (['Bash', 'Edit', 'Write', 'Read'])[1 + d.doc_id % 4] AS tool_name, TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) AS created_at, e.embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "sessions": """SELECT session_id AS id, 's' || session_id AS session_id, min(project_id) AS project_id, (['completed', 'failed', 'active'])[1 + session_id % 3] AS status,
  min(created_at) AS started_at FROM observations GROUP BY session_id""",
    "queue": """SELECT event_id AS id, 'u' || user_id AS session_id, CASE event_type WHEN 'click' THEN 'Bash' WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'error' THEN 'Write' WHEN 'signup' THEN 'TodoWrite' END AS tool_name,
  CAST(to_json({'command': concat_ws(' ', event_type, props), 'file_path': '/work/f' || event_id, 'new_string': props}) AS VARCHAR) AS tool_input,
  CASE event_id % 7 WHEN 1 THEN '/work/src' || (user_id % 20) || '/' WHEN 2 THEN '/' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE '/work/src' || (user_id % 20) END AS cwd,
  CASE WHEN event_id % 3 = 0 THEN 'please ' || event_type END AS last_user_message, 'pending' AS status, CAST(event_id % 5 AS INTEGER) AS retry_count, ts AS created_at, user_id, event_type, props FROM events""",
    "outcomes": "SELECT event_id AS id, CASE event_id % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'skip' ELSE 'ok' END AS outcome FROM events",
    "calls": "SELECT id AS call_id, tool_name, 'src' || (user_id % 20) AS project, concat_ws(' ', event_type, props) AS preview FROM queue",
    "lessons": f"""SELECT item_id AS id, CASE WHEN item_id % 2 = 1 THEN item_id % 20 END AS project_id, substr(text, 1, 80) AS title, text AS rule, ({_list(SEVERITIES)})[1 + item_id % 3] AS severity, item_id % 3 AS level,
  ([NULL, 'Bash', 'Edit', 'Write', 'Read'])[1 + item_id % 5] AS trigger_tool,
  CASE WHEN item_id % 3 = 0 THEN 'PURCHASE|ERROR' WHEN item_id % 11 <> 1 THEN '"K": [' || (item_id % 10) || (item_id * 3 % 10) || '][0-9]' END AS trigger_pattern,
  substr(text, 1, 80) || chr(10) || text AS raw_text, item_id % 13 <> 12 AS active, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(item_id AS INTEGER)) AS created_at FROM benchmark""",
    "legacy": "SELECT id, CASE WHEN id % 50 <> 0 THEN title END AS title, 'src' || project_id AS project, created_at FROM observations",
    "queries": f"SELECT vec_id AS query_id, ({_list(TEXTS)})[1 + (vec_id // 100) % {len(TEXTS)}] AS text, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0",
}
NEEDS = {"sessions": ["observations"], "legacy": ["observations"], "calls": ["queue"]}


def with_tables(names: str, body: str, **more: str) -> str:
    """``body`` below the named tables and those that they need, then ``more`` in order."""
    order: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    ctes = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
