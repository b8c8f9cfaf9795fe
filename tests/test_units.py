"""Pinned cases, one by one."""

import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from threadbook.functions import columns as X
from threadbook.functions import udfs
from threadbook.operators import dims, fusion, ingest, lessons, sessions, text, vector
from threadbook.plans import search
from threadbook.queries import QUERIES
from threadbook.sources import tables
from threadbook.streaming import streams

T0 = datetime(2024, 2, 15)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# ---------------------------------------------------------------- fusion


@pytest.mark.parametrize(
    ("vec", "fts", "days", "expected"),
    [([0], [], None, 0.0167), ([0], [0], None, 0.0333), ([0], [2], None, 0.0328), ([0], [2], 10, 0.0449), ([0], [0], 0, 0.0667)],
)
def test_fusion(spark, vec, fts, days, expected):
    rows = lambda ranks: spark.createDataFrame([(1, 7, r) for r in ranks], "query_id long, id long, rank int")
    fused = fusion.rrf_fuse(rows(vec), rows(fts))
    if days is not None:
        fused = fusion.recency_boost(fused.withColumn("created_at", F.expr(f"timestampadd(DAY, -{days}, timestamp'2024-02-15')")), "2024-02-15 00:00:00")
    assert values(fused.select(F.round("rrf", 4).alias("x")), "x") == [(expected,)]


@pytest.mark.parametrize(("days", "expected"), [(0, 2.0), (7, 1.4966), (10, 1.3679), (30, 1.0498), (90, 1.0001), (-5, 2.0), (None, 1.0)])
def test_boost(spark, days, expected):
    at = F.lit(None).cast("timestamp") if days is None else F.expr(f"timestampadd(DAY, {-days}, timestamp'2024-02-15')")
    df = spark.range(1).withColumn("created_at", at).withColumn("b", F.lit(1.0))
    assert round(fusion.recency_boost(df, "2024-02-15 00:00:00", "b").first().b, 4) == expected


def _small_corpus(spark):
    obs = spark.createDataFrame([(1, 1, "alpha beta", None, "gamma", "alpha beta gamma", [1.0, 0.0], "bugfix", T0), (2, 1, "beta", None, None, "beta delta", [0.9, 0.1], "feature", T0), (3, 2, "alpha", None, None, "alpha alpha", None, "bugfix", T0)], "id long, project_id long, title string, subtitle string, narrative string, raw_text string, embedding array<float>, type string, created_at timestamp")
    projects = spark.createDataFrame([(1, "p"), (2, "q")], "id long, name string")
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0])], "query_id long, text string, vector array<float>")
    return queries, obs, projects


def test_modes(spark):
    queries, obs, projects = _small_corpus(spark)
    ids = lambda **o: [r.id for r in search.hybrid_search(queries, obs, projects, "2024-02-15 00:00:00", **o).orderBy("rank").collect()]
    assert ids(mode="vector") == [1, 2] and sorted(ids(mode="fts")) == [1, 3] and ids(mode="other") == []
    assert ids()[0] == 1 and sorted(ids()) == [1, 2, 3]
    assert ids(project="q") == [3] and len(ids(project="q", cross_project=True)) == 3
    assert ids(types="feature") == [2] and ids(start="2024-02-16 00:00:00") == []
    assert ids(limit=1) == [1]
    # vector first among equal scores
    a = spark.createDataFrame([(1, 10, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 5, 1)], "query_id long, id long, rank int")
    assert values(fusion.rrf_fuse(a, b).orderBy(F.desc("rrf"), "src", "src_rank"), "id") == [(10,), (5,)]


def test_search_falls_back_and_uses_an_index(spark):
    queries, obs, projects = _small_corpus(spark)
    fall = search.fallback_search(queries, obs, projects, "2024-02-15 00:00:00")
    assert sorted(values(fall, "id")) == [(1,), (3,)]
    index = text.build_postings(obs)
    a = search.hybrid_search(queries, obs, projects, "2024-02-15 00:00:00", postings=index, mode="fts")
    b = search.hybrid_search(queries, obs, projects, "2024-02-15 00:00:00", mode="fts")
    assert sorted(a.collect()) == sorted(b.collect())


# ---------------------------------------------------------------- text


def test_stems():
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit operator:oper triplicate:triplic hopeful:hope goodness:good revival:reviv adjustment:adjust adoption:adopt probate:probat rate:rate controll:control roll:roll"
    for p in pairs.split():
        word, stem = p.split(":")
        assert udfs.stem_word(word) == stem, word


#: Their signed counts cancel out, in 64 numbers.
CANCEL = "house window"


def test_a_text_with_words_has_a_vector(spark):
    made = udfs.embed(spark.createDataFrame(list(enumerate([CANCEL, "word", "..."])), "id long, raw_text string"), load=udfs.hashed_embedder(64))
    assert {r.id: r.embedding and len(r.embedding) for r in made.collect()} == {0: 64, 1: 64, 2: None}


def test_a_text_with_words_is_embedded_anew(spark):
    before = spark.createDataFrame([(1, CANCEL, None, 1)], "id long, raw_text string, embedding array<float>, embedding_model_id long")
    after = dims.reembed(before, udfs.hashed_embedder(64), 2).first()
    assert after.embedding_model_id == 2 and len(after.embedding) == 64


def test_text_queries(spark):
    docs = spark.createDataFrame([(1, "running fast", "the cat runs"), (2, None, "a dog"), (3, "cat", "")], "id long, title string, raw_text string")
    post = text.build_postings(docs, {"title": 1.0, "raw_text": 0.1}, stem=True)
    q = spark.createDataFrame([(1, "run cat"), (2, "the"), (3, "dogs"), (4, "Cat")], "query_id long, text string")
    assert sorted(values(text.fts_match(q, post, stem=True), "query_id", "id")) == [(1, 1), (3, 2), (4, 1), (4, 3)]
    score = dict(values(text.fts_rank(q, post, stem=True).where("query_id = 4"), "id", "score"))
    assert score == {1: 0.05, 3: 0.5}
    assert values(text.query_lexemes(spark.createDataFrame([(1, "one two three")], "query_id long, text string"), first_words=2), "lexeme") == [("one",), ("two",)]


def _scored_by(df) -> set[str]:
    """What the lexemes or places of a row are grouped by, besides its id."""
    return set(re.findall(r"Aggregate \[(\w+)#\d+L, id#\d+L\][^\n]*(?:lexeme|places)", df._jdf.queryExecution().optimizedPlan().toString()))


@pytest.mark.parametrize("name", ["fts_cover_rank", "rrf_fuse", "fallback_search", "fts_match", "hybrid_search", "fts_rank", "write_postings", "hybrid_search_stored"])
def test_scores_of_a_query_are_those_of_its_search(spark, name):
    assert _scored_by(QUERIES[name](spark, f"{DATA}/sf0.001")) == {"search"}


def test_queries_with_the_same_words_are_one_search(spark):
    """Scores are made once for the words, whoever asks."""
    docs = spark.createDataFrame([(i, f"cat w{i % 3} dog cat") for i in range(30)], "id long, raw_text string")
    post = text.build_postings(docs, {"raw_text": 1.0})
    asked = lambda n: spark.createDataFrame([(None if i == 3 else i, ("Cat dog", "dog, cat", "the", "w1 cat")[i % 4]) for i in range(n)], "query_id long, text string")
    few = {t: {(r.id, r.score) for r in text.fts_rank(asked(4), post).collect() if r.query_id == q} for t, q in ((0, 0), (1, 1), (3, None))}
    got = text.fts_rank(asked(40), post)
    by_query = {}
    for r in got.collect():
        by_query.setdefault(r.query_id, set()).add((r.id, r.score))
    assert {q: len(v) for q, v in by_query.items()} == {q: 10 if q is None or q % 4 == 3 else 30 for q in [None, *range(40)] if q is None or q != 3 and q % 4 != 2}
    assert all(v == few[3 if q is None else q % 4] for q, v in by_query.items())
    assert _scored_by(got) == {"search"}
    top = text.fts_topk(asked(40), post, 2)
    assert sorted((r.query_id or -1, r.rank, r.id) for r in top.collect()) == sorted((r.query_id or -1, r.rank, r.id) for r in text.ranked(got, 2).collect())


def test_cover_scores_do_not_depend_on_hits_before(spark):
    assert text.cover_score([0, 63], ["cat", "dog"], [0.1, 0.1], 2) == 0.1 / 64
    assert text.cover_score([0, 1, 2, 2000, 2063], ["cat", "cat", "cat", "cat", "dog"], [0.7, 0.7, 0.7, 0.1, 0.1], 2) == 0.1 / 64


def test_postings_are_packed_on_their_way(spark, tmp_path, monkeypatch):
    """Packs of any size hold the same postings, in files sorted by lexeme; an empty index has none."""
    docs = spark.createDataFrame([(i, f"w{i % 7} common w{i % 11} é common") for i in range(60)], "id long, raw_text string")
    post = text.build_postings(docs, {"raw_text": 1.0})
    plain = lambda df: sorted((r.lexeme, r.id, r.field, r.weight, r.tf, tuple(r.positions), r.bucket) for r in df.collect())
    for files in (1, 3):
        text.write_postings(post, str(tmp_path / f"index{files}"), files)
        held = text.read_postings(spark, str(tmp_path / f"index{files}"))
        assert plain(held) == plain(post.withColumn("bucket", text.lexeme_bucket()))
        assert held.where("lexeme = 'common'").select(F.input_file_name()).distinct().count() == files
    assert sum(len(text.pa.ipc.open_stream(r).read_all()) for b in text._packed(iter([text.pa.RecordBatch.from_pydict({"lexeme": ["b", "a"], "bucket": [1, 0], "part": [0, 0]})])) for r in b["rows"].to_pylist()) == 2


def test_stored_index_is_pruned(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 7} common w{i % 11}") for i in range(60)], "id long, raw_text string")
    post = text.build_postings(docs, {"raw_text": 1.0})
    text.write_postings(post, str(tmp_path / "index"))
    held = text.read_postings(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "common w3"), (2, "w5 w10")], "query_id long, text string")
    found = text.fts_rank(q, held)
    assert sorted(found.collect()) == sorted(text.fts_rank(q, post).collect())
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_closer_words_score_higher(spark):
    docs = spark.createDataFrame([(1, "cat dog x x x x x x"), (2, "cat x x x x x x dog"), (3, "cat dog cat dog")], "id long, raw_text string")
    got = dict(values(text.fts_cover_rank(spark.createDataFrame([(1, "dog cat")], "query_id long, text string"), text.build_postings(docs, {"raw_text": 1.0})), "id", "score"))
    assert got[3] > got[1] > got[2]
    assert text.cover_score([0, 1, 2, 3], list("abab"), [1.0] * 4, 2) == pytest.approx(1.5)


# ---------------------------------------------------------------- vectors


def test_both_vector_paths_agree(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=8).tolist()) for i in range(400)] + [(900, [0.0] * 8), (901, None)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = corpus.where("id < 90").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    a, b = (sorted(vector.vector_topk(queries, corpus, 7, p).collect()) for p in ("sql", "matmul"))
    assert [x[:2] + (x.rank,) for x in a] == [x[:2] + (x.rank,) for x in b]
    assert np.allclose([x.score for x in a], [x.score for x in b], atol=2e-6) and all(x.id == x.query_id for x in a if x.rank == 0)


def test_recall_of_the_index(spark):
    r = np.random.default_rng(1)
    centers = r.normal(size=(40, 32))
    rows = [(i, (centers[i % 40] + 0.35 * r.normal(size=32)).tolist()) for i in range(2000)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = corpus.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    near = {(x.query_id, x.id) for x in vector.ann_topk(queries, corpus, 10).collect()}
    exact = {(x.query_id, x.id) for x in vector.vector_topk(queries, corpus, 10, "matmul").collect()}
    assert len(near & exact) / len(exact) >= 0.9


# ---------------------------------------------------------------- time lines


def test_recall_without_structure(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = corpus.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    near = {(x.query_id, x.id) for x in vector.ann_topk(queries, corpus, 20).collect()}
    exact = {(x.query_id, x.id) for x in vector.vector_topk(queries, corpus, 20, "matmul").collect()}
    assert len(near & exact) / len(exact) >= 0.9


def test_recall_of_the_query(spark):
    from threadbook.queries import QUERIES

    d = "/root/testdata/sf0.1"
    near, exact = ({(x.query_id, x.id) for x in QUERIES[q](spark, d).collect()} for q in ("ann_topk", "vector_topk_matmul"))
    wanted = {r.vec_id for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 100 = 0").collect()}
    print("recall", len(near & exact) / len(exact), len(wanted))
    assert {q for q, _ in near} == wanted and len(near & exact) / len(exact) >= 0.9


@pytest.mark.parametrize(("anchor", "before", "after", "expected"), [(3, 3, 3, [1, 2, 3, 5, 6]), (3, 1, 1, [2, 3, 5]), (1, 3, 0, [1]), (99, 3, 3, [])])
def test_timeline(spark, anchor, before, after, expected):
    rows = [(i, "S", datetime(2024, 1, 1, t)) for i, t in ((1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 5))] + [(7, "R", datetime(2024, 1, 1, 2))]
    obs = spark.createDataFrame(rows, "id long, session_id string, created_at timestamp")
    out = sessions.timeline(obs, spark.createDataFrame([(anchor,)], "anchor_id long"), before, after)
    assert [r.id for r in out.orderBy("created_at", "id").collect()] == expected


# ---------------------------------------------------------------- lessons


@pytest.mark.parametrize(
    ("lesson", "call", "hit"),
    [
        ((None, None, None, True), ("Bash", "p", "ls"), True),
        (("Bash", None, "drop|alter", True), ("Bash", "p", 'psql -c "DROP TABLE t"'), True),
        (("Bash", 2, None, True), ("Bash", "p", "ls"), False),
        ((None, 1, None, True), ("Edit", None, "x"), False),
        (("Edit", None, None, True), ("Bash", "p", "ls"), False),
        ((None, None, "(", True), ("Bash", "p", "("), False),
        ((None, None, None, False), ("Bash", "p", "ls"), False),
        ((None, None, "x", True), ("Bash", "p", None), False),
        ((None, None, None, True), (None, None, None), True),
    ],
)
@pytest.mark.parametrize("rows", [50_000, 0])
def test_match(spark, lesson, call, hit, rows):
    tool, project, pattern, active = lesson
    table = spark.createDataFrame([(1, project, "r", "warning", tool, pattern, active)], "id long, project_id long, rule string, severity string, trigger_tool string, trigger_pattern string, active boolean")
    projects = spark.createDataFrame([(1, "p"), (2, "q")], "id long, name string")
    calls = spark.createDataFrame([(9, *call)], "call_id long, tool_name string, project string, preview string")
    assert (lessons.match_lessons(calls, table, projects, limit_rows=rows).count() == 1) == hit


def test_five_hits_critical_first(spark):
    severity = ["info", "warning", "critical", "info", "critical", "warning", "critical"]
    table = spark.createDataFrame([(i, None, f"r{i}", s, None, None, True) for i, s in enumerate(severity)], "id long, project_id long, rule string, severity string, trigger_tool string, trigger_pattern string, active boolean")
    projects = spark.createDataFrame([(1, "p")], "id long, name string")
    hits = lessons.match_lessons(spark.createDataFrame([(1, "Bash", "p", "x")], "call_id long, tool_name string, project string, preview string"), table, projects)
    assert [r.lesson_id for r in hits.orderBy("rank").collect()] == [2, 4, 6, 1, 5]
    assert lessons.format_lesson_hits(hits).first().message.split("\n")[:2] == ["## Active Lessons", "CRITICAL [global]: r2"]


def test_lists_of_a_project(spark):
    table = spark.createDataFrame([(1, 1, "a", True), (2, None, "b", True), (3, 1, "c", False), (4, 2, "d", True)], "id long, project_id long, rule string, active boolean").withColumns({"severity": F.lit("info"), "created_at": F.lit(T0), "title": F.col("rule"), "embedding": F.lit(None).cast("array<float>")})
    projects = spark.createDataFrame([(1, "p"), (2, "q")], "id long, name string")
    assert values(lessons.list_lessons(table, projects, "p"), "id") == [(1,)]
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "query_id long, text string").withColumn("vector", F.lit(None).cast("array<float>"))
    table = table.withColumn("rule", F.concat("rule", F.lit("zz"))).withColumn("title", F.col("rule"))
    q = q.withColumn("text", F.concat("text", F.lit("zz")))
    assert sorted(values(search.search_lessons(q, table, projects, "p"), "id")) == [(1,), (2,)]


# ---------------------------------------------------------------- previews and ingest


@pytest.mark.parametrize(
    ("tool", "given", "expected"),
    [("Bash", '{"command":"a","cmd":"b"}', "a"), ("Bash", '{"cmd":"b"}', "b"), ("Edit", '{"file_path":"f","new_string":"' + "x" * 600 + '"}', "f " + "x" * 500), ("NotebookEdit", '{"notebook_path":"n","new_source":"s"}', "n s"), ("Grep", '{"pattern":"p"}', '{"pattern":"p"}'), ("Bash", None, ""), (None, None, "")],
)
def test_preview(spark, tool, given, expected):
    df = spark.createDataFrame([(tool, given)], "t string, g string")
    assert df.select(X.tool_input_preview("t", "g").alias("x")).first().x == expected


def test_columns(spark):
    one = lambda c, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "x string").select(c).collect()]
    assert one(X.derive_project("x"), "/a/b", "/a/b/", "/", "", None) == ["b", "b", "", "unknown", "unknown"]
    assert one(X.normalize_type("x"), "bugfix", "pattern", None) == ["bugfix", "discovery", "discovery"]
    assert one(X.known_severity("x"), "urgent", "info", None) == ["warning", "info", "warning"]
    assert one(F.date_format(X.parse_legacy_ts("x"), "yyyy-MM-dd HH:mm:ss.SSS"), "2025-12-11T00:14:59.076Z", "2025-12-11T00:14:59", "x", None) == ["2025-12-11 00:14:59.076", "2025-12-11 00:14:59.000", None, None]
    assert one(X.truncate_preview("x", 3), "abcdef", None) == ["abc", None]
    parsed = one(X.parse_extraction("x"), '```json\n{"title":"t","facts":["a"]}\n```', '{"skip": true}', "oops", '{"title":"t"}', "[1]", None)
    assert [p.outcome for p in parsed] == ["ok", "skip", "error", "ok", "error", "error"] and parsed[0].data.facts == ["a"]


def test_raw_text(spark):
    df = spark.createDataFrame([("t", None, "n", ["a", "b"]), ("t", "", None, None)], "title string, subtitle string, narrative string, facts array<string>")
    assert values(df.select(X.build_raw_text().alias("x")), "x") == [("t\nn\n- a\n- b",), ("t",)]


def test_prompt_parts(spark):
    df = spark.createDataFrame([("Bash", "{}", "r", "/w", "m"), (None, None, None, "", None)], "tool_name string, tool_input string, tool_response_preview string, cwd string, last_user_message string")
    assert values(df.select(X.extraction_prompt().alias("x")), "x") == [("Working directory: /w\n\nUser request: m\n\nTool: Bash\n\nInput: {}\n\nResponse: r",), ("Tool: ",)]
    assert df.select(X.chat_prompt(F.lit("u"), "s").alias("x")).first().x == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n"


def test_skip(spark):
    df = spark.createDataFrame([("Bash",), ("TodoWrite",), (None,)], "tool_name string")
    assert values(ingest.skip_low_value(df), "tool_name") == [("Bash",), (None,)]
    assert values(ingest.capture_allowlist(df), "tool_name") == [("Bash",)]


@pytest.mark.parametrize(("outcome", "retries", "expected"), [("error", 0, ("pending", 1)), ("error", 2, ("pending", 3)), ("error", 3, ("failed", 4)), ("ok", 0, ("done", 0)), ("skip", 1, ("skipped", 1)), (None, 1, ("pending", 1))])
def test_queue(spark, outcome, retries, expected):
    queue = spark.createDataFrame([(1, "pending", retries, None)], "id long, status string, retry_count int, processed_at timestamp")
    outcomes = spark.createDataFrame([(1, outcome)] if outcome else [], "id long, outcome string")
    assert values(ingest.advance_queue(queue, outcomes, "2024-02-15 00:00:00"), "status", "retry_count") == [expected]


def test_patterns(spark):
    df = spark.createDataFrame([("a.*b",), ("(",), ("a" * 501,), (None,), ("(?P<n>a)",)], "trigger_pattern string")
    assert values(ingest.validate_trigger_pattern(df), "pattern_ok") == [(True,), (False,), (False,), (True,), (True,)]


def test_legacy_rows_null_safe(spark):
    schema = "title string, created_at timestamp, project string"
    at = lambda us: datetime(2024, 1, 1, 10, 0, 0, us)
    legacy = spark.createDataFrame([("t", at(100_000), "p"), (None, at(0), "p"), ("t", at(0), "q"), ("t", at(0), "q")], schema)
    existing = spark.createDataFrame([("t", at(900_000), "p"), (None, at(5), "p")], schema)
    assert values(ingest.legacy_new_rows(legacy, existing), "project") == [("q",), ("q",)]


def test_legacy_lists(spark):
    rows = [(1, "t", "s", "gotcha", "n", '["a"]', "oops", "", None, "", "p", "m", "2024-01-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "id long, title string, subtitle string, type string, narrative string, facts string, concepts string, files_read string, files_modified string, text string, project string, memory_session_id string, created_at string")
    r = tables.read_legacy_observations(df).first()
    assert (r.facts, r.concepts, r.files_read, r.files_modified, r.type, r.raw_text) == (["a"], [], [], [], "discovery", "t\ns\nn")


# ---------------------------------------------------------------- small tables


def test_get_or_create(spark):
    projects = spark.createDataFrame([(5, "a", "/old")], "id long, name string, full_path string")
    names = spark.createDataFrame([("c", "/c"), ("a", "/new"), ("b", "/b"), ("b", "/b"), (None, "/n")], "name string, full_path string")
    once = dims.ensure_projects(projects, names)
    assert sorted(map(tuple, once.collect())) == [(5, "a", "/old"), (6, "b", "/b"), (7, "c", "/c")]
    assert sorted(map(tuple, dims.ensure_projects(once, names).collect())) == sorted(map(tuple, once.collect()))
    held = spark.createDataFrame([], "id long, session_id string, project_id long, agent_type string, status string, started_at timestamp")
    events = spark.createDataFrame([("s", 2, "x", datetime(2024, 1, 2)), ("s", 1, "x", datetime(2024, 1, 1))], "session_id string, project_id long, agent_type string, created_at timestamp")
    made = dims.ensure_sessions(held, events)
    assert values(made, "id", "session_id", "project_id") == [(1, "s", 1)]
    assert dims.ensure_sessions(made, events).count() == 1
    new, conflicts = dims.create_sessions(made, spark.createDataFrame([("s",), ("t",)], "session_id string"))
    assert values(new, "id", "session_id") == [(2, "t")] and values(conflicts, "session_id") == [("s",)]


@pytest.mark.parametrize(("status", "expected"), [("completed", ("completed", True)), ("failed", ("failed", False)), ("", ("active", False))])
def test_session_patch(spark, status, expected):
    table = spark.createDataFrame([("s", "active", None, None)], "session_id string, status string, summary string, completed_at timestamp")
    new, refused = dims.update_sessions(table, spark.createDataFrame([("s", status, None), ("u", "failed", None)], "session_id string, status string, summary string"), "2024-02-15 00:00:00")
    r = new.first()
    assert (r.status, r.completed_at is not None) == expected
    reasons = dict(map(tuple, refused.collect()))
    assert reasons == ({"u": "not found", "s": "no fields"} if not status else {"u": "not found"})


def test_lesson_patch_and_triggers(spark):
    table = spark.createDataFrame([(1, "t", "r", "info", None, None, True, "t\nr", [1.0], 2, None)], "id long, title string, rule string, severity string, trigger_tool string, trigger_pattern string, active boolean, raw_text string, embedding array<float>, trigger_count long, last_triggered_at timestamp")
    patch = lambda **k: spark.createDataFrame([(1, *(k.get(c) for c in ("title", "rule", "severity", "trigger_tool", "trigger_pattern", "active")))], "id long, title string, rule string, severity string, trigger_tool string, trigger_pattern string, active boolean")
    r = dims.update_lessons(table, patch(rule="new words")).first()
    assert (r.title, r.rule, r.raw_text) == ("t", "new words", "t\nnew words") and len(r.embedding) == 64
    r = dims.update_lessons(table, patch(rule="", active=False)).first()
    assert (r.rule, r.raw_text, r.active) == ("", "t\nr", False)
    assert dims.update_lessons(table, patch(severity="critical")).first().embedding == [1.0]
    hits = spark.createDataFrame([(1, datetime(2024, 1, d)) for d in (1, 3, 2)], "lesson_id long, at timestamp")
    r = dims.record_triggers(table, hits).first()
    assert (r.trigger_count, r.last_triggered_at) == (5, datetime(2024, 1, 3))


def test_saved_texts(spark):
    r = dims.save_memories(spark.createDataFrame([("x" * 100, None, "")], "text string, title string, project string")).first()
    assert (r.title, r.project, r.type, r.session_id) == ("x" * 80, "manual", "discovery", "manual-memories")


def test_models(spark):
    table = spark.createDataFrame([(1, "a", 768, "x", True)], "id long, model_name string, dimensions int, provider string, is_default boolean")
    out = sorted(map(tuple, dims.register_model(table, "b", 64).collect()))
    assert out == [(1, "a", 768, "x", False), (2, "b", 64, None, True)]
    assert sorted(map(tuple, dims.register_model(dims.register_model(table, "b", 64), "a", 768).collect())) == [(1, "a", 768, "x", True), (2, "b", 64, None, False)]


def test_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = dims.assign_ids(df, ["k"], 50)
    assert sorted(values(out, "id", "k")) == [(51 + k, k) for k in range(1000)]


def test_failing_batches_keep_their_vectors(spark):
    def load():
        def run(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return np.array([[3.0, 4.0]] * len(texts))

        return run

    obs = spark.createDataFrame([(1, "good", [1.0, 0.0], 1), (2, "bad", [0.0, 1.0], 1)], "id long, raw_text string, embedding array<float>, embedding_model_id long").repartition(2, "id")
    out = dims.reembed(obs, load, 2, only_missing=False)
    got = {r.id: r for r in out.collect()}
    assert [round(x, 3) for x in got[1].embedding] == [0.6, 0.8] or got[1].embedding_error
    assert got[2].embedding == [0.0, 1.0] and got[2].embedding_model_id == 1 and "RuntimeError" in got[2].embedding_error
    progress = dims.reembed_progress(obs, out, only_missing=False).first()
    assert progress.total == 2 and progress.processed + progress.errors == 2


def test_new_session_is_told(spark):
    obs = spark.createDataFrame([(i, 1, f"t{i}", "bugfix", datetime(2024, 1, 1, i)) for i in range(7)], "id long, project_id long, title string, type string, created_at timestamp")
    rules = spark.createDataFrame([(1, 1, "own"), (2, None, "all")], "id long, project_id long, rule string").withColumns({"severity": F.lit("critical"), "active": F.lit(True), "created_at": F.lit(T0)})
    told = search.session_context(obs, rules, spark.createDataFrame([(1, "p"), (2, "q")], "id long, name string"))
    got = {r.project: r.context.split("\n") for r in told.collect()}
    assert got["p"] == ["## Active Lessons", "  1. CRITICAL [p]: own", "  2. CRITICAL [global]: all", "", 'Recent memory for "p" (5 entries):', *[f"  {n}. 2024-01-01 0{i}:00:00 [bugfix] t{i}" for n, i in enumerate(range(2, 7), 1)]]
    assert len(got["q"]) == 3


def test_import_twice_changes_nothing(spark):
    legacy = spark.createDataFrame([(i, f"t{i}", T0, "p") for i in range(5)], "id long, title string, created_at timestamp, project string")
    new = ingest.legacy_new_rows(legacy, legacy.where("id < 2"))
    assert new.count() == 3 and ingest.legacy_new_rows(legacy, legacy.where("id < 2").unionByName(new)).count() == 0



BRACES = ['{"K"', "a{,3}{", "${HOME}", "[[]x", "a{2}b", "(?P<n>k)ey", "(?i)x(?-i:Y)z", "(", "[z-a]", "x" * 501, "ſet", "pass(word|wd)?s*", "[a-c_]+\\.py$", "^ls -l", "tab\\tend", "\\bcat\\b"]
PREVIEWS = ['see {"k": 1}', "aaa{", "${HOME}", "[x", "AAB", "Key", "xYZ", "SET", "passwds", "lib/AB_c.PY", "LS -L", "tab\tend", "a CAT sat", "", None]


def _brace_case(spark):
    rules = spark.createDataFrame([(i, None, "critical", "r", None, p, True) for i, p in enumerate(BRACES)], "id long, project_id long, severity string, rule string, trigger_tool string, trigger_pattern string, active boolean")
    calls = spark.createDataFrame([(i, "Bash", "p", t) for i, t in enumerate(PREVIEWS)], "call_id long, tool_name string, project string, preview string")
    want = set()
    for i, p in enumerate(BRACES):
        for j, t in enumerate(PREVIEWS):
            try:
                hit = len(p) <= 500 and re.search(p, t or "", re.IGNORECASE) is not None
            except re.error:
                hit = False
            if hit:
                want.add((j, i))
    return calls, rules, spark.createDataFrame([(1, "p")], "id long, name string"), want


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_no_pattern_fails_the_job(spark, tmp_path):
    calls, rules, projects, want = _brace_case(spark)
    for rows in (50_000, 3):
        got = lessons.match_lessons(calls, rules, projects, k=50, limit_rows=rows)
        assert set(values(got, "call_id", "lesson_id")) == want
    calls.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    streams.stream_lesson_matches(stream, rules, projects, str(tmp_path / "sink"), str(tmp_path / "state"), 50).awaitTermination()
    assert set(values(spark.read.parquet(str(tmp_path / "sink")), "call_id", "lesson_id")) == want


def test_covers_in_long_fields(spark):
    """The score of a text with very many hits takes no quadratic time, and fields never overlap."""
    n = 200_000
    assert text.cover_score(list(range(n)), ["a", "b"] * (n // 2), [1.0] * n, 2) == pytest.approx((n - 1) / 2)
    docs = spark.createDataFrame([(1, "x " * 50 + "cat", "dog " + "x " * 50)], "id long, title string, raw_text string")
    got = text.fts_cover_rank(spark.createDataFrame([(1, "dog cat")], "query_id long, text string"), text.build_postings(docs, {"title": 1.0, "raw_text": 1.0})).first()
    assert got.score < 1e-5


def test_postings_of_wanted_words_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"A cat w{i % 5} and a cat w{i % 3} the", None if i % 2 else f"w{i % 3} dog") for i in range(40)], "id long, title string, raw_text string")
    weights = {"title": 1.0, "raw_text": 0.1}
    only = spark.createDataFrame([("cat",), ("w1",), ("dog",), ("cat",)], "lexeme string")
    every = sorted(map(str, text.build_postings(docs, weights).where("lexeme in ('cat', 'w1', 'dog')").collect()))
    assert sorted(map(str, text.build_postings(docs, weights, only=only).collect())) == every
    monkeypatch.setattr(text, "FEW_LEXEMES", 1)
    assert sorted(map(str, text.build_postings(docs, weights, only=only).collect())) == every
    assert "Exchange" not in text.build_postings(docs, weights)._jdf.queryExecution().executedPlan().toString()


def test_many_queries_of_one_group_are_not_broadcast(spark):
    r = np.random.default_rng(0)
    corpus = spark.createDataFrame([(i, i % 3, r.normal(size=4).tolist()) for i in range(300)], "id long, project_id long, embedding array<float>")
    queries = corpus.select(F.col("id").alias("query_id"), "project_id", F.col("embedding").alias("vector"))
    many = vector.vector_topk(queries, corpus, 4, by="project_id")
    assert "FlatMapCoGroups" in many._jdf.queryExecution().executedPlan().toString()
    few = queries.where("query_id < 60")
    a = sorted(values(vector.vector_topk(few, corpus, 4, by="project_id"), "query_id", "id", "rank"))
    assert a == [x for x in sorted(values(many, "query_id", "id", "rank")) if x[0] < 60]
