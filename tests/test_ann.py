"""The index of vectors by cells and codes: recall, what a search looks at, appending, and odd tables."""

import numpy as np
from pyspark.sql import functions as F

from threadbook.operators import vector


def _clustered(spark, n, clusters, dims=32, seed=1):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, dims))
    x = centers[np.arange(n) % clusters] + 0.25 * r.normal(size=(n, dims))
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<float>").repartition(4).cache()
    return corpus, corpus.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def _pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


def _recall(spark, queries, corpus, k, found):
    exact = _pairs(vector.vector_topk(queries, corpus, k, "matmul"))
    return len(_pairs(found) & exact) / len(exact)


def _share(queries, k, model, index, n):
    seen = {r.query_id: r.seen for r in vector.ann_candidates(queries, k, model, index).collect()}
    return sum(seen.values()) / (len(seen) * n)


def test_share_falls_as_the_corpus_grows(spark):
    shares = []
    for n, clusters in ((2_000, 40), (20_000, 400)):
        corpus, queries = _clustered(spark, n, clusters)
        model = vector.fit_ann(corpus)
        index = vector.build_ann(corpus, model)
        shares.append(_share(queries, 10, model, index, n))
        assert _recall(spark, queries, corpus, 10, vector.ann_topk(queries, corpus, 10, model, index)) >= 0.9
    assert shares[0] <= 0.2 and shares[1] <= 0.1 and shares[1] < shares[0] / 2


def test_cells_are_parted_when_they_would_be_large(spark):
    corpus, queries = _clustered(spark, 6_000, 60)
    model = vector.fit_ann(corpus, first=8, cell_rows=16)
    assert len(model.first) == 8 and len(model.parts) > 8
    index = vector.build_ann(corpus, model)
    assert index.agg(F.sum(F.size("rows"))).first()[0] == 6_000
    assert _recall(spark, queries, corpus, 10, vector.ann_topk(queries, corpus, 10, model, index)) >= 0.9
    assert _share(queries, 10, model, index, 6_000) <= 0.35


def test_a_stored_index_that_was_appended_to_agrees_with_a_fresh_one(spark, tmp_path):
    corpus, queries = _clustered(spark, 1_500, 30)
    model = vector.fit_ann(corpus.where("id < 1000"))
    path = str(tmp_path / "index")
    vector.write_ann(vector.build_ann(corpus.where("id < 1000"), model), path, model=model)
    vector.write_ann(vector.build_ann(corpus.where("id >= 1000"), model), path, "append")
    stored_model, stored = vector.read_ann(spark, path)
    assert all(np.array_equal(a, b) for a, b in zip(model.words, stored_model.words, strict=True)) and model.probes == stored_model.probes
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(vector.ann_topk(queries, corpus, 10, stored_model, stored)) == rows(vector.ann_topk(queries, corpus, 10, model, vector.build_ann(corpus, model)))


def test_copies_of_one_vector_are_many_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(400)]
    corpus = spark.createDataFrame([*rows, (5000, None), (5001, [0.0] * 8), (5002, [1.0, 2.0])], "id long, embedding array<float>")
    monkeypatch.setattr(vector, "BLOCK_ROWS", 50)
    model = vector.fit_ann(corpus, dims=8)
    index = vector.build_ann(corpus, model).cache()
    assert index.select(F.max(F.size("rows")), F.sum(F.size("rows"))).first()[1] == 700
    assert index.groupBy("cell").agg(F.sum(F.size("rows")).alias("n"), F.count("*").alias("b")).where("n >= 400 and b >= 8").count() == 1
    queries = corpus.where("id in (0, 100, 1000)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vector.ann_topk(queries, corpus, 5, model, index).where("query_id = 1000").orderBy("rank").collect()
    assert [x.score for x in got] == [1.0] * 5


def test_tables_with_few_vectors(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]):
        corpus = spark.createDataFrame(rows, "id long, embedding array<float>")
        queries = spark.createDataFrame([(7, [1.0, 0.1]), (8, None), (9, [0.0, 0.0])], "query_id long, vector array<float>")
        got = sorted((r.query_id, r.rank, r.id) for r in vector.ann_topk(queries, corpus, 2).collect())
        assert got == [(7, n, i) for n, (i, v) in enumerate([x for x in rows if x[1]][:2])]


def test_rows_of_a_cell_travel_by_chunk_of_queries(spark, monkeypatch):
    """Not once a query, and what a task holds at once changes no result."""
    corpus, queries = _clustered(spark, 3_000, 20)
    model = vector.fit_ann(corpus)
    index = vector.build_ann(corpus, model).cache()
    want = sorted(map(tuple, vector.ann_topk(queries, corpus, 10, model, index).collect()))
    for name, n in (("CODED", 500), ("CODED_CHUNK", 7), ("CODED_ASKED", 3)):
        monkeypatch.setattr(vector, name, n)
    got = vector.ann_topk(queries, corpus, 10, model, index)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "scored(" not in plan
    assert sorted(map(tuple, got.collect())) == want


def test_a_written_index_is_searched_by_chunk_of_queries(spark, tmp_path):
    corpus, queries = _clustered(spark, 1_000, 10)
    model = vector.fit_ann(corpus)
    vector.write_ann(vector.build_ann(corpus, model), str(tmp_path / "index"), model=model)
    got = vector.ann_topk(queries, corpus, 10, *vector.read_ann(spark, str(tmp_path / "index")))
    assert "scored(" not in got._jdf.queryExecution().executedPlan().toString()
    assert _recall(spark, queries, corpus, 10, got) >= 0.9
