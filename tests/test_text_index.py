"""The text index that follows its table agrees with one that is made afresh."""

import numpy as np
from pyspark.sql import functions as F

from threadbook.operators import text
from threadbook.operators.text_index import TextIndex

WEIGHTS = {"title": 1.0, "raw_text": 0.1}
SCHEMA = "id long, title string, raw_text string"


def _rows(spark, ids, seed):
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(words[int(x)] for x in np.minimum(r.zipf(1.5, n) - 1, 39))
    return spark.createDataFrame([(i, say(3), None if i % 7 == 0 else say(12)) for i in ids], SCHEMA)


def _postings(df):
    return sorted((r.lexeme, r.id, r.field, r.weight, r.tf, tuple(r.positions)) for r in df.select("lexeme", "id", "field", "weight", "tf", "positions").collect())


def test_index_follows_inserts_updates_deletions_and_merges(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), WEIGHTS)
    assert index.postings().count() == 0 and index.merge() == 0
    table = {}

    def put(ids, seed, **how):
        rows = _rows(spark, ids, seed)
        table.update({r.id: tuple(r) for r in rows.collect()})
        index.put(rows, **how)

    def agrees():
        fresh = spark.createDataFrame(list(table.values()), SCHEMA)
        assert _postings(index.postings()) == _postings(text.build_postings(fresh, WEIGHTS))
        queries = spark.createDataFrame([(1, "w0 w1"), (2, "w3"), (3, "w30 w2"), (4, "nothing")], "query_id long, text string")
        ranked = lambda p: sorted(map(tuple, text.fts_rank(queries, p).collect()))
        assert ranked(index.postings()) == ranked(text.build_postings(fresh, WEIGHTS))

    put(range(30), 1, fresh=True)
    put(range(30, 40), 2, fresh=True)
    put([3, 35, 50], 3)  # two updates and an insert
    agrees()
    index.remove(spark.createDataFrame([(4,), (50,), (999,)], "id long"))
    for i in (4, 50):
        del table[i]
    put([4], 4)  # back again
    put([3], 5)
    agrees()
    before = index.version()
    old = _postings(index.postings(before))
    assert len(index.segments()) == 6 and index.merge((2, 6)) == before + 1 and len(index.segments()) == 3
    agrees()
    put([35, 60], 6)
    assert index.merge((0, 4)) == before + 3 and len(index.segments()) == 1
    agrees()
    counts = {r.lexeme: (r.rows, r.occurrences) for r in index.statistics().collect()}
    exact = {r.lexeme: (r.n, r.tf) for r in index.postings().groupBy("lexeme").agg(F.count_distinct("id").alias("n"), F.sum("tf").alias("tf")).collect()}
    assert counts == exact  # one segment, nothing struck
    assert _postings(index.postings(before)) == old  # an older version is still whole
    assert index.vacuum() >= 6
    agrees()


def test_small_segments_are_due_for_a_merge(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), WEIGHTS)
    index.put(_rows(spark, range(100), 1), fresh=True)
    for i in range(4):
        assert index.due() is None
        index.put(_rows(spark, [200 + i, i], 2 + i))
    assert index.due() == (1, 5)
    index.merge()
    assert [n for _, n in index.segments()] == [100, 8] and index.due() is None


def test_a_search_reads_the_buckets_of_its_words(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), WEIGHTS)
    index.put(_rows(spark, range(60), 1), fresh=True)
    index.put(_rows(spark, range(60, 80), 2))
    queries = spark.createDataFrame([(1, "w3")], "query_id long, text string")
    plan = text.fts_rank(queries, index.postings())._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_one_of_two_writers_goes_after_the_other(spark, tmp_path):
    index, other = (TextIndex(spark, str(tmp_path / "index"), WEIGHTS) for _ in range(2))
    commit, calls = index._commit, []

    def late(segments, after):
        if not calls:
            calls.append(other.put(_rows(spark, [7], 3)))
        return commit(segments, after)

    index._commit = late
    assert index.put(_rows(spark, [8], 4)) == 2 and len(index.segments()) == 2
    assert {r.id for r in index.postings().collect()} == {7, 8}
