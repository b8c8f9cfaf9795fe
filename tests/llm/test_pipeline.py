"""The corpus pipeline: stages keep the columns, and their decisions take effect."""

import corpus_pipeline
from tests.conftest import DATA
from threadbook.llm.common import written
from threadbook.llm.op3_secret_scan import find_secrets
from threadbook.llm.op4_ngram_join import ngram_components
from threadbook.llm.op5_quality import TOXIC, score_documents
from threadbook.llm.op7_decontaminate import find_contamination


def test_stages(spark):
    d = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "mixture"]
    held, given = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, given, d))
        held[name] = (given, out)
        if name != "mixture":
            assert out.columns == docs.columns
        given = out
    a, b = held["quality"]
    assert ids(b) == ids(score_documents(a, labels).where(f"keep and toxic_score < {TOXIC}"))  # documents that it rejects go, toxic ones too
    a, b = held["near_duplicates"]
    assert ids(b) == ids(ngram_components(a).where("component_id = doc_id"))
    assert ngram_components(b).where("component_id <> doc_id").count() == 0
    a, b = held["decontaminate"]
    assert ids(a) == ids(b) and find_contamination(a, benchmark).where("n_hit > 0").count() > 0 and find_contamination(b, benchmark).where("n_hit > 0").count() == 0
    a, b = held["secrets"]
    assert ids(a) == ids(b) and find_secrets(a).where("size(spans) > 0").count() > 0 and find_secrets(b).where("size(spans) > 0").count() == 0
    a, b = held["mixture"]
    assert ids(a) == ids(b) and b.where("taken > 3 * size").count() == 0 and a.count() == b.count()
    assert b.where("taken <> aggregate(pieces, 0L, (n, p) -> n + p.words)").count() == 0


def test_mixture_sends_no_documents_to_the_driver(spark):
    out = corpus_pipeline.mixture(spark, spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"), f"{DATA}/sf0.001")
    assert "BroadcastHashJoin [row_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_run(spark):
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").where("taken > 0").count() > 0


ODD = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "no id here at all", None, None, None), (3, "one two three four five six", "en", "a", 27), (3, "one two three four five six", "en", "a", 27), (3, "another text of the same id", "en", "b", 27), (4, "ONE two three four five six", "en", "a", 27), (5, "word " * 30_000 + "token=abcdefgh", "en", "b", 150_014), (6, "x" * 200_000, "de", "b", 200_000)]


def odd_tables(spark, root, rows):
    spark.createDataFrame([(*r, "t", 1.0, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, part string, score double, row_id int").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").where("doc_id = 3").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "word word word word word"), (None, "null id"), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_odd_rows(spark, tmp_path):
    d = odd_tables(spark, tmp_path, ODD)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    whole = sorted(((r[0], r[1]) for r in ODD), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        got = rows(out)
        if name == "quality":  # no labels of any use: all stay
            assert got == whole
        if name == "near_duplicates":
            assert [k for k, _ in got] == sorted([1, 2, 3, 5, 6, None], key=str)
        if name == "decontaminate":
            assert len(got) == len(whole) and sum(a != b for a, b in zip(got, whole, strict=True)) == 1
        if name == "secrets":
            assert len(got) == len(whole) and "token=" not in str(got)
        empty = stage(spark, docs.limit(0), d)
        assert empty.count() == 0 and empty.columns == docs.columns
    mix = corpus_pipeline.mixture(spark, docs, d)
    assert sorted(map(str, (r.doc_id for r in mix.collect()))) == sorted(str(r[0]) for r in ODD)
    assert corpus_pipeline.mixture(spark, docs.limit(0), d).count() == 0


def test_run_deletes_what_it_wrote(spark):
    from threadbook.scratch import _made

    made = _made.setdefault(spark.sparkContext.applicationId, [])
    before = list(made)
    assert corpus_pipeline.run(spark, f"{DATA}/sf0.001").where("taken > 0").count() > 0
    assert made[: len(before)] == before and len(made) - len(before) <= 6  # the last stage's own and its input
