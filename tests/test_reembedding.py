"""Re-embedding in pages: what has been asked stays."""

import os

import pytest

from threadbook.functions import udfs
from threadbook.operators import dims
from threadbook.operators.reembedding import EmbeddingLedger, reembed_pages

SCHEMA = "id long, raw_text string, embedding array<float>, embedding_model_id long"


def _counting(path):
    """An embedder that notes each text it is asked for."""

    def load():
        inner = udfs.hashed_embedder(8)()

        def embed(texts):
            for t in texts:
                with open(os.path.join(path, f"{t.replace(' ', '_')}.txt"), "a") as f:
                    f.write("x")
            return inner(texts)

        return embed

    return load


def test_a_run_that_was_killed_goes_on(spark, tmp_path, monkeypatch):
    asked = tmp_path / "asked"
    asked.mkdir()
    obs = spark.createDataFrame([(i, f"text {i}", None if i % 3 else [1.0] * 8, 1) for i in range(1, 91)], SCHEMA)
    ledger = EmbeddingLedger(spark, str(tmp_path / "ledger"))
    place, calls = ledger._folder.place, []

    def dies(aside, target):
        if target.startswith("pages/"):
            calls.append(target)
            if len(calls) == 3:
                raise RuntimeError("the driver is gone")
        return place(aside, target)

    monkeypatch.setattr(ledger._folder, "place", dies)
    with pytest.raises(RuntimeError):
        reembed_pages(obs, ledger, _counting(str(asked)), 2, page_rows=10)
    again = EmbeddingLedger(spark, str(tmp_path / "ledger"))
    pages = again.plan(obs)
    assert len(pages) == 6 and again.pending(6) == [2, 3, 4, 5]
    out = reembed_pages(obs, again, _counting(str(asked)), 2, page_rows=10).cache()
    assert out.count() == 90
    want = {r.id: (r.embedding, r.embedding_model_id) for r in dims.reembed(obs, udfs.hashed_embedder(8), 2).collect()}
    assert {r.id: (r.embedding, r.embedding_model_id) for r in out.collect()} == want
    times = {p.name: len(p.read_text()) for p in asked.iterdir()}
    third = {f"text_{i}.txt" for i in range(pages[2][0], pages[2][1] + 1)}
    assert len(times) == 60 and all(n == (2 if name in third else 1) for name, n in times.items())  # the page that was not committed is asked again
    reembed_pages(obs, again, _counting(str(asked)), 2).count()
    assert {p.name: len(p.read_text()) for p in asked.iterdir()} == times
    assert tuple(again.progress(obs.where("embedding is null")).first()) == (60, 60, 0)


def test_odd_tables(spark, tmp_path):
    def load():
        def embed(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("no")
            return udfs.hashed_embedder(8)()(texts)

        return embed

    obs = spark.createDataFrame([(1, "bad", [1.0] * 8, 1), (2, None, None, 1), (None, "x", None, 1), (2, "words", None, 1)], SCHEMA)
    assert reembed_pages(obs.limit(0), EmbeddingLedger(spark, str(tmp_path / "none")), load, 2).count() == 0
    out = reembed_pages(obs.where("raw_text is not null or id is null"), EmbeddingLedger(spark, str(tmp_path / "some")), load, 2, only_missing=False, page_rows=1)
    got = {(r.id, r.raw_text): (r.embedding is not None, r.embedding_model_id, r.embedding_error) for r in out.collect()}
    assert got == {(1, "bad"): (True, 1, "ValueError: no"), (None, "x"): (False, 1, None), (2, "words"): (True, 2, None)}


def test_pages_hold_a_vector_for_every_text_with_words(spark, tmp_path):
    """The signed counts of both words cancel out."""
    obs = spark.createDataFrame([(1, "house window", None, 1)], "id long, raw_text string, embedding array<float>, embedding_model_id long")
    after = reembed_pages(obs, EmbeddingLedger(spark, str(tmp_path / "ledger")), udfs.hashed_embedder(64), 2).first()
    assert after.embedding_model_id == 2 and len(after.embedding) == 64
