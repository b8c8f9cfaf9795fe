"""Operators 11 and 12 against brute force."""

import time
from collections import Counter

import numpy as np
import pytest

from tests.conftest import DATA, same
from threadbook.llm import op11_hard_negatives as eleven
from threadbook.llm import op12_collocations as twelve

# ---------------------------------------------------------------- 11


@pytest.mark.parametrize(("low", "high", "a_low", "a_high", "d"), [(-250, 250, -250, 250, 64), (-3, 4, -3, 4, 6), (-(10**9), 10**9, -(10**6), 10**6, 5), (5, 5, 0, 0, 3), (-(2**62), 2**62, -(2**62), 2**62, 4), (-7, -5, 3, 9, 1)])
def test_packed_products_are_exact(low, high, a_low, a_high, d):
    r = np.random.default_rng(0)
    rows, anchors = r.integers(low, high + 1, (37, d)), r.integers(a_low, a_high + 1, (9, d))
    packed = eleven.Packed(rows, int(anchors.min()), int(anchors.max()))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(a, v, strict=True)) for v in rows] for a in anchors], object)
    assert (packed.scores(anchors) == np.clip(want, -(2**63), 2**63 - 1)).all()
    assert packed.fields >= 2  # several candidates an integer, however large they are


def brute_negatives(rows, is_anchor, k=5):
    """Of (row, vec_id, label, vector)."""
    last = lambda i: (i is None, i or 0)
    rows = [(n, *r) for n, r in enumerate(rows) if r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for n, i, label, v in rows:
        if i is None or not is_anchor(i):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), last(j), m, j, kind) for m, j, kind, w in rows if m != n and len(w) == len(v)), key=lambda x: x[:3])
        for s, _, _, p, _ in [x for x in scored if x[4] == label][:k]:
            hard = [x for x in scored if x[4] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, p, rank, x[3], -s, -x[0]) for rank, x in enumerate(hard, 1)]
    return sorted(out, key=str)


def test_hard_negatives(spark):
    r = np.random.default_rng(2)
    rows = [(i, int(r.integers(0, 4)), r.integers(-3, 6, 6).tolist()) for i in range(300)] + [(400 + i, 1, [1, 2, 3, 0, 1, 1]) for i in range(150)]  # a hot label and a hot vector
    rows += [(None, 1, [5] * 6), (None, 2, [4] * 6), (700, None, [1] * 6), (710, 1, None), (720, 1, [1, None]), (725, 1, [1, 2]), (726, 2, [2, 1]), (50, 2, rows[50][2]), (50, rows[50][1], rows[50][2]), (730, 3, []), (731, 2, [])]
    df = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "vec_id long, label int, vector array<long>, shard int, chunk int, row int, n int")
    anchor = df["vec_id"] % 25 == 0
    want = brute_negatives(rows, lambda i: i % 25 == 0)
    assert len(want) > 200
    for sizes in ({}, {"shard": 64, "chunk": 3}):
        got = eleven.hard_negatives(df, eleven.F.col("vec_id") % 25 == 0, **sizes)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert eleven.hard_negatives(df.limit(0), anchor).count() == 0
    assert eleven.hard_negatives(df.where("label = 1"), eleven.F.col("vec_id") % 25 == 0).count() == 0  # no other label


def test_hard_negatives_of_very_large_numbers(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 2, r.integers(-(2**29), 2**30, 8).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    assert sorted(map(tuple, eleven.hard_negatives(df, eleven.F.col("vec_id") % 10 == 0).collect()), key=str) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_labelled_numbers(spark):
    rows = [(1, 3, [0.5, 0.25]), (2, 3, None), (3, 3, [1.0, None]), (4, 3, [float("nan"), 1.0]), (5, 3, [float("inf"), 0.0]), (6, None, [1.0, 1.0]), (7, 0, [-0.001, 1.0])]
    got = eleven.labelled_numbers(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert {r.vec_id: r.vector for r in got} == {1: [128, 64], 7: [-1, 256]}


def test_hard_negatives_query(spark, duck):
    same(eleven.op11_hard_negatives(spark, f"{DATA}/sf0.001"), duck, eleven.SQL)


# ---------------------------------------------------------------- 12


def brute_phrases(rows, least, top, longest=4):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    out = []
    frequent = {k: v for k, v in counts.items() if v >= least}
    for lang in totals:
        found = []
        for (of, words), a in frequent.items():
            if of != lang or len(words) < 2:
                continue
            score, _, l, r = min((2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words)))  # noqa: E741
            inside = lambda long, words=words: any(long[i : i + len(words)] == words for i in range(len(long) - len(words) + 1))
            if not any(g == lang and len(w) > len(words) and 100 * f >= 80 * a and inside(w) for (g, w), f in frequent.items()):
                found.append((-score, -a, " ".join(words).encode(), l, r))
        out += [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]  # noqa: E741
    return sorted(out)


def _texts(seed, n=400):
    r = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "New", "york", "City", "\x00", "a\x0bb"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "!?", " ", " ", " "]
    rows = []
    for i in range(n):
        size = int(r.integers(0, 60))
        words = [vocabulary[int(x)] for x in np.minimum(r.zipf(1.4, size) - 1, len(vocabulary) - 1)]
        if i % 3 == 0:
            words[5:5] = ["New", "York", "City", "hall"]
        rows.append(("".join(w + ends[int(e)] for w, e in zip(words, r.integers(0, len(ends), len(words)), strict=True)), [None, "en", "en", "de", "und"][i % 5]))
    return rows


def test_collocations(spark):
    rows = _texts(1) + [(None, "en"), ("", "en"), ("   ", "fr"), ("one two", "fr"), (None, None), ("a b c d " * 4000, "de"), ("same same " * 50, "es"), ("same same " * 50, "es")]
    df = spark.createDataFrame([(i, *x, "w", 1, 2) for i, x in enumerate(rows)], "doc_id long, text string, lang string, words string, chunk int, id int")
    want = brute_phrases(rows, 20, 15)
    assert len(want) > 30
    got = twelve.collocations(df, least=20, top=15)
    assert sorted(map(tuple, got.collect())) == want
    assert twelve.collocations(df.limit(0)).count() == 0
    assert twelve.collocations(df.where("doc_id < 3")).count() == 0  # nothing is frequent
    longer = twelve.collocations(df.repartition(3), least=30, top=10, longest=3)
    assert sorted(map(tuple, longer.collect())) == brute_phrases(rows, 30, 10, longest=3)


def test_dense_and_sparse_tiles_agree():
    r = np.random.default_rng(3)
    a, b = np.minimum(r.zipf(1.3, 50_000), 5000) + 100, np.minimum(r.zipf(1.2, 50_000), 2**31 - 2000)
    want = Counter(zip(a.tolist(), b.tolist(), strict=True))
    for side, dense in ((16, 50), (64, 1), (1024, 1 << 16), (8, 10**9)):
        x, y, n = twelve.tile_counts(a, b, side, dense)
        assert len(x) == len(want) and dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)) == want
    assert [len(x) for x in twelve.tile_counts(a[:0], b[:0])] == [0, 0, 0]


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts that no test table can hold, through the same columns."""
    big = 9 * 10**18
    rows = [("en", ["a"], big), ("en", ["b"], big), ("en", ["a", "b"], big - 1)]
    phrases = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    monkeypatch.setattr(twelve, "count_phrases", lambda *a: (phrases, spark.createDataFrame([("en", big)], "lang string, n long")))
    got = twelve.collocations(None).collect()
    assert [(r.phrase, r.a, r.score) for r in got] == [("a b", big - 1, 2_000_000 * (big - 1) // (2 * big))]


def test_streams_compress():
    """Ranks in planes come back as they were, and take less room than plain ones do."""
    r = np.random.default_rng(4)
    ranks = np.minimum(r.zipf(1.2, 1 << 18), 40_000).astype(np.int32) - 2
    for x in (ranks, ranks[:0], np.array([-1, 0, 255, 256, 2**31 - 2], np.int32), np.array([-1, 7 << 33, 2**62], np.int64)):
        assert (twelve.unplaned(twelve.planes(x), x.dtype.type) == x).all() and len(twelve.planes(x)) == x.nbytes
    packed = lambda x: len(twelve.pa.compress(x, "snappy", asbytes=True))
    assert packed(twelve.planes(ranks)) < 0.75 * packed(ranks.tobytes())


def test_shuffles_go_when_they_are_read(spark):
    """No step leaves its shuffle files to the next."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, setting = kept(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    df = spark.createDataFrame(_texts(2), "text string, lang string")
    twelve.count_phrases(df, 20)
    until = time.time() + 20
    while (left := kept() - before) and time.time() < until:  # files go in the background
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_collocations_query(spark, duck):
    same(twelve.op12_collocations(spark, f"{DATA}/sf0.001"), duck, twelve.SQL)
