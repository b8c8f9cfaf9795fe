"""Operators 2, 4 and 9 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from threadbook.llm import op2_suffix_dedup as two
from threadbook.llm import op4_ngram_join as four
from threadbook.llm import op9_substring_dedup as nine
from threadbook.llm import repeats

SCHEMA = "doc_id long, text string, part int, bucket string"  # part and bucket clash with names used inside


def corpus(seed=0, words=400):
    """Copies, near copies, shared passages and lines, and the odd cases."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "in", "er", "é", "on", "ba"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, passage, line = [], text(60), text(14)
    for i in range(40):
        kind = i % 8
        t = text(r.randint(1, words))
        if kind == 1:
            t = rows[i - 1][1]
        if kind == 2:
            w = rows[i - 2][1].split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = "edit"
            t = " ".join(w)
        if kind == 3:
            t = text(20) + "\n" + passage + "\t" + text(30)
        if kind == 4:
            t = line + "\n" + t + "  " + line
        if kind == 5:
            t = "ab " * r.randint(10, 300)
        rows.append((i, t))
    morse = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    rows += [(120, morse), (121, other), (122, " ".join([morse] * 40)), (123, " ".join([other] * 40))]  # polynomials modulo 2**64 do not tell these words apart
    rows += [(100, None), (101, ""), (102, "  \n\t "), (103, "two words"), (104, "Two WORDS"), (105, "x" * 49), (106, "x" * 50), (107, "x" * 200), (108, passage), (109, passage.upper()), (None, passage), (None, rows[0][1]), (7, rows[7][1]), (110, rows[3][1]), (110, rows[3][1]), (111, rows[0][1]), (111, text(50) + " " + passage), (112, text(80)), (0, text(70))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b") for i, t in rows], SCHEMA)


def shuffled(df):
    return df.repartition(5)


# ---------------------------------------------------------------- 2


def brute_bytes(rows):
    first = {}
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    data = [(t or "").encode() for _, t in rows]
    for i, b in zip(ids, data, strict=True):
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for (key, _), i, b in zip(rows, ids, data, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((key, len(b), sum(gone), len(re.findall(b"\1+", gone)), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "group"), [(100_000, 50_000), (2, 50_000), (100_000, 3)])
def test_suffix_dedup(spark, monkeypatch, hot, group):
    rows = corpus(1)
    monkeypatch.setattr(two, "KIND", repeats.Kind(**{**two.KIND.__dict__, "hot": hot, "group": group}))
    got = two.suffix_dedup(shuffled(frame(spark, rows))).collect()
    have = sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=str)
    assert have == brute_bytes(rows)


def test_suffix_dedup_empty(spark):
    assert two.suffix_dedup(frame(spark, [])).count() == 0


def test_deep_shallow_orders():
    r = np.random.default_rng(0)
    text = r.integers(97, 100, (500, 50)).astype(np.uint8)
    text[100:200] = text[0]
    text[200:300, :30] = text[1, :30]
    perm, head = np.arange(500), np.append(True, np.zeros(499, bool))
    two.deep_shallow(perm, head, text)
    ordered = [bytes(x) for x in text[perm]]
    assert ordered == sorted(bytes(x) for x in text)
    assert [i == 0 or ordered[i] != ordered[i - 1] for i in range(500)] == head.tolist()


# ---------------------------------------------------------------- 9


def brute_words(rows):
    each = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(w[s : s + 35]) for w in each for s in range(len(w) - 34))
    out = []
    for (key, _), w in zip(rows, each, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - 34):
            if n[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = [True] * 35
        out.append((key, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "group"), [(100_000, 50_000), (2, 50_000), (100_000, 3)])
def test_substring_dedup(spark, monkeypatch, hot, group):
    rows = corpus(2)
    monkeypatch.setattr(nine, "KIND", repeats.Kind(**{**nine.KIND.__dict__, "hot": hot, "group": group}))
    got = nine.substring_dedup(shuffled(frame(spark, rows))).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_words(rows)


def test_deep_nodes_are_the_maximal_repeats():
    r, least, reach = np.random.default_rng(0), 3, 20
    for _ in range(60):
        x = r.integers(1, 4, int(r.integers(1, 60))).astype(np.uint64)
        n = len(x)
        size = np.minimum(reach, n - np.arange(n))
        text = np.array([[x[i + c] if c < size[i] else 0 for c in range(reach)] for i in range(n)], np.uint64)
        perm, head = np.arange(n), np.arange(n) == 0
        repeats.refine(perm, head, text)
        first, last, depth = nine.deep_nodes(nine.common_words(text[perm], size[perm], np.arange(n) == 0), least)
        got = sorted((tuple(text[perm[a], :d].tolist()), b - a + 1) for a, b, d in zip(first.tolist(), last.tolist(), depth.tolist(), strict=True))
        places = {}
        for i in range(n):
            for k in range(least, size[i] + 1):
                places.setdefault(tuple(x[i : i + k].tolist()), []).append(i)
        after = lambda p, k: int(x[p + k]) if k < size[p] else ("end", p)
        assert got == sorted((w, len(at)) for w, at in places.items() if len({after(p, len(w)) for p in at}) > 1)


def test_prefixes_grow_until_groups_are_small():
    r = np.random.default_rng(0)
    flat = r.integers(0, 3, 5000).astype(np.uint64)
    flat[1000:1400] = 7  # one string too common for any prefix
    start = np.arange(4900)
    kind = repeats.Kind(**{**nine.KIND.__dict__, "group": 20})
    prefix, equal = repeats.lengthened(np.zeros(4900, np.int64), start, flat, kind)
    n = np.bincount(prefix)
    windows = np.array([flat[i : i + nine.WINDOW] for i in start])
    for g in np.flatnonzero(n):
        mine = windows[prefix == g]
        if equal[prefix == g].all():
            assert (mine == mine[0]).all()
        else:
            assert n[g] <= 20
    for w in np.unique(windows, axis=0):  # equal windows stay together
        assert len(np.unique(prefix[(windows == w).all(1)])) == 1


def test_equal_hashes_are_compared_by_symbol(spark, monkeypatch):
    real = repeats.C.mix
    monkeypatch.setattr(repeats.C, "mix", lambda x: real(x) & np.uint64(0xFFFFFF00000000FF))  # content hashes that often agree
    buf = np.frombuffer(" ".join(t or "" for _, t in corpus(5))[:20_000].encode() * 2, np.uint8)
    off = np.array([0, len(buf) // 2, len(buf)])
    part = repeats.Part(None, off, lambda a, b: repeats.C._BYTE[buf[a:b]], lambda i: buf[i], repeats.cut_pieces(lambda a, b: repeats.C._BYTE[buf[a:b]], off, two.KIND), np.array([1, 2]))
    every = repeats.C.Distinct.of(part.pieces.h, 1)
    note = repeats.pa.table({"part": [0], "kind": [repeats.SHARED], "bucket": [0], "data": [np.packbits(np.append(np.ones(len(every.h), bool), np.zeros(len(every.h), bool))).tobytes()]})
    s, first, which = repeats.unique_pieces(part, note, two.KIND, 1)
    text = lambda p, i: bytes(buf[p.lo[i] : p.hi[i] + two.WINDOW])
    assert all(text(s, i) == text(s, first[which[i]]) for i in range(len(s.lo)))


def test_substring_dedup_empty(spark):
    assert nine.substring_dedup(frame(spark, [])).count() == 0


def test_long_rows_are_cut_alike(monkeypatch):
    """Pieces of one very long row are those of its windows, wherever the numpy passes are cut."""
    monkeypatch.setattr(repeats, "_STEP", 100)
    buf = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    off = np.array([0, 3000, 3000, 3020, 5000])
    p = repeats.cut_pieces(lambda a, b: repeats.C._BYTE[buf[a:b]], off, two.KIND)
    seen = sorted(s for a, b in zip(p.lo, p.hi, strict=True) for s in range(a, b + 1))
    assert seen == [s for a, b in zip(off[:-1], off[1:], strict=True) for s in range(a, b - 49)]


# ---------------------------------------------------------------- 4


def brute_sets(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


@pytest.mark.parametrize("block", [1024, 3])
def test_ngram_components(spark, block):
    rows = corpus(3, 120)
    base = rows[10][1].split(" ")
    for i in range(30):  # a group around the threshold
        w = list(base)
        for k in range(i // 3):
            w[(7 * k + i) % len(w)] = f"e{i}"
        rows.append((200 + i, " ".join(w)))
    got = four.ngram_components(shuffled(frame(spark, rows)), block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_sets(rows)


def test_ngram_components_empty(spark):
    assert four.ngram_components(frame(spark, [])).count() == 0
    assert four.ngram_components(frame(spark, [(1, None), (2, " ")])).select("component_id").distinct().count() == 2


def test_overlaps_dense_and_sparse():
    r = np.random.default_rng(0)
    a = [np.unique(r.integers(0, 60, 30)).astype(np.uint64) for _ in range(12)]
    b = [np.unique(r.integers(0, 90, 40)).astype(np.uint64) for _ in range(9)]
    flat = lambda x: (np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x]), len(x))
    want = np.array([[len(np.intersect1d(x, y)) for y in b] for x in a])
    assert (four.overlaps(*flat(a), *flat(b)) == want).all()


def sets_of(texts, ids=None):
    token, off = four.shingle_sets(repeats.pa.array(texts))
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    rare = repeats.C.totals_of(token, np.ones(len(token), np.int64))
    flags = np.zeros(len(token), np.uint8)
    for i, seed in enumerate(four.ORDERS):
        tie = repeats.C.mix(token ^ np.uint64(seed))
        flags[np.lexsort((tie, rare, row) if i == 0 else (tie, row))[four._firsts(off, n - four.least_overlap(n) + 1)]] |= 1 << i
    return {"doc": np.arange(len(n)) if ids is None else np.array(ids), "n": n, "token": token, "flags": flags, "row": row}


def test_each_order_cuts_candidates():
    """Three orders leave fewer pairs than one, and near copies are joined without verifying their pairs."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts, family = [], []
    for k in range(80):  # groups of near copies; one of each shares two rare tokens with one of another group
        own, passage = [word() for _ in range(150)], [word() for _ in range(6)] if k % 2 == 0 else passage
        texts += [" ".join(own[:i] + [f"e{k}"] + own[i + 1 :] + (passage if i == 0 else [])) for i in range(3)]
        family += [3 * k] * 3
    counts: list[int] = []
    ids, label = four.link_forest(*[sets_of(texts)] * 2, counts)
    assert label.tolist() == family and counts[0] == 280 and counts[0] > counts[1] > counts[2] >= 240 and counts[3] < 240
    base, copies = [word() for _ in range(200)], []
    for i in range(300):
        copies.append(" ".join(base[:i] + ["edit"] + base[i + 1 :]) if i < 200 else " ".join([*base, f"x{i}"]))
    counts = []
    ids, label = four.link_forest(*[sets_of(copies)] * 2, counts)
    assert (label == 0).all() and counts[2] > 40_000 and counts[3] <= 300


def test_components_of_a_chain(spark):
    from threadbook.llm.common import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(100, 90), (90, 95)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 90: 90, 95: 90, 100: 90}


def test_digests_of_queries(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    got = {r.doc_id: r for r in two.op2_suffix_dedup(spark, d).collect()}
    for key, size, removed, spans, kept in brute_bytes(rows):
        r = got[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, removed, spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: r for r in nine.op9_substring_dedup(spark, d).collect()}
    for key, size, removed, kept in brute_words(rows):
        r = got[key]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (size, removed, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("module", [four, nine])
def test_queries_agree_with_sql(spark, duck, module):
    from tests.conftest import DATA, same

    name = module.__name__.rpartition(".")[2]
    same(getattr(module, name)(spark, f"{DATA}/sf0.001"), duck, module.SQL)
