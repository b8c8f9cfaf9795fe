"""Trigger patterns: required words, the linear form and the index, against Python's own matcher."""

import re
import time
import warnings

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadbook.functions import patterns
from threadbook.functions.patterns import PatternIndex, analysed, folded, found
from threadbook.operators import ingest, lessons

ATOMS = ["a", "b", "K", "s", "i", "7", " ", "_", "-", ".", r"\.", r"\d", r"\w", r"\s", r"\D", r"\W", r"\S", "[ab]", "[^a]", "[a-f]", "[^k-t]", "[A-C_]", r"[\d_]", r"[^\w-]", r"[\s,]", "^", "$", r"\b", r"\B", r"\A", r"\Z", "é", "日", "ſ", "(?=a)", "(?!b)", "(?<=s)", r"\n", "foo", "Bar"]
_atom = st.sampled_from(ATOMS)
_pattern = st.recursive(
    _atom,
    lambda p: st.one_of(
        st.lists(p, min_size=1, max_size=4).map("".join),
        st.lists(p, min_size=2, max_size=3).map(lambda x: f"(?:{'|'.join(x)})"),
        p.map(lambda x: f"({x})"),
        st.tuples(p, st.sampled_from(["*", "+", "?", "*?", "{2}", "{1,2}", "{0,3}", "++"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
    ),
    max_leaves=6,
)
_text = st.text(alphabet="abKksSiIſıİK7 _-.\n\tfoBarRé日x\x1c\x85", max_size=24)


@settings(max_examples=600, deadline=None)
@given(_pattern, st.lists(_text, min_size=1, max_size=4), st.sampled_from(["", "(?s)", "(?m)", "(?x)"]))
def test_analysis_agrees_with_the_matcher(pattern, texts, flags):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        p = analysed(flags + pattern)
        if p is None:
            with pytest.raises((re.error, OverflowError)):
                re.compile(flags + pattern, re.IGNORECASE)
            return
        want = [re.search(flags + pattern, t, re.IGNORECASE) is not None for t in texts]
        assert found(p, pa.array(texts)) == want
        if p.words is not None:
            assert all(any(w in folded(t) for w in p.words) for t, hit in zip(texts, want, strict=True) if hit)


def test_required_words():
    words = lambda p: analysed(p).words
    assert words("DROP TABLE") == {"drop table"}
    assert words("PURCHASE|ERROR") == {"purchase", "error"}
    assert words(r"rm\s+-rf?\s+/(home|etc)") == {"home", "etc"} or words(r"rm\s+-rf?\s+/(home|etc)") == {"/home", "/etc"}
    assert words('"K": [ab][0-9]') == {'"k": a', '"k": b'}
    assert words("(a|b)*c") is None and words(".*") is None and words("x?y?") is None
    assert words("(?:foo)+bar") == {"foo"} or words("(?:foo)+bar") == {"bar"}


def test_no_text_is_too_long_for_the_linear_matcher():
    long = "ab" * 500_000
    for pattern, text, hit in (("(a|b)*c", long, False), ("(a|b)*c", long + "c", True), (r"(a|b)*c\d", "c" + long, False), ("(a*)*x$", long, False), ("(x+x+)+y", "x" * 1_000_000, False), (r"(\w+\s?)+!", "word " * 200_000, False)):
        p, start = analysed(pattern), time.perf_counter()
        assert p.linear is not None
        assert found(p, pa.array([text])) == [hit]
        assert time.perf_counter() - start < 5


def test_patterns_that_backtrack_have_a_bound(monkeypatch):
    monkeypatch.setattr(patterns, "PATIENCE", 0.3)
    p, start = analysed(r"(x+x+)+(?=y)"), time.perf_counter()
    assert p.linear is None and found(p, pa.array(["x" * 60, "xxxy"])) == [False, True]
    assert time.perf_counter() - start < 3


def test_index_gives_the_first_hits_and_tests_few_pairs():
    rules = [((n % 3, n), (("", "Bash", "Edit")[n % 3], None if n % 2 else "p"), None if n % 997 == 5 else f"word{n}x.*end|other{n}[0-9]") for n in range(50_000)]
    texts = [f"say word{n * 7}x and the end or OTHER{n}4" for n in range(2000)]
    keys = [[(t, p) for t in ("", "Bash") for p in (None, "p")] if n % 2 else [("", None), ("", "p")] for n in range(2000)]
    index = PatternIndex([(place, key, text and analysed(text)) for place, key, text in rules], 5)
    start = time.perf_counter()
    hits = index.match(texts, keys)
    assert time.perf_counter() - start < 20
    assert index.tested < len(texts) * len(rules) // 10_000
    compiled = [(place, key, text) for place, key, text in sorted(rules)]
    for n in range(0, 2000, 400):
        want = [place for place, key, text in compiled if key in keys[n] and (text is None or re.search(text, texts[n], re.IGNORECASE))][:5]
        assert hits[n] == want


def _calls(spark, rows):
    return spark.createDataFrame(rows, "call_id long, tool_name string, project string, preview string")


def test_long_previews_do_not_fail_the_job(spark):
    rules = spark.createDataFrame([(1, None, "critical", "r", None, "(a|b)*c", True), (2, None, "info", "s", None, "b{3}", True)], "id long, project_id long, severity string, rule string, trigger_tool string, trigger_pattern string, active boolean")
    projects = spark.createDataFrame([(1, "p")], "id long, name string")
    calls = _calls(spark, [(1, "Bash", "p", "ab" * 500_000), (2, "Bash", None, "ab" * 500_000 + "c"), (3, None, "q", "bbb")])
    got = {(r.call_id, r.rank, r.lesson_id) for r in lessons.match_lessons(calls, rules, projects).collect()}
    assert got == {(2, 1, 1), (3, 1, 2)}
    assert lessons.match_lessons(calls, rules.limit(0), projects).count() == 0 and lessons.match_lessons(calls.limit(0), rules, projects).count() == 0


def test_passes_agree(spark):
    projects = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "id long, name string")
    given = [(i, i % 4 if i % 3 else None, ("critical", "warning", "info", "odd")[i % 4], f"r{i}", (None, "Bash", "Edit")[i % 3], (f"w{i % 9}", None, f"w{i % 5}|v{i % 7}", "w[0-3]", r"(?<=w)\d")[i % 5], i % 11 > 0) for i in range(120)]
    rules = spark.createDataFrame(given, "id long, project_id long, severity string, rule string, trigger_tool string, trigger_pattern string, active boolean")
    calls = _calls(spark, [(i, (None, "Bash", "Edit")[i % 3], (None, "p1", "p2", "x")[i % 4], None if i == 7 else f"W{i % 10} v{i % 8}") for i in range(60)])
    one = sorted(map(tuple, lessons.match_lessons(calls, rules, projects, k=4).collect()))
    assert one and one == sorted(map(tuple, lessons.match_lessons(calls, rules, projects, k=4, limit_rows=9).collect()))
    assert one == sorted(map(tuple, lessons.match_lessons(calls, rules, projects, k=4, limit_bytes=64).collect()))
    level = {"critical": 0, "warning": 1, "info": 2}
    for call, tool, project, preview in [tuple(r) for r in calls.collect()]:
        hit = [(level.get(s, 3), i) for i, p, s, _, t, pattern, active in given if active and t in (None, tool) and (p is None or f"p{p}" == project) and (pattern is None or re.search(pattern, preview or "", re.IGNORECASE))]
        assert [r[2] for r in one if r[0] == call] == [i for _, i in sorted(hit)[:4]]


def test_every_pattern_that_compiles_is_taken(spark):
    given = ["(?P<x>a)", r"a\Z", "(", "x" * 501, None, "(?P<x>a)(?P=x)", r"(?<!a)b"]
    df = spark.createDataFrame([(p,) for p in given], "trigger_pattern string")
    assert [r.pattern_ok for r in ingest.validate_trigger_pattern(df).collect()] == [True, True, False, False, True, True, True]
