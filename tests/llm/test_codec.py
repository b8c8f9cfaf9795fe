"""Operator 13 against the library that the vocabulary is made for."""

import hashlib
import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from threadbook.llm import op13_bpe_codec as thirteen


@pytest.fixture(scope="module")
def codec():
    return thirteen.Codec(thirteen.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(thirteen.VOCABULARY)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


ODD = ["ab", "a", "aab \n", "thein g", "0123456789 ", "🙂é日本 　", "-=_ #", "\U00013460\U0003d000͸꟱ a1", " \t\n\x1c\x85", "'sd'LLl ", "\x00\x7f"]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.sampled_from(ODD).flatmap(lambda a: st.text(alphabet=a, max_size=120))))
def test_encoding_is_the_librarys(codec, library, text):
    ids = codec.encode(text).tolist()
    assert ids == ids_of(library, text)
    assert codec.decode(thirteen.np.array(ids, thirteen.np.int64)) == text


def test_every_character(codec, library):
    for block in [*range(0, 0x34000, 0x800), 0x3D000, 0xE0000, 0xF0000, 0x10F800]:  # the rest is unassigned
        text = "".join(f"a{chr(c)}1!{chr(c)} {chr(c)}" for c in range(block, block + 0x800) if not 0xD800 <= c < 0xE000)
        assert codec.encode(text).tolist() == ids_of(library, text), hex(block)


def test_long_pieces_take_time_in_proportion(codec, library):
    r = random.Random(4)
    for text in ("a" * 300_000, " " * 300_000, "ab" * 150_000, "".join(r.choice("abcdefghij") for _ in range(300_000))):
        start = time.perf_counter()
        ids = codec.encode(text).tolist()
        assert time.perf_counter() - start < 10
        assert ids == ids_of(library, text)


def test_special_tokens_and_broken_ids(codec, library):
    text = "<|endoftext|>a <|endoftext|><|endoftext|> b<|endoftext"
    ids = codec.encode(text).tolist()
    assert ids == ids_of(library, text) and ids.count(50256) == 3
    for broken in ([0, 200, 188, 255], [50256, 99, 10_000_000, -5], []):
        known = [i for i in broken if 0 <= i < 50257]
        assert codec.decode(thirteen.np.array(broken, thirteen.np.int64)) == library.decode(known, skip_special_tokens=False)


def test_tokens_that_never_result_are_not_found(tmp_path):
    """With merges (b c), (a b), (ab c), the bytes of "abc" merge to a and bc."""
    letters = thirteen.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {"bc": 256, "ab": 257, "abc": 258, "abcd": 259}
    held = {"model": {"type": "BPE", "vocab": vocab, "merges": ["b c", "a b", "ab c", "abc d"]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(held))
    small = thirteen.Codec(str(path))
    assert [small.bytes[small.offsets[i] : small.offsets[i + 1]].tobytes() for i in small.encode("abcd abab").tolist()] == [b"a", b"bc", b"d", b" ", b"ab", b"ab"]
    held["model"]["merges"] = held["model"]["merges"][::-1]
    path.write_text(json.dumps(held))
    with pytest.raises(ValueError):
        thirteen.Codec(str(path))


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "dup"), (3, "dup"), (4, "long " * 50_000)]
    df = spark.createDataFrame([(i, t, "ids", 7, 8) for i, t in rows], "doc_id long, text string, ids string, decoded int, other int")
    got = thirteen.decode(thirteen.encode(df))
    assert set(got.columns) == {"doc_id", "text", "ids", "decoded", "other"}
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded == (r.text or "")) for r in got.collect()) == sorted((i or 0, len(ids_of(library, t or "")), True) for i, t in rows)
    assert thirteen.decode(thirteen.encode(df.limit(0))).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [64, None, 65, 999_999])], "doc_id long, ids array<int>")
    assert [r.decoded for r in thirteen.decode(lists).orderBy("doc_id").collect()] == [None, "ab"]


def test_codec_query(spark, library):
    want = set()
    for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect():
        ids = ids_of(library, r.text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = thirteen.op13_bpe_codec(spark, f"{DATA}/sf0.001")
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "string", "string"]
    assert {tuple(r) for r in got.collect()} == want
