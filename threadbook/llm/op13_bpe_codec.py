"""BPE encoding and decoding: a backtracking encoder over Aho-Corasick matches and a table of compatible pairs; decoding by an offset table."""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat

#: Where the driver finds the vocabulary; it travels to the executors.
VOCABULARY = os.environ.get("THREADBOOK_BPE", "/opt/tokenizers/byte_bpe_50k.json")
# Fixed value: the published split pattern of byte-level vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts without other characters.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Entries that the pair table, and the memory of pieces, hold before they start anew; longer pieces are not remembered.
PAIRS, PIECES, LONG_PIECE = 1 << 20, 1 << 19, 64
NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The character that stands for each byte in a vocabulary file: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(prints))}
    return [chr(others.get(b, b)) for b in range(256)]


@cache
def _kind(c: str) -> str:
    """A character of the same class, for one whose class depends on the Unicode version: the library itself says which it is."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return next((like for like in "a1!" if len(split.pre_tokenize_str(like + c)) == 1), " ")


#: Characters seen so far, and those among them that this Python's tables have not got.
_seen: set[str] = set()
_newer: set[str] = set()


def pieces_of(text: str) -> list[str]:
    """The pieces that merges never cross."""
    if text.isascii():
        return ASCII_PATTERN.findall(text)
    held = set(text)
    for c in held - _seen:
        _seen.add(c)
        if unicodedata.category(c) == "Cn":
            _newer.add(c)
    if odd := held & _newer:
        like = text.translate({ord(c): _kind(c) for c in odd})
        return [text[m.start() : m.end()] for m in PATTERN.finditer(like)]
    return PATTERN.findall(text)


class Pieces(dict):
    """The tokens of pieces, as the bytes of their ids; a new piece is merged when it is first asked for."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode())
        made = struct.pack(f"<{len(ids)}i", *ids)
        if len(piece) <= LONG_PIECE:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = made
        return made


class Codec:
    """A byte-level vocabulary whose ids are in the order of merges."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, letters = held["model"], byte_letters()
        if model["type"] != "BPE" or model.get("dropout") or held.get("normalizer") or model.get("ignore_merges") or (held.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or held["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("the vocabulary is not a plain byte-level one")
        byte_of, vocab = {c: b for b, c in enumerate(letters)}, model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(set(made)) or (made and max(vocab[c] for c in letters) > made[0]):
            raise ValueError("ids are not in the order of merges")
        size = 1 + max([*vocab.values(), *(t["id"] for t in held.get("added_tokens", []))])
        token = [b""] * size
        for name, i in vocab.items():
            token[i] = bytes(byte_of[c] for c in name)
        self.special = {}
        for t in held.get("added_tokens", []):
            if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens must be plain strings")
            self.special[t["content"]] = t["id"]
            token[t["id"]] = t["content"].encode()
        self._cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.length = [len(t) for t in token]
        self.offsets = np.cumsum([0, *self.length])
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.left, self.right, self.pairs = [-1] * size, [-1] * size, {}
        for (a, b), i in zip(merges, made, strict=True):
            self.left[i], self.right[i] = vocab[a], vocab[b]
            self.pairs[vocab[a], vocab[b]] = i
        self._find, whole = ahocorasick.Automaton(), {vocab[c] for c in letters}
        for i in made:  # a token that its own bytes do not merge to is never in a result
            if self.left[i] in whole and self.right[i] in whole and self._border_holds(self.left[i], self.right[i], i):
                whole.add(i)
        by_bytes = {token[i]: i for i in whole}
        self.shorter = [-1] * size
        for i in whole:
            self.shorter[i] = next((by_bytes[token[i][:n]] for n in range(self.length[i] - 1, 0, -1) if token[i][:n] in by_bytes), -1)
            self._find.add_word(token[i].decode("latin-1"), i)
        self._find.make_automaton()
        self._most = max(self.length[i] for i in whole)
        self._compatible: dict[int, bool] = {}
        self._known = Pieces(self.merge)

    def _border_holds(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether tokens a and b, side by side, come out of merging their bytes: no merge over the border, among those that are earlier than
        ``before``, has its turn before what stands at the border there is merged into a or b. Merges are undone from both sides, the last one first.
        """
        into_a = into_b = before
        while True:
            over = self.pairs.get((a, b), NEVER)
            if over < into_a and over <= into_b and over < before:
                return False
            if self.right[a] >= 0 and (a > b or self.left[b] < 0):
                into_a, a = a, self.right[a]
            elif self.left[b] >= 0:
                into_b, b = b, self.left[b]
            else:
                return True

    def _looked_up(self, a: int, b: int) -> bool:
        """A new entry of the pair table."""
        if len(self._compatible) >= PAIRS:
            self._compatible.clear()
        held = self._compatible[a << 32 | b] = self._border_holds(a, b)
        return held

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece. From each place the longest token that goes with the one before is taken, else a shorter one, else the one before is
        given up and its place is closed; so no place is tried twice with one token.
        """
        length, shorter, most, known, longest = self.length, self.shorter, self._most, self._compatible.get, self._find.iter_long
        n, text = len(piece), piece.decode("latin-1")
        first = [i for _, i in longest(text)]  # the longest token, and from its end again: what happens as long as all go together
        out, at, last = [], 0, -1
        for token in first:
            if last >= 0:
                fits = known(last << 32 | token)
                if not (fits if fits is not None else self._looked_up(last, token)):
                    break
            out.append(token)
            last = token
            at += length[token]
        else:
            return out
        is_open, token = bytearray(b"\1") * (n + 1), shorter[token]
        while at < n:
            while token >= 0:
                if is_open[at + length[token]]:
                    if last < 0:
                        break
                    fits = known(last << 32 | token)
                    if fits or (fits is None and self._looked_up(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last = token
                at += length[token]
                token = next(longest(text[at : at + most]))[1] if at < n else -1
            else:
                is_open[at] = 0
                at -= length[out.pop()]
                token = shorter[last]
                last = out[-1] if out else -1
        return out

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._known.__getitem__, pieces_of(text)))

    def encode(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self._cut.finditer(text) if self._cut else ():
            out += [self._plain(text[at : m.start()]), struct.pack("<i", self.special[m[0]])]
            at = m.end()
        out.append(self._plain(text[at:] if at else text))
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The bytes of the tokens by their offsets. Ids that the vocabulary has not got are nothing, broken UTF-8 is replaced."""
        ids = ids[(ids >= 0) & (ids < len(self.length))]
        at = self.offsets[ids]
        return self.bytes[flat(at, self.offsets[ids + 1] - at)].tobytes().decode("utf-8", "replace")


@cache
def _codec(name: str) -> Codec:
    return Codec(SparkFiles.get(name))


def _shipped(df: DataFrame, path: str) -> str:
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, text: str = "text", to: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """The rows with ``to``, the ids of the text's tokens (array of int). Strings of special tokens in a text become those tokens.

    Null and empty texts have no tokens. Very long texts, and very long pieces in them, are encoded whole, in time in proportion to their length. Repeated rows and null ids
    stay as they are, an empty table gives no rows, other columns stay; one that is called ``to`` is replaced. There is no shuffle.
    """
    name = _shipped(docs, path)

    def run(texts: pa.Array) -> pa.Array:
        codec, off, ids = _codec(name), [0], []
        for t in texts:
            ids.append(codec.encode(t.as_py()) if t.is_valid else np.zeros(0, np.int32))
            off.append(off[-1] + len(ids[-1]))
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))

    return docs.withColumn(to, F.arrow_udf(run, "array<int>")(F.col(text).cast("string")))


def decode(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """The rows with ``to``, the text of the tokens. Null ids give a null text; a null among the ids, or one that is not in the vocabulary, is left out."""
    name = _shipped(df, path)

    def run(lists: pa.Array) -> pa.Array:
        codec, out = _codec(name), []
        for x in lists:
            out.append(codec.decode(x.values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)) if x.is_valid else None)
        return pa.array(out, pa.string())

    return df.withColumn(to, F.arrow_udf(run, "string")(F.col(ids).cast("array<int>")))


def op13_bpe_codec(spark, sf_dir: str) -> DataFrame:
    made = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(listed).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


#: Merging is beyond SQL; tests hold it against the library that the vocabulary is made for.
SQL = None
