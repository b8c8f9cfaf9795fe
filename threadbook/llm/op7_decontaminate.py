"""Benchmark decontamination: an FM-index for each shard of documents, searched for the windows of the benchmark items."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
WINDOW = 10
#: Bytes of benchmark text that go to the tasks at once, with some 22 bytes for each word of it; larger benchmarks take several passes.
MAX_BENCHMARK_BYTES = 8 << 20
#: Bytes of text in one shard, and the distance of sampled suffixes.
SHARD_BYTES = 4 << 20
SAMPLE = 8


# ---------------------------------------------------------------- phrases


@dataclass
class Phrases:
    """The distinct windows of the items, as places in the items' words."""

    vocabulary: np.ndarray  # sorted hashes; symbol i + 1 stands for the i-th
    words: np.ndarray  # symbols of all items, end to end
    start: np.ndarray  # of each phrase in words
    length: np.ndarray
    item_at: np.ndarray  # items of phrase i: items[item_at[i]:item_at[i + 1]]
    items: np.ndarray
    maybe: np.ndarray  # bits of the vocabulary's hashes


def phrases(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> Phrases:
    """Rows without an id or without words take no part."""
    rows = sorted((int(i), t) for i, t in rows if i is not None and t)
    ids = np.array([i for i, _ in rows], np.int64)
    buf, off = C.text_buffer(pa.array([t for _, t in rows], pa.string()))
    h, _, _, at = C.words(buf, off, C.ALNUM)
    vocabulary = np.unique(h)
    symbol = (np.searchsorted(vocabulary, h) + 1).astype(np.int32)
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    start, length, item = C.flat(at[:-1], count), np.repeat(np.minimum(n, window), count), np.repeat(ids, count)
    # equal windows, by their symbols, next to each other
    column = lambda c: np.where(c < length, symbol[np.minimum(start + c, len(symbol) - 1)], 0)
    by = np.lexsort((item, *(column(c) for c in range(window - 1, -1, -1)))) if len(start) else np.zeros(0, np.int64)
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in range(window):
        x = column(c)[by] if len(by) else new
        new[1:] |= x[1:] != x[:-1]
    again = np.append(False, (item[by][1:] == item[by][:-1]) & ~new[1:])[: len(by)]
    item_at = np.append(np.cumsum(~again)[new] - 1, np.count_nonzero(~again))
    maybe = np.zeros(1 << 20, bool)
    maybe[vocabulary >> U64(44)] = True
    first = by[new]
    return Phrases(vocabulary, symbol, start[first].astype(np.int32), length[first].astype(np.int16), item_at.astype(np.int32), item[by][~again], maybe)


# ---------------------------------------------------------------- index


class WaveletMatrix:
    """Access and rank over a sequence of small numbers, a bit a level."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.ranks, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (x >> level) & 1
            self.ranks.append(np.append(0, np.cumsum(bit)).astype(np.int64))
            self.zeros.append(len(x) - int(bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        a = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            bit = (c >> (self.bits - 1 - level)) & 1
            a = np.where(bit == 1, zeros + ones[a], a - ones[a])
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return i - a

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for ones, zeros in zip(self.ranks, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            c = c * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return c


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling. Zeros end the strings of the text and differ from each other."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()))
    order, k = np.argsort(rank, kind="stable"), 1
    rank_of = np.empty(n, np.int64)
    rank_of[order] = np.cumsum(np.append(0, rank[order][1:] != rank[order][:-1]))
    while n and rank_of[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank_of[k:] + 1
        key = rank_of * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank_of[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        k *= 2
    return order


class FMIndex:
    """Counts and places of phrases in a text whose strings end with 0."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        order = suffix_array(text)
        self.n = len(text)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=top + 1)))
        previous = np.where(order > 0, text[order - 1], 0)
        self.bwt = WaveletMatrix(previous, max(1, int(top).bit_length()))
        held = (order % sample == 0) | (previous == 0)
        self.held = np.append(0, np.cumsum(held))
        self.places = order[held]

    def search(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the phrases words[start:start + length], by backward search."""
        lo = np.zeros(len(start), np.int64)
        hi = np.full(len(start), self.n, np.int64)
        for back in range(1, int(length.max(initial=0)) + 1):
            on = np.flatnonzero((back <= length) & (lo < hi))
            if not len(on):
                break
            c = words[start[on] + length[on] - back].astype(np.int64)
            lo[on] = self.before[c] + self.bwt.rank(c, lo[on])
            hi[on] = self.before[c] + self.bwt.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: step back until a sampled suffix."""
        out, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            r = rows[left]
            got = self.held[r + 1] > self.held[r]
            out[left[got]] = self.places[self.held[r[got]]] + steps
            left, r = left[~got], r[~got]
            c = self.bwt.access(r)
            rows[left] = self.before[c] + self.bwt.rank(c, r)
            steps += 1
        return out


# ---------------------------------------------------------------- shards


def shard_hits(h: np.ndarray, at: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``h`` are the word hashes of a shard, ``at`` the row offsets. Returns which words are hit, and (row, item) pairs.

    Only runs of vocabulary words as long as the shortest phrase can hold an occurrence, so the index covers those.
    """
    n, hit = len(h), np.zeros(len(h), bool)
    none = np.zeros(0, np.int64)
    if not n or not len(p.length):
        return hit, none, none
    known = p.maybe[h >> U64(44)]
    symbol = np.zeros(n, np.int64)
    some = np.flatnonzero(known)
    place = np.minimum(np.searchsorted(p.vocabulary, h[some]), len(p.vocabulary) - 1)
    same = p.vocabulary[place] == h[some]
    symbol[some[same]] = place[same] + 1
    inside = symbol > 0
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < n]] = True
    run = np.cumsum(first | ~inside | np.append(True, ~inside[:-1]))
    keep = inside & (np.bincount(run, weights=inside)[run] >= p.length.min())
    words = np.flatnonzero(keep)
    if not len(words):
        return hit, none, none
    new = np.append(False, run[words][1:] != run[words][:-1])
    target = np.arange(len(words)) + np.cumsum(new)
    text = np.zeros(target[-1] + 2, np.int64)
    text[target] = symbol[words]
    origin = np.zeros(len(text), np.int64)
    origin[target] = words
    index = FMIndex(text, len(p.vocabulary))
    lo, hi = index.search(p.words, p.start, p.length)
    count = hi - lo
    which = np.repeat(np.arange(len(lo)), count)
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    start = origin[index.locate(rows)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + p.length[which], -1)
    hit = np.cumsum(edge)[:n] > 0
    doc = np.searchsorted(at, start, "right") - 1
    pair = np.unique(np.stack([doc, which]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
    many = p.item_at[pair[1] + 1] - p.item_at[pair[1]]
    items = p.items[np.repeat(p.item_at[pair[1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    both = np.unique(np.stack([np.repeat(pair[0], many), items]), axis=1)
    return hit, both[0], both[1]


SCHEMA = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, n_hit long, items array<long>"


def _shards(texts, p: Phrases):
    """For each shard of a column: its rows (a, b), byte buffer and offsets, word bounds, hits and items."""
    buf, off = C.text_buffer(texts)
    for a, b in C.chunked_rows(off, SHARD_BYTES):
        data, rows = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        h, starts, ends, at = C.words(data, rows, C.ALNUM)
        yield a, b, data, rows, starts, ends, at, *shard_hits(h, at, p)


def _runs(hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the maximal runs of hit words, cut at rows."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[at] = True
    first = np.flatnonzero(hit & (~np.append(False, hit)[:-1] | edge[:-1]))
    last = np.flatnonzero(hit & (~np.append(hit, False)[1:] | edge[1:]))
    return first, last


def _one_pass(docs: DataFrame, p: Phrases) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, _, rows, starts, ends, at, hit, doc, item in _shards(batch["text"], p):
                first, last = _runs(hit, at)
                cut = np.searchsorted(first, at)
                base = rows[np.searchsorted(at, first, "right") - 1]
                spans = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(starts[first] - base), pa.array(ends[last] - base)], ["start", "end"]))
                items = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32()), pa.array(item, pa.int64()))
                n_hit = np.diff(np.append(0, np.cumsum(hit))[at])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(np.diff(at)), spans, pa.array(n_hit), items], ["doc_id", "n_words", "spans", "n_hit", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def benchmark_groups(benchmark: DataFrame, limit: int) -> Iterator[Phrases]:
    """The benchmark's phrases in groups of about ``limit`` bytes of text, one after another: one group unless it is larger."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / limit))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for g in range(groups):
        yield phrases([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()])


def _passes(rows: DataFrame, first: Phrases, groups: Iterator[Phrases]) -> DataFrame:
    """What each group hits in the same texts. Each pass is written before the next group is read, so the driver holds one."""
    found = []
    for p in chain([first], groups):
        found.append(C.written(_one_pass(rows, p).where("n_hit > 0")))
    return C.tree_union(found)


def _merged(off: np.ndarray, spans: list[list[dict] | None]) -> np.ndarray:
    """By byte of all rows: whether a span of its row covers it."""
    edge = np.zeros(off[-1] + 1, np.int64)
    for i, row in enumerate(spans):
        for s in row or []:
            edge[off[i] + s["start"]] += 1
            edge[off[i] + s["end"]] -= 1
    return np.cumsum(edge) > 0


def find_contamination(docs: DataFrame, benchmark: DataFrame, limit: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """Returns one row per document row: doc_id, n_words, spans (byte runs of hit words, merged, end exclusive), n_hit
    (words hit) and items (ids of the items whose windows occur, ascending).

    Words are runs of letters, digits and non-ASCII characters with A-Z in lower case, compared by 64-bit hash. A window is 10
    consecutive words of an item, or all words of a shorter one. Null and empty texts have no words; items without
    words or with a null id take no part; items that share an id count once. Very long texts are whole shards of their own. Repeated document rows and null ids are
    kept. An empty table of documents gives no rows, an empty benchmark hits nothing. Other columns are ignored.
    """
    groups = benchmark_groups(benchmark, limit)
    first, second = next(groups), next(groups, None)
    if second is None:
        return _one_pass(docs, first)
    rows = C.written(docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), F.monotonically_increasing_id().alias("doc_id"), "text"))
    found = _passes(rows, first, chain([second], groups))
    joined = rows.select("key", F.col("doc_id").alias("row"), "text").join(found.groupBy(F.col("doc_id").alias("row")).agg(F.collect_list("spans").alias("all"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "row", "left")

    def merge(batches):
        for b in batches:
            buf, off = C.text_buffer(b["text"])
            starts, ends = C.word_bounds(buf, off, C.ALNUM[0])
            at = np.searchsorted(starts, off)
            hit = _merged(off, [[x for g in groups_ or [] for x in g] for groups_ in b["all"].to_pylist()])[starts]
            first, last = _runs(hit, at)
            base = off[np.searchsorted(at, first, "right") - 1]
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, at), pa.int32()), pa.StructArray.from_arrays([pa.array(starts[first] - base), pa.array(ends[last] - base)], ["start", "end"]))
            items = pa.array([x or [] for x in b["items"].to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(at)), spans, pa.array(np.diff(np.append(0, np.cumsum(hit))[at])), items], ["doc_id", "n_words", "spans", "n_hit", "items"])

    return joined.select(F.col("key.doc_id").cast("long").alias("doc_id"), "text", "all", "items").mapInArrow(merge, SCHEMA)


def strip_contamination(docs: DataFrame, benchmark: DataFrame, limit: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """The documents without their hit spans (a space stands for each) and with n_chars counted anew; all columns stay.

    Every group of a large benchmark is held against the texts as they are, and what any of them hits is cut at once. Null and empty texts
    stay as they are, very long ones are treated whole, repeated rows and null ids are kept, an empty table gives no rows, an empty
    benchmark cuts nothing.
    """
    groups = benchmark_groups(benchmark, limit)
    first, second = next(groups), next(groups, None)
    if second is None:
        out = docs.withColumn("text", _stripper(first)("text"))
    else:
        rows = C.written(docs.select(F.struct(*docs.columns).alias("held"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("doc_id")))
        found = _passes(rows, first, chain([second], groups)).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        out = rows.join(found, "doc_id", "left").select(F.col("held").withField("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_cutter("text", "spans"))).alias("held")).select("held.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _without(texts: pa.Array, data: np.ndarray, rows: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """Texts with a space for each run of bytes from ``first`` to ``end``; nulls stay."""
    gone = np.zeros(len(data) + 1, np.int64)
    gone[first] += 1
    np.add.at(gone, end, -1)
    keep = np.cumsum(gone)[:-1] == 0
    keep[first] = True
    data = data.copy()
    data[first] = 32
    made = C.binary_rows(data[keep], np.append(0, np.cumsum(keep))[rows], pa.string())
    return pa.array([None if not v else m for v, m in zip(texts.is_valid().to_pylist(), made.to_pylist(), strict=True)], pa.string())


def _stripper(p: Phrases):
    def clean(texts: pa.Array) -> pa.Array:
        parts = []
        for a, b, data, rows, starts, ends, at, hit, _, _ in _shards(texts, p):
            if not hit.any():
                parts.append(texts.slice(a, b - a))
                continue
            first, last = _runs(hit, at)
            parts.append(_without(texts.slice(a, b - a), data, rows, starts[first], ends[last]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(clean, "string")


def _cutter(text: str, spans: str):
    def clean(texts: pa.Array, spans: pa.Array) -> pa.Array:
        buf, off = C.text_buffer(texts)
        starts, ends = C.word_bounds(buf, off, C.ALNUM[0])
        hit = _merged(off, spans.to_pylist())[starts]
        first, last = _runs(hit, np.searchsorted(starts, off))
        return _without(texts, buf, off, starts[first], ends[last])

    return F.arrow_udf(clean, "string")(text, spans)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = find_contamination(read("documents"), read("benchmark"))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(listed, "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT item_id, r, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM b),
bg AS (SELECT item_id, n, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS key FROM bw),
p AS (SELECT DISTINCT item_id, least(n, 10) AS size, key FROM bg WHERE i <= greatest(n - 9, 1)),
dw AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
dg AS (SELECT r, i, string_agg(word, ' ') OVER f AS key, count(*) OVER f AS n FROM dw WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
q AS (SELECT r, i, z.size, CASE WHEN z.size = n THEN key ELSE array_to_string(list_slice(string_split(key, ' '), 1, z.size), ' ') END AS key FROM dg JOIN (SELECT DISTINCT size FROM p) z ON n >= z.size),
o AS (SELECT r, i, item_id, size FROM q JOIN p USING (size, key)),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + size - 1)) AS i FROM o) GROUP BY r),
x AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT r, item_id FROM o) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)
"""
