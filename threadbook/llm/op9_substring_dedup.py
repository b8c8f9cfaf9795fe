"""Substring dedup of words by prefix-partitioned suffix trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .repeats import NO_ID, Kind, Part, find_repeats, refine

WINDOW = 35

#: Words of the minimizer that names a window's bucket.
ANCHOR = 8


def common_words(text: np.ndarray, size: np.ndarray, head: np.ndarray) -> np.ndarray:
    """How many words each suffix, in order, has in common with the one before; 0 where a group starts."""
    out = np.zeros(len(text), np.int64)
    if len(text) > 1:
        differs = text[1:] != text[:-1]
        first = np.where(differs.any(1), differs.argmax(1), text.shape[1])
        out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    out[head] = 0
    return out


def deep_nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The internal nodes of a suffix tree that are at least ``least`` deep, from its leaves in order and what neighbours have in common:
    first and last leaf, and depth. The path to a node is a repeat that no longer one has all the occurrences of.
    """
    first, last, depth = [], [], []
    runs = np.flatnonzero(np.diff(np.concatenate([[0], common >= least, [0]]).astype(np.int8)))
    for a, b in runs.reshape(-1, 2).tolist():  # leaves a - 1 to b - 1 are below one such node
        open_nodes: list[tuple[int, int]] = []  # depth and first leaf, deeper ones last
        for leaf, d in enumerate([*common[a:b].tolist(), 0], a):
            at = leaf - 1
            while open_nodes and open_nodes[-1][0] > d:
                k, at = open_nodes.pop()
                first.append(at)
                last.append(leaf - 1)
                depth.append(k)
            if d >= least and (not open_nodes or open_nodes[-1][0] < d):
                open_nodes.append((d, at))
    return tuple(np.array(x, np.int64) for x in (first, last, depth))


def grow_subtrees(perm: np.ndarray, head: np.ndarray, text: np.ndarray, size: np.ndarray) -> None:
    """Orders the suffixes of each prefix and builds the subtree below it. What stays together is what is below one deep node."""
    group = head.copy()
    refine(perm, head, text)
    first, last, _ = deep_nodes(common_words(text[perm], size[perm], group), WINDOW)
    joined = np.zeros(len(head) + 1, np.int64)
    np.add.at(joined, first + 1, 1)
    np.add.at(joined, last + 1, -1)
    head[:] = np.cumsum(joined)[:-1] == 0


# The suffixes of a bucket have prefixes of variable length: the minimizer of their first WINDOW words and its offset, then as many words as
# make the group small enough (``lengthened``); what is too common for one bucket has the whole window for its prefix.
KIND = Kind(window=WINDOW, anchor=ANCHOR, symbol=np.uint64, by_first=False, sort=grow_subtrees, reach=2 * WINDOW - ANCHOR)
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def _load(table: pa.Table) -> Part:
    buf, off = C.text_buffer(table["text"])
    h, cuts = [], [np.zeros(1, np.int64)]
    for a, b in C.chunked_rows(off):
        hh, _, _, at = C.words(buf[off[a] : off[b]], off[a : b + 1] - off[a], C.PLAIN)
        h.append(hh)
        cuts.append(at[1:] + cuts[-1][-1])
    h = np.concatenate(h) if h else np.zeros(0, np.uint64)
    ids = np.array([NO_ID if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
    return Part(table, np.concatenate(cuts), lambda a, b: h[a:b], lambda i: h[i], None, ids)


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row (from at[i] to at[i+1]) joined by one space: bytes and row offsets."""
    size = ends - starts
    n = np.diff(at)
    gaps = np.maximum(n - 1, 0)
    out_off = np.append(0, np.cumsum(np.append(0, np.cumsum(size))[at][1:] - np.append(0, np.cumsum(size))[at][:-1] + gaps))
    out = np.full(out_off[-1], 32, np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(size)) - at[row]
    before = np.cumsum(size) - size
    first = out_off[:-1][row] + (before - before[at[row]] if len(size) else before) + inner
    idx = np.arange(size.sum())
    out[np.repeat(first - before, size) + idx] = buf[np.repeat(starts - before, size) + idx]
    return out, out_off


def _finish(table: pa.Table, part: Part, cover: np.ndarray, own: np.ndarray, copied: np.ndarray) -> pa.Table:
    buf, off = C.text_buffer(table["text"])
    cuts = np.zeros(len(own) + 1, np.int64)
    cuts[1:] = np.cumsum(own)
    n_words, n_removed, kept = [], [], []
    for a, b in C.chunked_rows(off):
        data, rows = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        starts, ends = C.word_bounds(data, rows, C.PLAIN[0])
        at = np.searchsorted(starts, rows)
        n = np.diff(at)
        gone = np.repeat((~own[a:b] | copied[a:b]) & (n >= WINDOW), n)
        mine = np.repeat(own[a:b], n)
        gone[mine] |= cover[part.off[cuts[a]] : part.off[cuts[b]]]
        left = np.append(0, np.cumsum(~gone))[at]
        text, text_off = joined_words(data, starts[~gone], ends[~gone], left)
        n_words.append(n)
        n_removed.append(n - np.diff(left))
        kept.append(C.binary_rows(text, text_off, pa.string()))
    flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    return pa.table({"doc_id": table["doc_id"], "n_words": flat(n_words), "n_removed": flat(n_removed), "kept": pa.chunked_array(kept, pa.string())})


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Removes each word of a 35-word window whose words also occur, in that order, anywhere else.

    Returns one row per input row: doc_id, n_words, n_removed and kept (the other words joined by one space).
    Null and empty texts have no words; texts under 35 words stay whole; very long ones, and very long words, are looked at in full.
    Words are compared by 64-bit hash. Every occurrence goes, the first too,
    and overlapping occurrences in one document count. Repeated rows are occurrences of each other; a null doc_id
    is an ordinary row. An empty table gives no rows; other columns are ignored.
    """
    return find_repeats(docs, KIND, _load, _finish, SCHEMA)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, word, string_agg(word, ' ') OVER f AS key, count(*) OVER f AS n FROM t WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
k AS (SELECT key FROM g WHERE n = 35 GROUP BY key HAVING count(*) > 1),
f AS (SELECT g.r, g.i, g.word, CASE WHEN n = 35 AND k.key IS NOT NULL THEN 1 ELSE 0 END AS again FROM g LEFT JOIN k ON k.key = g.key),
c AS (SELECT r, i, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT r, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY r)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (r)
"""
