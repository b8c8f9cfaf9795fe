"""Suffix-array dedup of bytes by deep-shallow sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .repeats import NO_ID, Kind, Part, _shared_slots, find_repeats, refine

WINDOW = 50
#: Bytes to which the multikey quicksort goes, in words of eight.
SHALLOW = 16


def multikey_quicksort(perm: np.ndarray, head: np.ndarray, words: np.ndarray) -> None:
    """Three-way radix quicksort of the rows of each group by their words, all groups at once:
    each round splits every unsorted run at a pivot into less, equal and greater; equal runs go one word deeper.
    """
    act = _shared_slots(np.arange(len(perm)), head)
    depth = np.zeros(len(perm), np.int64)
    while len(act):
        rows, h = perm[act], head[act]
        starts = np.flatnonzero(h)
        sizes = np.diff(np.append(starts, len(act)))
        g = np.cumsum(h) - 1
        d = depth[act]
        key = words[rows, d]
        pivot = key[starts + sizes // 2][g]
        side = (key > pivot).astype(np.int64) + (key >= pivot)
        o = np.argsort(g * 3 + side, kind="stable")
        g, side = g[o], side[o]
        perm[act] = rows[o]
        depth[act] = d[o] + (side == 1)
        head[act] = np.append(True, (g[1:] != g[:-1]) | (side[1:] != side[:-1]))
        act = _shared_slots(act, head)
        act = act[depth[act] < words.shape[1]]


def deep_shallow(perm: np.ndarray, head: np.ndarray, text: np.ndarray, size: np.ndarray | None = None, shallow: int = SHALLOW) -> None:
    """Multikey quicksort to ``shallow`` bytes; blind tries order the groups that still agree there."""
    words = np.ascontiguousarray(text[:, :shallow]).view(">u8").astype(np.uint64)
    multikey_quicksort(perm, head, words)
    refine(perm, head, text)


KIND = Kind(window=WINDOW, anchor=24, symbol=np.uint8, by_first=True, sort=deep_shallow, reach=WINDOW)
SCHEMA = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _load(table: pa.Table) -> Part:
    buf, off = C.text_buffer(table["text"])
    ids = np.array([NO_ID if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
    return Part(table, off, lambda a, b: C._BYTE[buf[a:b]], lambda i: buf[i], None, ids)


def _finish(table: pa.Table, part: Part, cover: np.ndarray, own: np.ndarray, copied: np.ndarray) -> pa.Table:
    buf, off = C.text_buffer(table["text"])
    size = np.diff(off)
    gone = np.repeat(~own & (size >= WINDOW), size)
    gone[np.repeat(own, size)] = cover
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.append(False, gone)[:-1]
    start = np.flatnonzero(gone & (~before | edge[:-1]))
    end = np.flatnonzero(gone & (~np.append(gone, False)[1:] | edge[1:])) + 1
    at = np.searchsorted(start, off)
    base = off[np.searchsorted(off, start, "right") - 1]
    spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"]))
    kept = np.append(0, np.cumsum(~gone))[off]
    return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(size, pa.int64()), "spans": spans, "kept": C.binary_rows(buf[~gone], kept)})


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Removes each byte that lies in a 50-byte string which also starts in a document with a smaller doc_id.

    Returns one row per input row: doc_id, n_bytes, spans (removed byte runs, end exclusive) and kept (the other bytes).
    Null and empty texts have 0 bytes; texts under 50 bytes stay whole; very long ones are looked at in full, a step at a time. Rows with a null doc_id come after all
    others and never count as smaller; rows that share a doc_id do not remove from each other. Repeats inside one
    document stay. An empty table gives no rows; other columns are ignored.
    """
    return find_repeats(docs, KIND, _load, _finish, SCHEMA)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, doc_id, k, substr(x, 2000 * k + 1, 2098) AS y FROM (SELECT r, doc_id, x, unnest(generate_series(0, (len(x) // 2 - 50) // 1000)) AS k FROM d WHERE len(x) >= 100)),
w AS (SELECT r, doc_id, 1000 * k + i AS i, substr(y, 2 * i - 1, 100) AS s FROM (SELECT r, doc_id, k, y, unnest(generate_series(1, least(1000, len(y) // 2 - 49))) AS i FROM c)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT w.r, w.i FROM w JOIN f USING (s) WHERE f.first < w.doc_id),
n AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM h),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM n),
z AS (SELECT r, min(i) AS a, max(i) + 49 AS b FROM g GROUP BY r, k),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM z),
q AS (SELECT r, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * prev + 1, 2 * (a - 1 - prev)), '' ORDER BY a) AS before FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(before || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN q USING (r)
"""
