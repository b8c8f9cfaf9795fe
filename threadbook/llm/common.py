"""Shared helpers of the training-data operators: the shared folder, Arrow text buffers,
vectorised word hashes, and the hash exchange that several operators use.

A word's hash sums, over its eight-byte lanes, a mixed value of lane and place, so that no structure of
long words cancels out. Hashes of runs of symbols are polynomials modulo 2**64 over such values, for runs of up to some
seventy symbols. They choose where rows go and which rows are compared.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cleared, dropped, mark, shared_dir, shuffles_dropped, written

__all__ = ["cleared", "dropped", "mark", "shared_dir", "shuffles_dropped", "written"]

U64 = np.uint64
#: Bytes of text that one numpy pass handles at once.
CHUNK = 1 << 20
#: Bytes of text in one part of the corpus, at most on average.
PART_BYTES = 8 << 20
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


# ---------------------------------------------------------------- session


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(docs: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> int:
    """So many parts that one holds ``part_bytes`` of text on average, at least the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), math.ceil(total / part_bytes))


def part_of(col: str | F.Column, parts: int) -> F.Column:
    return F.pmod(F.xxhash64(col), F.lit(parts)).cast("int")


def parted(docs: DataFrame, parts: int) -> DataFrame:
    """part, doc_id and text. Rows that share an id, or have none, are dealt by their texts as well."""
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return one.select(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(parts)).cast("int").alias("part"), "doc_id", "text")


def tree_union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


# ---------------------------------------------------------------- Arrow


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null rows are empty."""
    arr = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunked_rows(off: np.ndarray, limit: int = CHUNK):
    """Consecutive row ranges (a, b) that hold about ``limit`` bytes each, one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def binary_rows(data: np.ndarray, off: np.ndarray, kind=None) -> pa.Array:
    """An Arrow binary (or string) array over ``data`` cut at ``off``."""
    kind = kind or pa.binary()
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of the splitmix generator."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK + 4096)
        for key, base in (("p", _BASE), ("q", _INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["p"][:n], _powers["q"][:n]


class Rolling:
    """Hashes of any slice of a symbol array (uint64), by prefix sums."""

    def __init__(self, symbols: np.ndarray):
        p, self.inverse = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * p[:-1], out=self.sums[1:])

    def raw(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def every(self, k: int) -> np.ndarray:
        """Mixed hash of each slice of k symbols."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, U64)


def _table(separators: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are in words, and what each byte counts as."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    same = np.arange(256, dtype=np.uint8)
    if fold:
        same[65:91] += 32
    return inside, same


#: Words [^\x20\x09-\x0D]+ unchanged; the same with A-Z in lower case; and runs of letters, digits and non-ASCII.
PLAIN = _table(_SPACES, False)
FOLDED = _table(_SPACES, True)
ALNUM = _table(bytes(i for i in range(128) if not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123)), True)


def word_bounds(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words; a word never crosses a row."""
    is_word = inside[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = is_word
    before[off[:-1]] = False
    starts = np.flatnonzero(is_word & ~before[:-1])
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = is_word
    after[off[1:]] = False
    ends = np.flatnonzero(is_word & ~after[1:]) + 1
    return starts, ends


_LANE = np.arange(8)
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def flat(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indexes lo[i], lo[i]+1, ... n[i] of them, for each i."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _lane_sums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, skipped: int, same: np.ndarray) -> np.ndarray:
    """Sums of the mixed lanes of each word, whose first lane is number ``skipped``."""
    lanes = (ends - starts + 7) // 8
    j = flat(np.zeros(len(starts), np.int64), lanes)
    at = np.repeat(starts, lanes) + 8 * j
    size = np.minimum(np.repeat(ends, lanes) - at, 8)
    lane = same[buf[np.minimum(at[:, None] + _LANE, len(buf) - 1)]].view("<u8").ravel() & _FIRST_BYTES[size]
    term = mix(mix(lane + _BASE) + (j + (skipped + 1)).astype(U64) * U64(0xD1342543DE82EF95))
    return np.add.reduceat(term, np.cumsum(lanes) - lanes)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, same: np.ndarray) -> np.ndarray:
    out, a = np.empty(len(starts), U64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        out[a:b] = 0
        for cut in range(int(starts[a]), int(ends[b - 1]), CHUNK):  # more than once for one very long word only
            stop = min(cut + CHUNK, int(ends[b - 1])) if b == a + 1 else int(ends[b - 1])
            s, e = (np.array([cut]), np.array([stop])) if b == a + 1 else (starts[a:b], ends[a:b])
            out[a:b] += _lane_sums(buf, s, e, (cut - int(starts[a])) // 8, same)
            if stop == ends[b - 1]:
                break
        out[a:b] = mix(out[a:b] + (ends[a:b] - starts[a:b]).astype(U64) * _INVERSE)
        a = b
    return out


def words(buf: np.ndarray, off: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the row offsets counted in words."""
    starts, ends = word_bounds(buf, off, table[0])
    return word_hashes(buf, starts, ends, table[1]), starts, ends, np.searchsorted(starts, off)


# ---------------------------------------------------------------- exchange by hash


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits, so that sorted hashes are in order of buckets."""
    return (((h >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def bucket_order(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of ``h`` by bucket, and the offsets of the buckets in that order."""
    b = bucket_of(h, buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


@dataclass
class Distinct:
    """Hashes of a part, each once and sorted, hence by bucket: bucket b has those from at[b] to at[b + 1]."""

    h: np.ndarray
    which: np.ndarray  # of each hash that was given
    times: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(h: np.ndarray, buckets: int) -> Distinct:
        u, which, times = np.unique(h, return_inverse=True, return_counts=True)
        return Distinct(u, which, times, np.searchsorted(bucket_of(u, buckets), np.arange(buckets + 1)))

    def spread(self, answers: dict[int, bytes], decode, dtype) -> np.ndarray:
        """Answers in the order of the hashes that were given. decode(bytes, n) gives n values."""
        out = np.zeros(len(self.h), dtype)
        for b, data in answers.items():
            out[self.at[b] : self.at[b + 1]] = decode(data, int(self.at[b + 1] - self.at[b]))
        return out[self.which]


HASHES = "bucket int, part int, data binary"
NOTES = "part int, kind int, bucket int, data binary"
_KEPT = 6  # bytes of a hash that travel; buckets use the rest too
_EXACT = 127  # counts in a part up to here are exact, larger ones to a tenth


def _code(times: np.ndarray) -> np.ndarray:
    return np.where(times <= _EXACT, times, np.minimum(255, _EXACT + np.rint(8 * np.log2(np.maximum(times, 1) / _EXACT)))).astype(np.uint8)


_TIMES = np.array([i if i <= _EXACT else round(_EXACT * 2 ** ((i - _EXACT) / 8)) for i in range(256)], np.int64)


def send_hashes(part: int, d: Distinct) -> pa.Table:
    """A row for each bucket that has hashes: for each distinct one its low bytes and a byte that says how often it occurs here."""
    low = np.empty((len(d.h), _KEPT + 1), np.uint8)
    low[:, :_KEPT] = d.h.view(np.uint8).reshape(-1, 8)[:, :_KEPT]
    low[:, _KEPT] = _code(d.times)
    full = np.flatnonzero(np.diff(d.at))
    off = np.append(d.at[full], d.at[-1]) * (_KEPT + 1)
    return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array(np.full(len(full), part), pa.int32()), "data": binary_rows(low.reshape(-1), off)})


def read_hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and counts of all rows, and the row offsets."""
    buf, off = text_buffer(table["data"])
    low = buf.reshape(-1, _KEPT + 1)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :_KEPT] = low[:, :_KEPT]
    return wide.view(U64).ravel(), _TIMES[low[:, _KEPT]], off // (_KEPT + 1)


def totals_of(h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """At each place, the sum of ``times`` over all places that hold the same value."""
    order = np.argsort(h)
    s = h[order]
    new = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    out = np.empty(len(h), np.int64)
    if len(s):
        out[order] = np.repeat(np.add.reduceat(times[order], new), np.diff(np.append(new, len(s))))
    return out


def answer_counts(kind: int, encode) -> callable:
    """Reducer of send_hashes: answers each part with encode(counts) of its hashes, in their order."""

    def reduce_bucket(key, table):
        h, times, off = read_hashes(table)
        counts, n = totals_of(h, times), table.num_rows
        data = [encode(counts[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        return pa.table({"part": table["part"].cast(pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([key[0].as_py()] * n, pa.int32()), "data": pa.array(data, pa.binary())})

    return reduce_bucket


def notes(table: pa.Table, kind: int) -> dict[int, bytes]:
    """The answers of one kind by bucket."""
    return {b: d for k, b, d in zip(table["kind"].to_pylist(), table["bucket"].to_pylist(), table["data"].to_pylist(), strict=True) if k == kind}


# ---------------------------------------------------------------- exact copies

COPIES = 0


def later_copies(rows: DataFrame, salts: int = 32) -> DataFrame:
    """``rows`` has part, doc_id and text. Notes of kind COPIES for each part: ids of documents whose whole text is that of a document
    with a smaller id (bucket 1), or that others copy (bucket 0). Salted, as one text may hold a third of the rows.
    """
    one = rows.where("text is not null and doc_id is not null").select(F.col("part").alias("part"), "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    firsts = one.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.where("first < last").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    one = one.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    found = one.join(firsts, ["digest", "salt"]).withColumn("bucket", (F.col("doc_id") > F.col("first")).cast("int"))
    about = F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("first").cast("string"), "digest")
    return found.select("part", F.lit(COPIES).alias("kind"), "bucket", F.encode(about, "UTF-8").alias("data"))


def copies(table: pa.Table, note: pa.Table) -> tuple[np.ndarray, list[int | None]]:
    """By row of a part: whether others copy it, and the first document if it is a later copy. Rows that share an id may differ in text."""
    marks: dict[tuple[int, str], tuple[int, int]] = {}
    for k, b, d in zip(note["kind"].to_pylist(), note["bucket"].to_pylist(), note["data"].to_pylist(), strict=True):
        if k == COPIES:
            doc, first, digest = d.decode().split()
            marks[int(doc), digest] = b, int(first)
    ids = {doc for doc, _ in marks}
    copied, later = np.zeros(len(table), bool), [None] * len(table)
    for i, doc in enumerate(table["doc_id"].to_pylist()):
        if doc in ids and (text := table["text"][i].as_py()) is not None:
            b, first = marks.get((doc, hashlib.sha256(text.encode()).hexdigest()), (None, None))
            copied[i] = b == 0
            later[i] = first if b == 1 else None
    return copied, later


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has a and b. Returns node and component, the smallest node that edges reach, for all nodes of edges.

    Each round takes the least label among the neighbours, then follows the labels' own labels. Rounds go by way of
    the shared folder, each in place of the one before; only whether labels have changed comes to the driver.
    """
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct())
    done = mark(spark)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        own = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("seen"))
        far = labels.select(F.col("node").alias("seen"), F.col("component").alias("far"))
        step = written(own.join(far, "seen", "left").select("node", "old", F.least("seen", F.coalesce("far", "seen")).alias("component")))
        changed = step.where("old <> component").limit(1).count()
        cleared(spark, done, keep=1)
        labels = step.drop("old")
        if not changed:
            return labels
