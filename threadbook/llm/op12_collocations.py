"""Phrase collocations: words ranked by frequency, pair tiles counted dense or as sorted coordinates, frequent pairs ranked and paired again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import binary_rows, chunked_rows, dropped, shuffles_dropped, text_buffer, tree_union, word_bounds, written

#: Occurrences from which a phrase is a candidate, its longest length in words, and how many a language reports.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one around it has so many hundredths of its occurrences.
COVERED = 80
SCALE = 2_000_000
NO_LANGUAGE = "und"
#: Bytes of text in one chunk; words a side of a tile; pairs from which a tile is counted dense.
CHUNK_BYTES, SIDE, DENSE = 8 << 20, 1024, 1 << 16
#: Rows of counts that a task hands over at once.
ROWS = 1 << 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_INSIDE = ~_ENDS
_INSIDE[list(b"\x20\x09")] = False


def _coded(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, how often each occurs, and the words in order by number, with -1 between pieces."""
    buf = _FOLD[buf]
    starts, ends = word_bounds(buf, off, _INSIDE)
    named = binary_rows(buf[_INSIDE[buf]], np.append(0, np.cumsum(ends - starts)), pa.string()).dictionary_encode()
    code = named.indices.to_numpy(zero_copy_only=False)
    piece = np.searchsorted(np.flatnonzero(_ENDS[buf]), starts) + np.searchsorted(off, starts, "right")
    first = np.append(True, piece[1:] != piece[:-1])[: len(starts)]
    stream = np.full(len(code) + int(first.sum()), -1, np.int32)
    stream[np.arange(len(code)) + np.cumsum(first)] = code
    return named.dictionary, np.bincount(code, minlength=len(named.dictionary)), stream


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from -1 up, byte by byte: the lowest bytes of all, then the next. Ranks and numbers are mostly small, so the upper planes are nearly all zero and compress to little."""
    return (x + 1).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplaned(data, kind: type) -> np.ndarray:
    """The numbers of ``planes``."""
    out = np.array(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T, order="C").view(kind).ravel()
    out -= 1
    return out


CHUNKS = "lang string, n_words long, words array<string>, counts array<long>, stream binary"


def _chunks(batches):
    """The texts of a task, a language at a time, in chunks of bounded size; a longer text is a chunk of its own."""
    for batch in batches:
        lang = batch.column("lang")
        for name in pc.unique(lang):
            buf, off = text_buffer(batch.column("text").filter(pc.equal(lang, name)))
            for a, b in chunked_rows(off, CHUNK_BYTES):
                words, counts, stream = _coded(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                if len(words):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()]), pa.array([int(counts.sum())]), pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64())), pa.array([planes(stream)], pa.binary())],
                        ["lang", "n_words", "words", "counts", "stream"],
                    )


def tile_counts(a: np.ndarray, b: np.ndarray, side: int = SIDE, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often each occurs. Numbers are ranks by frequency, so pairs crowd in the first tiles of ``side`` x ``side``:
    a tile with ``dense`` pairs or more is an array with a place for each cell; the pairs of all others are sorted coordinates.
    """
    if not len(a):
        return a.astype(np.int64), b.astype(np.int64), np.zeros(0, np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    a0, b0 = int(a.min()), int(b.min())
    tile = (a - a0) // side << 32 | (b - b0) // side
    tiles, of = np.unique(tile, return_inverse=True)
    size = np.bincount(of)
    out, sparse = [], size[of] < dense
    full = np.flatnonzero(size >= dense)
    if len(full):
        rest = np.flatnonzero(~sparse)
        rest = rest[np.argsort(of[rest], kind="stable")]
        for t, part in zip(full.tolist(), np.split(rest, np.cumsum(size[full])[:-1]), strict=True):
            top, left = a0 + (int(tiles[t]) >> 32) * side, b0 + (int(tiles[t]) & 0xFFFFFFFF) * side
            cells = np.bincount((a[part] - top) * side + (b[part] - left), minlength=side * side)
            used = np.flatnonzero(cells)
            out.append((top + used // side, left + used % side, cells[used]))
    code, n = np.unique(a[sparse] << 32 | b[sparse], return_counts=True)
    out.append((code >> 32, code & 0xFFFFFFFF, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# The stream of a chunk holds, place by place, the rank of the phrase that starts there (-1: none that is frequent) and that of its last word; those are the same for single
# words. Ranks are by occurrences in the chunk; gram_ids and word_ids say which phrase or word of the corpus each one is.
STREAMS = "chunk long, grams binary, lasts binary, gram_ids binary, word_ids binary"
_FIELDS = ["grams", "lasts", "gram_ids", "word_ids"]
_KINDS = [np.int32, np.int32, np.int64, np.int64]


def _arrays(values) -> list[np.ndarray]:
    grams, lasts, gram_ids, word_ids = (unplaned(x.as_buffer(), kind) for x, kind in zip(values, _KINDS, strict=True))
    return [grams, lasts if len(lasts) else grams, gram_ids, word_ids if len(word_ids) else gram_ids]


def _follow(grams: np.ndarray) -> np.ndarray:
    """The places where a frequent phrase is followed by one that starts a word later."""
    return np.flatnonzero((grams[:-1] >= 0) & (grams[1:] >= 0)) if len(grams) else np.zeros(0, np.int64)


PAIRS = "chunk long, a long, b long, n long"


def _pairs(batches):
    for batch in batches:
        for chunk, *values in zip(*(batch.column(c) for c in ("chunk", *_FIELDS)), strict=True):
            grams, lasts, gram_ids, word_ids = _arrays(values)
            at = _follow(grams)
            a, b, n = tile_counts(grams[at], lasts[at + 1])
            for i in range(0, len(a), ROWS):
                some = slice(i, i + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[some]), chunk.as_py())), pa.array(gram_ids[a[some]]), pa.array(word_ids[b[some]]), pa.array(n[some])], ["chunk", "a", "b", "n"])


def _stream(chunk: int, grams: np.ndarray, lasts: np.ndarray | None, gram_ids: np.ndarray, word_ids: np.ndarray | None) -> pa.Table:
    """A stream without phrases that no other follows, and with one gap between two runs."""
    there = grams >= 0
    before, after = np.append(False, there[:-1]), np.append(there[1:], False)
    runs = there & (before | after)
    keep = runs | (~runs & np.append(False, runs[:-1]))
    values = [np.where(runs, grams, -1)[keep], lasts[keep] if lasts is not None else grams[:0], gram_ids, word_ids if word_ids is not None else gram_ids[:0]]
    return pa.table([pa.array([chunk], pa.int64()), *(pa.array([planes(x.astype(kind))], pa.binary()) for x, kind in zip(values, _KINDS, strict=True))], ["chunk", *_FIELDS])


def _empty() -> pa.Table:
    return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.binary())] * 4], ["chunk", *_FIELDS])


def _ranks(counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each row, the most frequent first, and the ids in that order."""
    order = np.lexsort((ids, -counts))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return rank, ids[order]


def _ranked_words(chunks: pa.Table, found: pa.Table) -> pa.Table:
    """The stream of a chunk by the ranks of its words."""
    if not chunks.num_rows or not found.num_rows:
        return _empty()
    code = unplaned(chunks.column("stream")[0].as_buffer(), np.int32)
    known = found.column("i").to_numpy()
    ranks, ids = _ranks(np.bincount(code[code >= 0])[known], found.column("id").to_numpy())
    rank = np.full(int(code.max()) + 2, -1, np.int32)  # the last place is for the gap
    rank[known] = ranks
    return _stream(chunks.column("chunk")[0].as_py(), rank[code], None, ids, None)


def _ranked_pairs(streams: pa.Table, found: pa.Table) -> pa.Table:
    """The stream of a chunk by the ranks of phrases that are a word longer."""
    if not streams.num_rows or not found.num_rows:
        return _empty()
    grams, lasts, gram_ids, word_ids = _arrays([streams.column(c)[0] for c in _FIELDS])

    def local(column: str, known: np.ndarray) -> np.ndarray:
        by_id = np.argsort(known)
        return by_id[np.searchsorted(known, found.column(column).to_numpy(), sorter=by_id)]

    code = local("a", gram_ids) << 32 | local("b", word_ids)
    by_code = np.argsort(code)
    at = _follow(grams)
    wanted = grams[at].astype(np.int64) << 32 | lasts[at + 1]
    place = by_code[np.minimum(np.searchsorted(code, wanted, sorter=by_code), len(code) - 1)]
    hit = code[place] == wanted
    ranks, ids = _ranks(np.bincount(place[hit], minlength=len(code)), found.column("id").to_numpy())
    longer, ends = np.full(len(grams), -1, np.int32), np.full(len(grams), -1, np.int32)
    longer[at[hit]] = ranks[place[hit]]
    ends[at] = lasts[at + 1]
    return _stream(streams.column("chunk")[0].as_py(), longer, ends, ids, word_ids)


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows (chunk, keys, n) of keys with ``least`` occurrences in all: their total, the key's id, and whether the row is the first of its key. A key has a row a chunk at most."""
    every = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    summed = rows.withColumn("total", F.sum("n").over(every)).where(F.col("total") >= least).drop("n")
    numbered = summed.withColumn("_row", F.monotonically_increasing_id())  # the rows of a key are in one task, so the first one's number names it
    return written(numbered.withColumn("id", F.min("_row").over(every)).withColumn("head", F.col("_row") == F.col("id")).drop("_row"))


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Every phrase of one to ``longest`` words with ``least`` occurrences or more (lang, words, f); and the words of each language (lang, n).

    Texts are read once and coded in chunks. A phrase is a frequent one and its next word: such pairs are counted in each chunk by tiles of ranks, summed over chunks, and what is frequent is ranked anew in
    each chunk, whose stream is written with the new ranks, until phrases are ``longest`` words long. Tables and shuffles go as soon as nothing reads them any more.
    """
    with shuffles_dropped(docs.sparkSession):
        return _count_phrases(docs, least, longest)


def _count_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    chunks = docs.select(lang, F.col("text").cast("string").alias("text")).mapInArrow(_chunks, CHUNKS)
    chunks = written(chunks.withColumn("chunk", F.monotonically_increasing_id()))
    totals = written(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    each = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w")).select("chunk", "lang", "i", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    found = _frequent(each, ["lang", "word"], least)
    words = written(found.where("head").select("id", "lang", "word", F.col("total").alias("f")))
    streams = written(chunks.select("chunk", "stream").groupBy("chunk").cogroup(found.select("chunk", "i", "id").groupBy("chunk")).applyInArrow(_ranked_words, STREAMS))
    dropped(chunks, found)
    spelled = words.select("id", F.array("word").alias("words"), "lang", "f")
    out, last = [spelled], words.select(F.col("id").alias("b"), "word")
    for size in range(2, longest + 1):
        found = _frequent(streams.mapInArrow(_pairs, PAIRS), ["a", "b"], least)
        longer = found.where("head").select("id", "a", "b", F.col("total").alias("f"))
        spelled = longer.join(spelled.select(F.col("id").alias("a"), "words", "lang"), "a").join(last, "b")
        spelled = written(spelled.select("id", F.concat("words", F.array("word")).alias("words"), "lang", "f"))
        out.append(spelled)
        before = streams
        if size < longest:
            streams = written(streams.groupBy("chunk").cogroup(found.select("chunk", "a", "b", "id").groupBy("chunk")).applyInArrow(_ranked_pairs, STREAMS))
        dropped(before, found)
    return tree_union(out).select("lang", "words", "f"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two to ``longest`` words by the score of their weakest cut.

    Null and empty texts hold no words, a null language is "und". Very long texts are taken whole, and a phrase never crosses texts. Repeated rows count each; ids play no part.
    Equal scores go by occurrences, then by phrase. An empty table, or one where nothing is frequent, gives no rows. Other columns are ignored. Products are decimals of 38 digits.
    """
    phrases, totals = count_phrases(docs, least, longest)
    said = phrases.select("lang", "words", F.concat_ws(" ", "words").alias("phrase"), "f", F.size("words").alias("size"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    candidates = said.where("size > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    part = lambda a, n: F.concat_ws(" ", F.slice("words", a, n))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = said.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    cuts = cuts.join(known, ["lang", "first"]).join(known.select("lang", F.col("first").alias("rest"), F.col("l").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumns({"_x": wide("a") * F.lit(SCALE).cast("decimal(7,0)"), "_y": wide("l") + wide("r")}).withColumn("score", F.expr("_x div _y"))
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = candidates.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1))).select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "f")
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    held = weakest.join(around, ["lang", "phrase"], "left")
    kept = held.where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * covered)).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(list_transform(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) AS w FROM t),
z AS (SELECT lang, w, row_number() OVER () AS piece FROM p WHERE len(w) > 0),
s AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM z),
g AS (SELECT lang, w1, lead(w1) OVER q AS w2, lead(w1, 2) OVER q AS w3, lead(w1, 3) OVER q AS w4 FROM s WINDOW q AS (PARTITION BY piece ORDER BY i)),
tot AS (SELECT lang, count(*) AS n FROM s GROUP BY 1),
f AS (
  SELECT lang, [w1] AS ws, count(*) AS f FROM g GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
c AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
x AS (
  SELECT c.lang, c.ws, c.a, c.k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.ws = list_slice(c.ws, 1, c.k) JOIN f r ON r.lang = c.lang AND r.ws = list_slice(c.ws, c.k + 1, len(c.ws))
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.ws ORDER BY score, c.k) = 1),
o AS (SELECT lang, ws, f, unnest(range(2, len(ws))) AS m FROM f WHERE len(ws) > 2),
h AS (SELECT lang, ws, f, m, unnest(range(1, len(ws) - m + 2)) AS b FROM o),
i AS (SELECT lang, list_slice(ws, b, b + m - 1) AS ws, max(f) AS most FROM h GROUP BY 1, 2),
d AS (SELECT x.* FROM x LEFT JOIN i ON i.lang = x.lang AND i.ws = x.ws WHERE i.most IS NULL OR CAST(100 AS HUGEINT) * i.most < CAST(80 AS HUGEINT) * x.a),
e AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM d)
SELECT e.lang, rank, phrase, a, l, r, n, score FROM e JOIN tot USING (lang) WHERE rank <= 2000
"""
