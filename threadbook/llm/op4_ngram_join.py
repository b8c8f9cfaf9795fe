"""N-gram Jaccard self-join by multiple global orders: candidates share prefix tokens under each of several token orders.

1. Equal texts are one document (``later_copies``). A document that has a link shares tokens with it in the longer prefixes
   of any order, so documents that share too few tokens there go; a bit a token answers that.
2. For the rest, three global orders of tokens: rare ones first, and two by independent hashes alone.
3. Documents that share a prefix token of the first order, directly or by others, form a cluster, so no candidate pair
   crosses clusters. Larger clusters are cut into blocks. Each block meets itself and the first block of its cluster; where that does
   not join the whole cluster, every other pair of blocks meets too.
4. Within a task, pairs that share a prefix token in all orders are candidates, and those are verified by their whole sets,
   but for pairs that earlier links join already.
Links come out as a few edges for each document, never as all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
WORDS = 5
#: Similarity in hundredths.
SIMILAR = 80
#: One seed for each global order: the first is by frequency and then by hash, the others are by hash.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
#: Documents in a block of a large cluster at most and at least, and blocks into which a cluster is cut before blocks grow.
BLOCK, LEAST_BLOCK, BLOCKS = 1024, 128, 16
#: Tokens that are looked up at once when pairs are verified.
PAIRED = 1 << 21
SHARED, FREQUENCY = 1, 2


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Tokens that a set of n must share with any set it links with."""
    return -(-SIMILAR * n // 100)


def _spare(n: np.ndarray) -> np.ndarray:
    """Shared tokens that the longer prefix of step 1 holds for two sets of n."""
    return np.minimum(least_overlap(n), -(-n // 5))


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the row offsets."""
    buf, off = C.text_buffer(texts)
    found, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for a, b in C.chunked_rows(off):
        h, _, _, at = C.words(buf[off[a] : off[b]], off[a : b + 1] - off[a], C.FOLDED)
        n = np.diff(at)
        count = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
        start = C.flat(at[:-1], count)
        end = start + np.repeat(np.minimum(n, WORDS), count)
        token = C.mix(C.Rolling(h).raw(start, end) + (end - start).astype(U64))
        row = np.repeat(np.arange(b - a), count)
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        new = np.append(True, (token[1:] != token[:-1]) | (row[1:] != row[:-1]))[: len(token)]
        found.append(token[new])
        sizes.append(np.bincount(row[new], minlength=b - a))
    return np.concatenate(found), np.append(0, np.cumsum(np.concatenate(sizes)))


def _firsts(off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the first n[i] tokens of each row."""
    return C.flat(off[:-1], n)


# ---------------------------------------------------------------- step 1


def _opened(table: pa.Table, note: pa.Table):
    """The part in a fixed order, later copies with their firsts, and which rows are compared."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    _, later = C.copies(table, note)
    return table, later, np.array([x is not None and y is None for x, y in zip(table["doc_id"].to_pylist(), later, strict=True)], bool)


def _send_prefixes(buckets: int):
    def run(key, table, note):
        table, _, own = _opened(table, note)
        token, off = shingle_sets(table.filter(pa.array(own))["text"])
        n = np.diff(off)
        return C.send_hashes(key[0].as_py(), C.Distinct.of(token[_firsts(off, n - least_overlap(n) + _spare(n))], buckets))

    return run


BASE = "doc_id long, n_shingles long, first long, tokens binary"


def _base_rows(buckets: int):
    def run(key, table, note):
        table, later, own = _opened(table, note)
        token, off = shingle_sets(table["text"])
        n = np.diff(off)
        looked = np.where(own, n - least_overlap(n) + _spare(n), 0)
        sent = C.Distinct.of(token[_firsts(off, looked)], buckets)
        shared = sent.spread(C.notes(note, SHARED), lambda d, k: np.unpackbits(np.frombuffer(d, np.uint8), count=k), np.uint8)
        got = np.bincount(np.repeat(np.arange(len(n)), looked), weights=shared, minlength=len(n))
        stays = own & (n > 0) & (got >= np.minimum(_spare(n), _spare(least_overlap(n))))
        tokens = [token[a:b].tobytes() if s else None for a, b, s in zip(off[:-1], off[1:], stays, strict=True)]
        return pa.table({"doc_id": table["doc_id"], "n_shingles": pa.array(n, pa.int64()), "first": pa.array([x if k else None for x, k in zip(later, n, strict=True)], pa.int64()), "tokens": pa.array(tokens, pa.binary())})

    return run


# ---------------------------------------------------------------- step 2


def _loaded(table: pa.Table):
    table = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
    each = [np.frombuffer(x, U64) for x in table["tokens"].to_pylist()]
    off = np.append(0, np.cumsum([len(x) for x in each])).astype(np.int64)
    return table, np.concatenate(each) if each else np.zeros(0, U64), off


def _frequency_code(counts: np.ndarray) -> bytes:
    return np.where(counts > 1, np.minimum(255, np.floor(np.log2(counts) * 8)), 0).astype(np.uint8).tobytes()


ORDERED = "doc_id long, n long, tokens binary, prefixes binary"


def _ordered_rows(buckets: int):
    def run(key, table, note):
        table, token, off = _loaded(table)
        rare = C.Distinct.of(token, buckets).spread(C.notes(note, FREQUENCY), lambda d, k: np.frombuffer(d, np.uint8), np.uint8)
        n = np.diff(off)
        row = np.repeat(np.arange(len(n)), n)
        prefix = _firsts(off, n - least_overlap(n) + 1)
        flags = np.zeros(len(token), np.uint8)
        for i, seed in enumerate(ORDERS):
            tie = C.mix(token ^ U64(seed))
            flags[np.lexsort((tie, rare, row) if i == 0 else (tie, row))[prefix]] |= 1 << i
        keep = rare > 0
        cut = np.append(0, np.cumsum(keep))[off]
        return pa.table({"doc_id": table["doc_id"], "n": pa.array(n, pa.int64()), "tokens": C.binary_rows(token[keep].view(np.uint8), cut * 8), "prefixes": C.binary_rows(flags[keep], cut)})

    return run


# ---------------------------------------------------------------- step 3


def _send_first_order(buckets: int):
    """Joins the documents of a part first, and sends each token once with one document for all of them. Row -1 holds the part's own edges."""

    def run(key, table):
        token = np.concatenate([np.frombuffer(x, U64) for x in table["tokens"].to_pylist()])
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in table["prefixes"].to_pylist()])
        doc = np.repeat(np.array(table["doc_id"].to_pylist(), np.int64), [len(x) for x in table["prefixes"].to_pylist()])
        token, doc = token[flags & 1 > 0], doc[flags & 1 > 0]
        docs, token, label = _joined(token, doc)
        order, at = C.bucket_order(token, buckets)
        full = np.flatnonzero(np.diff(at))
        own = _edge_table(docs, label[0])
        data = [np.concatenate([np.asarray(own["a"]), np.asarray(own["b"])]).tobytes()]
        data += [np.concatenate([token[i].view(np.int64), docs[label[1][i]]]).tobytes() for i in (order[at[b] : at[b + 1]] for b in full)]
        return pa.table({"bucket": pa.array([-1, *full], pa.int32()), "part": pa.array([key[0].as_py()] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


def _joined(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The documents and the tokens, each once, and the place of the smallest document that each document, and each token, reaches by shared tokens."""
    docs, d = np.unique(doc, return_inverse=True)
    order = np.lexsort((d, token))
    token, d = token[order], d[order]
    head = np.append(True, token[1:] != token[:-1])[: len(token)]
    leader = d[head][np.cumsum(head) - 1]
    label = forest(d, leader, len(docs))
    return docs, token[head], (label, label[d[head]])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0..n-1 that each of them reaches by pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


EDGES = "a long, b long"


def _edge_table(docs: np.ndarray, root: np.ndarray) -> pa.Table:
    i = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": pa.array(docs[i], pa.int64()), "b": pa.array(docs[root[i]], pa.int64())})


def _cluster_edges(key, table):
    got = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table["data"].to_pylist()]
    token, doc = np.concatenate(got, axis=1)
    docs, _, (label, _) = _joined(token, doc)
    return _edge_table(docs, label)


def _own_edges(batches):
    for batch in batches:
        a, b = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in batch["data"].to_pylist()], axis=1) if batch.num_rows else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


# ---------------------------------------------------------------- step 4


def overlaps(ta: np.ndarray, ra: np.ndarray, na: int, tb: np.ndarray, rb: np.ndarray, nb: int) -> np.ndarray:
    """How many tokens each of na sets shares with each of nb: frequent tokens by matrix product, the others by pairs."""
    every, code = np.unique(np.concatenate([ta, tb]), return_inverse=True)
    ca, cb = code[: len(ta)], code[len(ta) :]
    fa, fb = np.bincount(ca, minlength=len(every)), np.bincount(cb, minlength=len(every))
    dense = fa * fb > (na + nb)
    out = np.zeros((na, nb), np.int64)
    wide = np.flatnonzero(dense)
    column = np.cumsum(dense) - 1
    for lo in range(0, len(wide), 2048):
        left, right = np.zeros((na, 2048), np.float32), np.zeros((nb, 2048), np.float32)
        for matrix, c, r in ((left, ca, ra), (right, cb, rb)):
            i = np.flatnonzero(dense[c] & (column[c] >= lo) & (column[c] < lo + 2048))
            matrix[r[i], column[c[i]] - lo] = 1
        out += (left @ right.T).astype(np.int64)
    i = np.flatnonzero(~dense[ca] & (fb[ca] > 0))
    order = np.argsort(cb, kind="stable")
    at = np.append(0, np.cumsum(fb))
    take = fb[ca[i]]
    out += np.bincount(np.repeat(ra[i], take) * nb + rb[order[C.flat(at[ca[i]], take)]], minlength=na * nb).reshape(na, nb)
    return out


def candidates(a: dict, b: dict, counts: list[int] | None = None) -> np.ndarray:
    """Which sets of ``a`` share a prefix token with which of ``b`` in every order. counts: gets the pairs left after each order."""
    na, nb = len(a["n"]), len(b["n"])
    out = np.ones((na, nb), bool) if a is not b else np.triu(np.ones((na, nb), bool), 1)
    for i in range(len(ORDERS)):
        pa_, pb_ = a["flags"] & (1 << i) > 0, b["flags"] & (1 << i) > 0
        out &= overlaps(a["token"][pa_], a["row"][pa_], na, b["token"][pb_], b["row"][pb_], nb) > 0
        if counts is not None:
            counts.append(int(out.sum()))
    return out


def verified(a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of sets link, by all tokens of both."""
    every = np.unique(np.concatenate([a["token"], b["token"]]))
    code = lambda x: np.searchsorted(every, x["token"])
    held = np.sort(b["row"] * len(every) + code(b))
    ca, na = code(a), np.bincount(a["row"], minlength=len(a["n"]))
    at, both = np.cumsum(na) - na, np.zeros(len(i), np.int64)
    ends = np.cumsum(na[i])
    for some in np.split(np.arange(len(i)), np.searchsorted(ends, np.arange(PAIRED, ends[-1] if len(ends) else 0, PAIRED))):
        if len(some):
            pair = np.repeat(some, na[i[some]])
            key = j[pair] * len(every) + ca[C.flat(at[i[some]], na[i[some]])]
            both[some] = np.bincount(pair - some[0], weights=held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key, minlength=len(some))
    return 100 * both >= SIMILAR * (a["n"][i] + b["n"][j] - both)


def link_forest(a: dict, b: dict, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the documents of ``a`` and ``b``, sorted, and the place of the smallest one that each reaches by links among them.

    Candidates whose documents are joined already are not verified. Each time round, every set tries so many of its open candidates,
    twice as many as before; a group of near copies is joined the first time. counts: gets the pairs after each order, and those verified.
    """
    ids, place = np.unique(np.concatenate([a["doc"], b["doc"]]), return_inverse=True)
    pa_, pb_ = place[: len(a["doc"])], place[len(a["doc"]) :]
    open_pairs, label, tried, most = candidates(a, b, counts), np.arange(len(ids)), 0, 1
    while True:
        open_pairs &= label[pa_][:, None] != label[pb_][None, :]
        if not open_pairs.any():
            break
        i, j = np.nonzero(open_pairs & (np.cumsum(open_pairs, axis=1, dtype=np.int32) <= most))
        open_pairs[i, j] = False
        good = verified(a, b, i, j)
        tried, most = tried + len(i), most * 2
        label = forest(np.append(np.arange(len(ids)), pa_[i[good]]), np.append(label, pb_[j[good]]), len(ids))
    if counts is not None:
        counts.append(tried)
    return ids, label


def _sets(table: pa.Table, pick: np.ndarray) -> dict:
    table = table.take(pa.array(pick))
    flags = [np.frombuffer(x, np.uint8) for x in table["prefixes"].to_pylist()]
    token = [np.frombuffer(x, U64) for x in table["tokens"].to_pylist()]
    return {"doc": np.array(table["doc_id"].to_pylist(), np.int64), "n": np.array(table["n"].to_pylist(), np.int64), "token": np.concatenate(token), "flags": np.concatenate(flags), "row": np.repeat(np.arange(len(flags)), [len(x) for x in flags])}


def _link_edges(key, table):
    left, right = key[1].as_py(), key[2].as_py()
    cluster, block = np.asarray(table["cluster"]), np.asarray(table["block"])
    order = np.argsort(cluster, kind="stable")
    cuts = np.flatnonzero(np.append(True, cluster[order][1:] != cluster[order][:-1]))
    out = []
    for rows in np.split(order, cuts[1:]):
        if len(rows) < 2:
            continue
        if left == right:
            a = b = _sets(table, rows)
        else:
            one, two = rows[block[rows] == left], rows[block[rows] == right]
            if not len(one) or not len(two):
                continue
            a, b = _sets(table, one), _sets(table, two)
        out.append(_edge_table(*link_forest(a, b)))
    return pa.concat_tables(out) if out else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


# ---------------------------------------------------------------- all


def ngram_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Returns one row per input row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Words are runs without ASCII white space, A-Z in lower case; a set holds the distinct five-word shingles, or all words
    of a shorter text as one, compared by 64-bit hash. Two documents link when 100 * shared >= 80 * all tokens of both. Very long texts
    and very long words count in full. Null, empty and blank texts have
    no shingles and link with nothing. Rows that share a doc_id are one document with the links of all of them; rows with a
    null doc_id have a null component and take no part. An empty table gives no rows. Other columns are ignored.
    """
    parts = buckets = C.parts_for(docs)
    rows = C.parted(docs, parts)
    copies = C.later_copies(rows)
    by_part = lambda left, note, f, out: left.groupBy("part").cogroup(note.groupBy("part")).applyInArrow(f, out)
    shared = by_part(rows, copies, _send_prefixes(buckets), C.HASHES).groupBy("bucket").applyInArrow(C.answer_counts(SHARED, lambda c: np.packbits(c > 1).tobytes()), C.NOTES)
    base = C.written(by_part(rows, copies.unionByName(shared), _base_rows(buckets), BASE))

    sets = base.where("tokens is not null").select(C.part_of("doc_id", parts).alias("part"), "doc_id", "tokens")
    sent = sets.groupBy("part").applyInArrow(lambda key, table: C.send_hashes(key[0].as_py(), C.Distinct.of(_loaded(table)[1], buckets)), C.HASHES)
    frequency = sent.groupBy("bucket").applyInArrow(C.answer_counts(FREQUENCY, _frequency_code), C.NOTES)
    ordered = C.written(by_part(sets, frequency, _ordered_rows(buckets), ORDERED))

    parted = ordered.where(F.length("tokens") > 0).select(C.part_of("doc_id", parts).alias("part"), "doc_id", "tokens", "prefixes")
    firsts = C.written(parted.groupBy("part").applyInArrow(_send_first_order(buckets), C.HASHES))
    between = firsts.where("bucket >= 0").groupBy("bucket").applyInArrow(_cluster_edges, EDGES)
    clusters = C.components(between.unionByName(firsts.where("bucket < 0").mapInArrow(_own_edges, EDGES)))

    n = F.count("*")
    blocks = F.least(F.ceil(n / min(block, LEAST_BLOCK)), F.greatest(F.lit(BLOCKS), F.ceil(n / block))).cast("int")
    held = C.written(clusters.groupBy("component").agg(blocks.alias("blocks")))
    dealt = C.written(clusters.join(held, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    own = F.col("block")
    first = F.array_distinct(F.when(own == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0), own)))
    links = C.written(_met(ordered.join(dealt.withColumn("other", F.explode(first)), "doc_id"), buckets))
    if held.where("blocks > 2").limit(1).count():
        joined = dealt.where("blocks > 2").join(C.components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        apart = joined.groupBy("cluster").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("cluster")
        rest = F.filter(F.sequence(F.lit(1), F.col("blocks") - 1), lambda k: k != own)
        again = dealt.where("blocks > 2 and block > 0").join(apart, "cluster", "left_semi").withColumn("other", F.explode(rest))
        links = links.unionByName(_met(ordered.join(again, "doc_id"), buckets))
    same = base.where("first is not null").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = C.components(links.unionByName(same)).withColumnRenamed("node", "doc_id")
    return base.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _met(rows: DataFrame, buckets: int) -> DataFrame:
    """Edges of the links between each row's block and ``other``. Clusters of one block share tasks."""
    small = -1 - F.pmod(F.xxhash64("cluster"), F.lit(4 * buckets))
    rows = rows.withColumn("task", F.when(F.col("blocks") == 1, small).otherwise(F.col("cluster"))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return rows.select("task", "low", "high", "cluster", "block", "doc_id", "n", "tokens", "prefixes").groupBy("task", "low", "high").applyInArrow(_link_edges, EDGES)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS key FROM t),
s AS (SELECT DISTINCT doc_id, key FROM g WHERE i <= greatest(n - 4, 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.key = b.key AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.component, w.doc_id)) AS component_id
FROM w LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a) m USING (doc_id)
"""
