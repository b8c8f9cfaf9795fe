"""Repeated windows of a corpus: which windows of W symbols also occur elsewhere.

Both substring operators share this frame; a symbol is a byte or a word hash. A suffix is only
worth sorting where its first W symbols may occur twice, so the work goes in rounds:

1. Each window is named after its minimizer, the smallest of its k-symbol slices: equal windows
   choose the same slice at the same place. Consecutive windows with one minimizer form a piece.
   Each part sends its distinct minimizers, seven bytes each, to their buckets, which answer with
   two bits: shared, hot.
2. Shared pieces, once for each part and content (compared symbol by symbol), go to that bucket as
   text. Hot minimizers get longer prefixes (the whole window), so that no bucket grows with a very
   common line.
3. The bucket cuts its suffixes into groups that fit in memory, by minimizer and then by longer and
   longer prefixes; it sorts each group and answers with one bit a window.
4. Each part maps the bits back to its documents.

All rounds see whole texts. A piece that is dropped in round 1 has a minimizer that occurs once in
the corpus, so none of its windows occurs twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
_AT = U64((1 << 24) - 1)
_STEP = 1 << 19
SHARED, WINDOWS = 1, 2
NO_ID = np.iinfo(np.int64).max
#: Windows that are looked at in one numpy pass, suffixes that are sorted together, and symbols by which prefixes grow.
BATCH, GROUP, LONGER = 200_000, 25_000, 8


@dataclass(frozen=True)
class Kind:
    """What is compared: window length, minimizer length, symbol type, and how a class of equal windows is judged.

    ``reach`` is how much of a suffix is sorted, the window at least. sort(perm, head, text, size) orders the suffixes of each group (a run that
    starts where ``head`` is set) in place and leaves ``head`` set where a window differs from the one before; text has a row a suffix,
    zero beyond its size.
    """

    window: int
    anchor: int
    symbol: type
    by_first: bool  # judged by a smaller document id; else by a second occurrence
    sort: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]
    reach: int
    hot: int = 100_000
    group: int = GROUP


@dataclass
class Pieces:
    lo: np.ndarray  # first window start
    hi: np.ndarray  # last window start
    back: np.ndarray  # minimizer place less lo
    h: np.ndarray
    content: np.ndarray  # hash of all symbols of the piece
    doc: np.ndarray

    def take(self, i) -> Pieces:
        return Pieces(*(getattr(self, f)[i] for f in ("lo", "hi", "back", "h", "content", "doc")))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    done = 1
    m = x
    while done * 2 <= w:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return m if done == w else np.minimum(m[: len(x) - w + 1], m[w - done :])


def cut_pieces(symbols: Callable[[int, int], np.ndarray], off: np.ndarray, kind: Kind) -> Pieces:
    """The pieces of all rows; ``symbols(a, b)`` gives a slice of the concatenated rows as uint64."""
    n, W, found = int(off[-1]), kind.window, []
    for a in range(0, max(0, n - W + 1), _STEP):
        b = min(n, a + _STEP + W - 1)
        roll = C.Rolling(symbols(a, b))
        grams = roll.every(kind.anchor)
        low = _sliding_min((grams & ~_AT) | np.arange(len(grams), dtype=U64), W - kind.anchor + 1)
        edges = off[np.searchsorted(off, a, "right") : np.searchsorted(off, b, "left")] - a  # row starts inside
        bad = np.zeros(b - a + 1, np.int32)
        np.add.at(bad, np.maximum(edges - W + 1, 0), 1)
        np.add.at(bad, edges, -1)
        at = np.flatnonzero(np.cumsum(bad)[: len(low)] == 0)
        if not len(at):
            continue
        place = (low[at] & _AT).astype(np.int64)
        new = np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))
        first = np.flatnonzero(new)
        lo, hi, p = at[first], at[np.append(first[1:], len(at)) - 1], place[first]
        content = C.mix(roll.raw(lo, hi + W) + (hi - lo).astype(U64))
        found.append((lo + a, hi + a, p - lo, C.mix(grams[p] ^ C._BASE), content, np.searchsorted(off, lo + a, "right") - 1))
    if not found:
        z = np.zeros(0, np.int64)
        return Pieces(z, z, z, z.astype(U64), z.astype(U64), z)
    return Pieces(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _encode(kind: Kind):
    def encode(counts: np.ndarray) -> bytes:
        return np.packbits(np.concatenate([counts > 1, counts > kind.hot])).tobytes()

    return encode


def _decode(data: bytes, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * n)
    return bits[:n] + bits[n:]


def windows_of(pieces: Pieces, symbols, kind: Kind) -> Pieces:
    """Pieces of one window each, named after the whole window: the longest prefix."""
    m = pieces.hi - pieces.lo + 1
    r = np.repeat(np.arange(len(m)), m)
    s = pieces.lo[r] + np.arange(len(r)) - np.repeat(np.cumsum(m) - m, m)
    h = np.empty(len(s), U64)
    for a in range(0, int(s.max(initial=0)) + 1, _STEP):
        i = np.flatnonzero((s >= a) & (s < a + _STEP))
        if len(i):
            roll = C.Rolling(symbols(a, int(s[i].max()) + kind.window))
            h[i] = C.mix(roll.raw(s[i] - a, s[i] - a + kind.window))
    return Pieces(s, s, np.zeros(len(s), np.int64), h, h, pieces.doc[r])


@dataclass
class Part:
    """The rows of a part in a fixed order, with the pieces of those that take part."""

    table: pa.Table
    off: np.ndarray
    symbols: Callable[[int, int], np.ndarray]
    raw: Callable[[np.ndarray], np.ndarray]
    pieces: Pieces
    ids: np.ndarray


def unique_pieces(part: Part, note: pa.Table, kind: Kind, buckets: int):
    """Shared pieces of the part, an index of the first of each kind of content, and which one each piece is."""
    code = C.Distinct.of(part.pieces.h, buckets).spread(C.notes(note, SHARED), _decode, np.uint8)
    shared = part.pieces.take(np.flatnonzero(code == 1))
    if (code == 2).any():
        more = windows_of(part.pieces.take(np.flatnonzero(code == 2)), part.symbols, kind)
        shared = Pieces(*(np.concatenate([getattr(shared, f), getattr(more, f)]) for f in ("lo", "hi", "back", "h", "content", "doc")))
    by = np.lexsort((part.ids[shared.doc], shared.hi - shared.lo, shared.content, shared.h))
    s = shared.take(by)
    m = s.hi - s.lo
    new = np.append(True, (s.h[1:] != s.h[:-1]) | (s.content[1:] != s.content[:-1]) | (m[1:] != m[:-1])) if len(by) else np.zeros(0, bool)
    again, head = np.flatnonzero(~new), np.flatnonzero(new)[np.cumsum(new) - 1]
    size = m + kind.window
    for i in np.split(again, np.searchsorted(np.cumsum(size[again]), np.arange(_STEP, size[again].sum(), _STEP))):  # equal hashes: compare the symbols
        if len(i):
            same = part.raw(C.flat(s.lo[i], size[i])) == part.raw(C.flat(s.lo[head[i]], size[i]))
            new[i] = ~np.logical_and.reduceat(same, np.cumsum(size[i]) - size[i])
    return s, np.flatnonzero(new), np.cumsum(new) - 1


def send_pieces(part_no: int, part: Part, note: pa.Table, kind: Kind, buckets: int) -> pa.Table:
    s, first, which = unique_pieces(part, note, kind, buckets)
    times = np.bincount(which, minlength=len(first)) if len(first) else first
    u = s.take(first)
    value = part.ids[u.doc] if kind.by_first else times
    order, at = C.bucket_order(u.h, buckets)
    full = np.flatnonzero(np.diff(at))
    data = []
    for b in full:
        i = order[at[b] : at[b + 1]]
        m = u.hi[i] - u.lo[i] + 1
        body = part.raw(C.flat(u.lo[i], m + kind.window - 1))
        data.append(b"".join((np.int64(len(i)).tobytes(), u.h[i].tobytes(), value[i].astype(np.int64).tobytes(), u.back[i].astype(np.uint8).tobytes(), m.astype(np.uint8).tobytes(), body.tobytes())))
    return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array([part_no] * len(full), pa.int32()), "data": pa.array(data, pa.binary())})


def answer_pieces(kind: Kind, batch: int = BATCH):
    """Reducer of send_pieces: a bit for each window that the corpus repeats."""

    def reduce_bucket(key, table):
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for x in table["data"].to_pylist():
            n, pos = int(np.frombuffer(x, np.int64, 1)[0]), 8
            for i, t in enumerate((U64, np.int64, np.uint8, np.uint8)):
                cols[i].append(np.frombuffer(x, t, n, pos))
                pos += n * np.dtype(t).itemsize
            cols[4].append(np.frombuffer(x, kind.symbol, -1, pos))
        sizes = [len(x) for x in cols[0]]
        h, value, back, m, flat = (np.concatenate(x) for x in cols)
        back, m = back.astype(np.int64), m.astype(np.int64)
        at = np.cumsum(m + kind.window - 1) - (m + kind.window - 1)
        mask = judged(h, value, back, m, at, flat, kind, batch)
        data = [x.astype(np.uint32).tobytes() for x in np.split(mask, np.cumsum(sizes)[:-1])]
        n = len(data)
        return pa.table({"part": table["part"].cast(pa.int32()), "kind": pa.array([WINDOWS] * n, pa.int32()), "bucket": pa.array([key[0].as_py()] * n, pa.int32()), "data": pa.array(data, pa.binary())})

    return reduce_bucket


def judged(h, value, back, m, at, flat, kind: Kind, batch: int) -> np.ndarray:
    """A bit for each window of the pieces. ``flat`` holds the symbols of all pieces, from ``at`` on each."""
    mask = np.zeros(len(h), np.int64)
    order = np.argsort(h, kind="stable")
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(np.append(False, h[order][1:] != h[order][:-1]))
    rows = np.flatnonzero(np.bincount(group)[group] > 1)
    rows = rows[np.argsort(group[rows], kind="stable")]
    done, ends = 0, np.cumsum(m[rows])
    while done < len(rows):  # whole minimizers, about ``batch`` windows
        upto = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + batch, "right"))
        upto = int(np.searchsorted(group[rows], group[rows[min(max(upto, done + 1), len(rows)) - 1]], "right"))
        some = rows[done:upto]
        done = upto
        r = np.repeat(some, m[some])
        i = C.flat(np.zeros(len(some), np.int64), m[some])
        prefix = group[r] * 256 + back[r] - i
        start, size = at[r] + i, np.minimum(m[r] - i + kind.window - 1, kind.reach)
        prefix, equal = lengthened(prefix, start, flat, kind)
        by = np.argsort(prefix, kind="stable")
        heads = np.flatnonzero(np.append(True, prefix[by][1:] != prefix[by][:-1]))
        sizes = np.diff(np.append(heads, len(by)))
        cuts = np.append(heads, len(by))
        g = 0
        while g < len(heads):  # whole prefixes, about ``kind.group`` suffixes
            last = max(g + 1, int(np.searchsorted(cuts, cuts[g] + kind.group, "right")) - 1)
            own = by[cuts[g] : cuts[last]]
            head = np.zeros(len(own), bool)
            head[heads[g:last] - cuts[g]] = True
            perm = np.arange(len(own))
            if not (last == g + 1 and equal[own[0]]):  # else one string only, which needs no order
                columns = np.arange(kind.reach)
                text = np.where(columns < size[own][:, None], flat[np.minimum(start[own][:, None] + columns, len(flat) - 1)], 0).astype(flat.dtype)
                kind.sort(perm, head, text, size[own])
            g = last
            own = own[perm]
            starts = np.flatnonzero(head)
            v = value[r[own]]
            sizes = np.diff(np.append(starts, len(v)))
            if kind.by_first:
                bit = np.repeat(np.minimum.reduceat(v, starts), sizes) < v
            else:
                bit = np.repeat(np.add.reduceat(v, starts), sizes) > 1
            np.add.at(mask, r[own][bit], np.int64(1) << i[own][bit])
    return mask


def lengthened(prefix: np.ndarray, start: np.ndarray, flat: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of suffixes by number, so that one is of ``kind.group`` suffixes at most: larger ones grow by ``LONGER`` symbols until they are
    small enough or as long as a window. Also which suffixes have a whole window for their prefix.
    """
    _, prefix = np.unique(prefix, return_inverse=True)
    equal = np.zeros(len(prefix), bool)
    for length in range(0, kind.window, LONGER):
        large = np.flatnonzero((np.bincount(prefix) > kind.group)[prefix])
        if not len(large):
            break
        keys = [flat[start[large] + c] for c in range(length, min(length + LONGER, kind.window))]
        by = np.lexsort((*keys, prefix[large]))
        new = np.append(True, prefix[large][by][1:] != prefix[large][by][:-1])
        for k in keys:
            new[1:] |= k[by][1:] != k[by][:-1]
        number = np.cumsum(new) - 1
        prefix = prefix * 1
        prefix[large[by]] = prefix.max() + 1 + number
        equal[large] = length + LONGER >= kind.window
    return prefix, equal


def refine(perm: np.ndarray, head: np.ndarray, text: np.ndarray) -> None:
    """Order the rows of each group (a run that starts where ``head`` is set) as a compacted trie does:
    skip to the depth where the group first differs and branch on that one symbol, until each group
    is one string. Works on all groups at once; changes ``perm`` and ``head`` in place.
    """
    width = text.shape[1]
    act = _shared_slots(np.arange(len(perm)), head)
    while len(act):
        rows, h = perm[act], head[act]
        starts = np.flatnonzero(h)
        g = np.cumsum(h) - 1
        differs = text[rows] != text[rows[starts][g]]
        depth = np.where(differs.any(1), differs.argmax(1), width)
        branch = np.minimum.reduceat(depth, starts)
        keep = branch[g] < width
        act, rows, g = act[keep], rows[keep], g[keep]
        if not len(act):
            return
        symbol = text[rows, branch[g]]
        o = np.lexsort((symbol, g))
        perm[act] = rows[o]
        g, symbol = g[o], symbol[o]
        head[act] = np.append(True, (g[1:] != g[:-1]) | (symbol[1:] != symbol[:-1]))
        act = _shared_slots(act, head)


def _shared_slots(act: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Slots of groups that hold more than one row."""
    h = head[act]
    if not len(act):
        return act
    starts = np.flatnonzero(h)
    sizes = np.diff(np.append(starts, len(act)))
    return act[np.repeat(sizes > 1, sizes)]


def covered(part: Part, note: pa.Table, kind: Kind, buckets: int) -> np.ndarray:
    """Which symbols of the part's pieces lie in a repeated window."""
    n = int(part.off[-1])
    flag = np.zeros(n + 1, bool)
    s, first, which = unique_pieces(part, note, kind, buckets)
    if len(first):
        u = s.take(first)
        order, at = C.bucket_order(u.h, buckets)
        mask = np.zeros(len(order), np.uint32)
        for b, data in C.notes(note, WINDOWS).items():
            mask[order[at[b] : at[b + 1]]] = np.frombuffer(data, np.uint32)
        mask = mask[which]
        m = s.hi - s.lo + 1
        if kind.by_first:
            whole = part.ids[s.doc] > part.ids[u.doc][which]
        else:
            whole = (np.bincount(which) > 1)[which]
        starts = C.flat(s.lo, m)
        bit = (np.repeat(mask, m) >> C.flat(np.zeros(len(m), np.int64), m).astype(np.uint32)) & np.uint32(1)
        flag[starts[(bit > 0) | np.repeat(whole, m)]] = True
    run = np.cumsum(flag, dtype=np.int32)
    out = run[:n] > 0
    out[kind.window :] = run[kind.window : n] > run[: max(0, n - kind.window)]
    return out


def find_repeats(docs: DataFrame, kind: Kind, load: Callable, finish: Callable, schema: str) -> DataFrame:
    """``docs`` has doc_id and text. load(table) gives a Part without pieces; finish(table, part, cover, own, copied) the result rows of a part, where own
    says which rows the part holds, all but later copies of one text, and copied which rows have such copies.
    """
    parts = C.parts_for(docs)
    buckets = parts
    rows = C.parted(docs, parts)
    copies = C.later_copies(rows)

    def opened(table: pa.Table, note: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        copied, later = C.copies(table, note)
        own = np.array([x is None for x in later], bool)
        part = load(table.filter(pa.array(own)) if not own.all() else table)
        part.pieces = cut_pieces(part.symbols, part.off, kind)
        return table, part, own, copied

    def first_round(key, table, note):
        _, part, _, _ = opened(table, note)
        return C.send_hashes(key[0].as_py(), C.Distinct.of(part.pieces.h, buckets))

    def second_round(key, table, note):
        _, part, _, _ = opened(table, note)
        return send_pieces(key[0].as_py(), part, note, kind, buckets)

    def last_round(key, table, note):
        table, part, own, copied = opened(table, note)
        return finish(table, part, covered(part, note, kind, buckets), own, copied)

    def by_part(note, f, out):
        return rows.groupBy("part").cogroup(note.groupBy("part")).applyInArrow(f, out)

    hashes = by_part(copies, first_round, C.HASHES)
    shared = hashes.groupBy("bucket").applyInArrow(C.answer_counts(SHARED, _encode(kind)), C.NOTES)
    known = C.tree_union([copies, shared])
    windows = by_part(known, second_round, C.HASHES).groupBy("bucket").applyInArrow(answer_pieces(kind), C.NOTES)
    return by_part(C.tree_union([known, windows]), last_round, schema)
