"""Quality classifier by co-training: a text view and a page-metadata view teach each other, and their calibrated scores combine.

1. A bounded sample of labelled rows starts both views. The text view has byte frequencies, sizes and the words and pairs of words that
   tell most about the target; which these are is counted on the executors.
2. The features of all documents are made once and written, some 300 bytes each. Each round, every unlabelled document of the corpus is
   scored by both views on the executors. The most confident ones of each class are what a view teaches the other; ranks are by
   partial top lists, and only the rows that are taught come to the driver.
3. Labelled rows of one fold calibrate the views and their combination, which scores all documents; another fold measures.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
#: Labelled rows that training sees at most, the ones with the smallest id hashes.
LABELLED = 20_000
ROUNDS = 3
#: Confidence from which a view teaches the other, and how many of each class it teaches in a round: the most confident of the corpus,
#: this share of the labelled rows of that class, so that neither the classes' shares nor the labels' weight is lost.
CONFIDENT, TAUGHT = 0.97, 0.2
#: Parts of the labelled rows, each of which is judged by what was fitted on the others, to tell how far a view can be trusted.
CROSSED = 2
#: Documents whose score is below are rejected.
KEEP = 0.4
#: Documents whose toxic score is at least this are toxic.
TOXIC = 0.5
#: Bits of the hashes of words and of pairs of words, and how many of these bins, the most telling ones, a text view has.
WORD_BITS, TELLING = 18, 64
SOURCE_BINS, LANG_BINS, SIZE_BINS = 64, 16, 24
TARGETS = ("quality", "toxic")
_TEXT = 129 + 4
#: Added to the size of a text, so that the bytes of very short ones weigh little.
PRIOR_BYTES = 60
#: Parts of a ranking before the last.
SALTS = 64
#: Tasks that count the words of the labelled sample.
COUNTERS = 4


# ---------------------------------------------------------------- views


def text_view(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Features of each text: square roots of the byte frequencies (non-ASCII is one), share of distinct words, share of the
    commonest step from word to word, mean word length and size. Bytes of very long texts count in full.
    """
    n = len(off) - 1
    out = np.zeros((n, _TEXT), np.float64)
    for a, b in C.chunked_rows(off):
        data, rows = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        size = np.diff(rows)
        row = np.repeat(np.arange(b - a), size)
        seen = np.bincount(row * 129 + np.minimum(data, 128), minlength=(b - a) * 129).reshape(b - a, 129)
        out[a:b, :129] = np.sqrt(seen / (size + PRIOR_BYTES)[:, None])
        h, starts, ends, at = C.words(data, rows, C.FOLDED)
        words = np.diff(at)
        of = np.repeat(np.arange(b - a), words)
        key = np.sort((of.astype(U64) << U64(40)) | (h >> U64(24)))
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        distinct = np.bincount((key[new] >> U64(40)).astype(np.int64), minlength=b - a)
        again = np.append(False, (h[1:] == h[:-1]) & (of[1:] == of[:-1]))[: len(h)]
        some = np.maximum(words, 1)
        out[a:b, 129] = distinct / some
        out[a:b, 130] = np.bincount(of, weights=again, minlength=b - a) / some
        out[a:b, 131] = np.log1p(np.bincount(of, weights=ends - starts, minlength=b - a) / some)
        out[a:b, 132] = np.log1p(size) / 10
    return out


def word_bins(buf: np.ndarray, off: np.ndarray):
    """Row and bin of each word (letters, digits and non-ASCII, A-Z in lower case) and of each pair of neighbours, some rows at a time."""
    for a, b in C.chunked_rows(off):
        h, _, _, at = C.words(buf[off[a] : off[b]], off[a : b + 1] - off[a], C.ALNUM)
        row = np.repeat(np.arange(a, b), np.diff(at))
        near = np.flatnonzero(row[1:] == row[:-1])
        pair = C.mix(h[near] * U64(3) + h[near + 1])
        yield np.append(row, row[near]), (np.append(h, pair) >> U64(64 - WORD_BITS)).astype(np.int64)


def word_view(buf: np.ndarray, off: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which of the chosen bins, given in order of any kind and more than once if need be, each text has."""
    some, column = np.unique(chosen, return_inverse=True)
    out = np.zeros((len(off) - 1, len(some)), np.uint8)
    place = np.full(1 << WORD_BITS, -1, np.int32)
    place[some] = np.arange(len(some))
    for row, bins in word_bins(buf, off):
        at = place[bins]
        seen = at >= 0
        out[row[seen], at[seen]] = 1
    return out[:, column]


def metadata_columns() -> list[Column]:
    """Bins of source, language and declared size; a null has a bin of its own."""
    held = lambda c, n: F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(n - 1)) + 1, F.lit(0)).cast("int")
    binned = lambda c, n: F.when(F.col(c).isNull(), F.lit(0)).otherwise(held(c, n)).cast("int")
    size = F.when(F.col("n_chars").isNull(), F.lit(0)).otherwise(F.least(F.lit(SIZE_BINS - 1), 1 + F.floor(F.log2(1 + F.greatest(F.col("n_chars").cast("double"), F.lit(0.0)))))).cast("int")
    return [binned("source", SOURCE_BINS).alias("source_bin"), binned("lang", LANG_BINS).alias("lang_bin"), size.alias("size_bin")]


def metadata_view(source: np.ndarray, lang: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(source), SOURCE_BINS + LANG_BINS + SIZE_BINS), np.float32)
    at = np.arange(len(source))
    out[at, source] = 1
    out[at, SOURCE_BINS + lang] = 1
    out[at, SOURCE_BINS + LANG_BINS + size] = 1
    return out


# ---------------------------------------------------------------- models


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.intercept


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 25, some: int = 2048) -> Logistic:
    """Ridge logistic regression by Newton steps, ``some`` rows at a time. One class alone gives its (smoothed) rate."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    scale = np.where(scale > 1e-9, scale, 1.0)
    k = x.shape[1] + 1
    w = np.zeros(k)
    rate = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(rate / (1 - rate))
    if 0 < y.sum() < len(y):
        penalty = np.full(k, ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            bend, slope = np.diag(penalty + 1e-9), -penalty * w
            for i in range(0, len(y), some):
                z = np.column_stack([(x[i : i + some] - mean) / scale, np.ones(len(y[i : i + some]))])
                p = sigmoid(z @ w)
                bend += (z * (p * (1 - p))[:, None]).T @ z
                slope += z.T @ (y[i : i + some] - p)
            step = np.linalg.solve(bend, slope)
            w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


@dataclass
class Model:
    """Both views, their calibrations and the combination of the calibrated margins."""

    text: Logistic
    metadata: Logistic
    text_scale: Logistic
    metadata_scale: Logistic
    joint: Logistic
    held_out: dict

    def score(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale.margin(self.text.margin(text)[:, None])
        b = self.metadata_scale.margin(self.metadata.margin(metadata)[:, None])
        return sigmoid(a), sigmoid(b), sigmoid(self.joint.margin(np.column_stack([a, b])))


class CoTraining:
    """Both views of one target. Labelled rows (``y`` is 1, 0 or nan for rows that do not count) of fold 0 calibrate, of fold 1 measure, the others train."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray, share: float = TAUGHT):
        known = ~np.isnan(y)
        self.views, self.y = views, y
        self.train, self.tune, self.test = known & (fold > 1), known & (fold == 0), known & (fold == 1)
        if not self.train.any():
            self.train = self.tune = self.test = known
        if not self.tune.any():
            self.tune = self.train
        self.taught = [(v[self.train], y[self.train]) for v in views]
        self.n_train = int(self.train.sum())
        self.seen = np.flatnonzero(self.train | self.tune)
        self.part = self._parts()
        told = min(int((y[self.seen] == c).sum()) for c in (1, 0)) >= CROSSED
        self.most = {c: int(np.ceil(share * (y[self.train] == c).sum())) * told for c in (1.0, 0.0)}
        self.fit()

    def _parts(self) -> np.ndarray:
        """The part of each labelled row that takes part in training; both classes are in each, if there are rows enough."""
        part, y = np.zeros(len(self.seen), np.int64), self.y[self.seen]
        for c in (1, 0):
            rows = np.flatnonzero(y == c)
            part[rows] = np.arange(len(rows)) % CROSSED
        return part

    def fit(self) -> None:
        """Fits the views, and how far their margins can be trusted: by labelled rows that they have not seen, each part in its turn."""
        self.models = [fit_logistic(x, labels) for x, labels in self.taught]
        self.trust = []
        for v, (x, labels) in zip(self.views, self.taught, strict=True):
            margin = np.zeros(len(self.seen))
            for k in range(CROSSED):
                rest, own = self.seen[self.part != k], self.part == k
                if len(rest):
                    crossed = fit_logistic(np.concatenate([v[rest], x[self.n_train :]]), np.append(self.y[rest], labels[self.n_train :]))
                    margin[own] = crossed.margin(v[self.seen[own]])
            self.trust.append(fit_logistic(margin[:, None], self.y[self.seen], ridge=1.0))

    def teach(self, pupil: int, x: np.ndarray, label: float) -> None:
        rows, labels = self.taught[pupil]
        self.taught[pupil] = np.concatenate([rows, x]), np.append(labels, np.full(len(x), label))

    def model(self) -> Model:
        y, tune, test = self.y, self.tune, self.test
        scales = [fit_logistic(m.margin(v[tune])[:, None], y[tune], ridge=1e-3) for m, v in zip(self.models, self.views, strict=True)]
        margins = np.column_stack([s.margin(m.margin(v)[:, None]) for s, m, v in zip(scales, self.models, self.views, strict=True)])
        joint = fit_logistic(margins[tune], y[tune], ridge=1e-3)
        p = sigmoid(joint.margin(margins[test])) if test.any() else np.zeros(0)
        right = (p >= KEEP) == (y[test] == 1)
        return Model(*self.models, *scales, joint, {"rows": int(test.sum()), "accuracy": float(right.mean()) if len(right) else None})


# ---------------------------------------------------------------- Spark


FEATURES = "doc_id long, base binary, words binary, source_bin int, lang_bin int, size_bin int"


@dataclass
class Views:
    """What a document's text and metadata views are, by target: the telling bins of each."""

    chosen: dict[str, np.ndarray]

    def packed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The features of a batch of documents as rows of ``FEATURES``: halves for the numbers, a bit for each telling bin."""
        buf, off = C.text_buffer(batch["text"])
        base = text_view(buf, off).astype(np.float16)
        bits = np.packbits(word_view(buf, off, np.concatenate([np.zeros(0, np.int64), *self.chosen.values()])), axis=1)
        rows = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
        return pa.RecordBatch.from_arrays([batch["doc_id"], rows(base), rows(bits), *(batch[c] for c in BINS)], ["doc_id", "base", "words", *BINS])

    def unpacked(self, rows: pa.RecordBatch | pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Text views by target, and the metadata view, of rows of ``FEATURES``."""
        column = lambda c: rows[c].to_pylist() if isinstance(rows, pa.RecordBatch) else rows[c].tolist()
        n = len(column("base"))
        base = np.frombuffer(b"".join(column("base")), np.float16).reshape(n, _TEXT).astype(np.float32)
        k = sum(map(len, self.chosen.values()))
        bits = np.unpackbits(np.frombuffer(b"".join(column("words")), np.uint8).reshape(n, -(-k // 8)), axis=1, count=k) if k else np.zeros((n, 0), np.uint8)
        text, at = {}, 0
        for t, c in self.chosen.items():
            text[t] = np.column_stack([base, bits[:, at : at + len(c)].astype(np.float32)])
            at += len(c)
        return text, metadata_view(*(np.array(column(c), np.int64) for c in BINS))

    def of(self, batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
        return self.unpacked(self.packed(batch))


@dataclass
class Models:
    """The models of both targets, without those of which there are no labels. held_out: of labelled rows that took no part in training,
    how many are toxic and not, how many of the toxic are caught and of the others rejected. taught: pseudo-labels by round.
    features: those of all documents, a row each.
    """

    views: Views
    of: dict[str, Model]
    held_out: dict = field(default_factory=dict)
    taught: list[int] = field(default_factory=list)
    features: DataFrame | None = None

    @property
    def quality(self) -> Model | None:
        return self.of.get("quality")

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, metadata and joint score of quality, and the toxic score, by row of documents or of ``FEATURES``."""
        n = batch.num_rows
        parts = []
        for i in range(0, n, ROWS):
            part = batch.slice(i, ROWS)
            text, metadata = self.views.unpacked(part) if "base" in batch.schema.names else self.views.of(part)
            k = len(metadata)
            quality = self.of["quality"].score(text["quality"], metadata) if "quality" in self.of else (np.ones(k),) * 3
            parts.append((*quality, self.of["toxic"].score(text["toxic"], metadata)[2] if "toxic" in self.of else np.zeros(k)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 4


#: Rows whose features are held at once.
ROWS = 1024
BINS = ["source_bin", "lang_bin", "size_bin"]


def _fold(ids: np.ndarray) -> np.ndarray:
    return (C.mix(ids.astype(np.int64).view(U64)) % U64(10)).astype(np.int64)


def _sample(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """doc_id, quality and toxic of the sampled labelled ids: the bound is a parameter, so the frame may be broadcast."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(*[f(t).cast("double").alias(t) for f, t in ((F.min, "quality"), (F.max, "toxic"))])
    return known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)


def _telling(rows: DataFrame, y: dict[str, tuple[int, int]], most: int = TELLING) -> dict[str, np.ndarray]:
    """By target, the bins whose presence in the training rows says most about it, by the G statistic; ``y`` has the numbers of rows of class 1 and 0."""

    def seen(batches):
        counts = np.zeros((4, 1 << WORD_BITS), np.int64)
        for b in batches:
            train = _fold(np.asarray(b["doc_id"])) > 1
            marks = [np.asarray(b[t].to_pandas(), np.float64) for t in TARGETS]
            for row, bins in word_bins(*C.text_buffer(b["text"])):
                both = np.unique((row << WORD_BITS) | bins)  # once a text
                row, bins = both >> WORD_BITS, both & ((1 << WORD_BITS) - 1)
                for n, (m, v) in enumerate((m, v) for m in marks for v in (1, 0)):
                    counts[n] += np.bincount(bins[train[row] & (m[row] == v)], minlength=1 << WORD_BITS)
        some = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some]) for c in counts)], ["bin", "quality1", "quality0", "toxic1", "toxic0"])

    counts = rows.select("doc_id", "text", *TARGETS).repartition(COUNTERS).mapInArrow(seen, "bin long, quality1 long, quality0 long, toxic1 long, toxic0 long")
    counts = C.written(counts.groupBy("bin").agg(*[F.sum(c).cast("double").alias(c) for c in counts.columns[1:]]))
    out = {}
    for t, (n1, n0) in y.items():
        with1, with0 = F.col(f"{t}1"), F.col(f"{t}0")
        part = (with1 + with0) / float(n1 + n0)
        term = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
        g = term(with1, part * n1) + term(with0, part * n0) + term(n1 - with1, (1 - part) * n1) + term(n0 - with0, (1 - part) * n0)
        best = counts.where(with1 + with0 >= 3).select("bin", F.round(g, 9).alias("g")).where("g > 0").orderBy(F.desc("g"), "bin").limit(most)
        out[t] = np.sort(np.array([r.bin for r in best.collect()], np.int64))
    return out


def _confident(features: DataFrame, marks: DataFrame, views: Views, learners: dict[str, CoTraining], used: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, target, teacher and label of the rows to teach: of all unlabelled documents, the most confident ones of each teacher and class."""
    models = {t: (x.models, x.trust) for t, x in learners.items() if any(x.most.values())}

    def margins(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                text, metadata = views.unpacked(part)
                ids = np.asarray(part["doc_id"])
                for t, (views_of, trust) in models.items():
                    fresh = ~np.isin(ids, used[t])
                    for teacher, x in enumerate((text[t], metadata)):
                        m = trust[teacher].margin(views_of[teacher].margin(x)[:, None])
                        sure = np.flatnonzero(fresh & (np.abs(m) >= np.log(CONFIDENT / (1 - CONFIDENT))))
                        k = len(sure)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[sure]), pa.array([t] * k, pa.string()), pa.array(np.full(k, teacher)), pa.array((m[sure] > 0).astype(np.float64)), pa.array(np.abs(m[sure]))], ["doc_id", "target", "teacher", "label", "margin"])

    sure = features.where("doc_id is not null").mapInArrow(margins, "doc_id long, target string, teacher long, label double, margin double")
    known = marks.select("doc_id", F.explode(F.array(*[F.when(F.col(t).isNotNull(), F.lit(t)) for t in TARGETS])).alias("target")).where("target is not null").distinct()
    pool = sure.join(known, ["doc_id", "target"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for keys in (["target", "teacher", "label", "salt"], ["target", "teacher", "label"]):
        best = W.partitionBy(*keys).orderBy(F.desc(F.round("margin", 9)), F.xxhash64("doc_id"), "doc_id")
        pool = pool.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max(k for x in learners.values() for k in x.most.values()))
    most = F.coalesce(*[F.when((F.col("target") == t) & (F.col("label") == c), F.lit(k)) for t, x in learners.items() for c, k in x.most.items()])
    return pool.where(F.col("n") <= most).select("doc_id", "target", "teacher", "label")


def fit_both(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, share: float = TAUGHT) -> Models:
    """Trains both targets: on a bounded sample of labelled rows, and on what the views teach each other of all others, in a round ``share`` of the
    labelled rows of a class. Where a class has fewer than two labels, no confidence can be told and nothing is taught: ``taught`` is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *metadata_columns())
    chosen = C.written(_sample(docs, labels, labelled))
    marks = chosen.toPandas().set_index("doc_id")
    fold = _fold(marks.index.to_numpy(np.int64))
    targets = [t for t in TARGETS if marks[t].notna().any()]
    none = Views({t: np.zeros(0, np.int64) for t in targets})
    if not targets:
        return Models(none, {})
    classes = {t: tuple(int(((marks[t] == v) & (fold > 1)).sum()) for v in (1, 0)) for t in targets}
    telling = _telling(rows.join(F.broadcast(chosen), "doc_id"), {t: n for t, n in classes.items() if min(n)})
    views = Views({t: telling.get(t, none.chosen[t]) for t in targets})

    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                yield views.packed(b.slice(i, ROWS))

    features = C.written(rows.mapInArrow(pack, FEATURES))

    def views_of(ids: DataFrame) -> pd.DataFrame:  # of a bounded number of documents, one row of each
        got = features.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").toPandas()
        return got.sort_values(list(got.columns)).drop_duplicates("doc_id").reset_index(drop=True)

    got = views_of(chosen)
    text, metadata = views.unpacked(got)
    ids = got["doc_id"].to_numpy(np.int64)
    del got
    learners = {t: CoTraining((text[t], metadata), marks[t].reindex(ids).to_numpy(np.float64), _fold(ids), share) for t in targets}
    used, taught = {t: np.zeros(0, np.int64) for t in targets}, []
    for _ in range(rounds if any(n for x in learners.values() for n in x.most.values()) else 0):
        pseudo = C.written(_confident(features, labels, views, learners, used))  # a bounded number for each teacher and class
        pairs = pseudo.toPandas()
        if not len(pairs):
            break
        taught.append(len(pairs))
        new = views_of(pseudo)
        new_text, new_metadata = views.unpacked(new)
        place = pd.Series(np.arange(len(new)), new["doc_id"])
        for (t, teacher, label), ids in pairs.sort_values(list(pairs.columns)).groupby(["target", "teacher", "label"])["doc_id"]:
            learners[t].teach(1 - teacher, (new_text[t] if teacher == 1 else new_metadata)[place.loc[ids].to_numpy()], label)
            used[t] = np.union1d(used[t], ids)
        for x in learners.values():
            x.fit()
    out = Models(views, {t: x.model() for t, x in learners.items()}, taught=taught, features=features)
    if "toxic" in out.of:
        x = learners["toxic"]
        found, bad = out.of["toxic"].score(*(v[x.test] for v in x.views))[2] >= TOXIC, x.y[x.test] == 1
        out.held_out = {"toxic": int(bad.sum()), "caught": int((found & bad).sum()), "others": int((~bad).sum()), "rejected": int((found & ~bad).sum())}
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """The model of quality. None without any labelled document."""
    return fit_both(docs, labels, labelled).quality


SCHEMA = "doc_id long, text_score double, metadata_score double, score double, keep boolean, toxic_score double"


def score_documents(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """Returns one row per input row: doc_id, text_score, metadata_score (calibrated chances of quality 1), score, keep (by quality
    alone) and toxic_score (the chance of toxic 1; a document is toxic from ``TOXIC``).

    Null and empty texts have zero text features; very long ones count in full; null source, lang and n_chars have bins of their own. Null ids and
    repeated rows are scored, but only one row of an id trains, and repeated labels count once with the smaller quality and the
    larger toxic. Without labels of quality every document is kept with score 1, without labels of toxic none is toxic. An empty
    table gives no rows. Other columns are ignored.
    """
    models = fit_both(docs, labels, labelled)
    features, models.features = models.features, None

    def run(batches):
        for b in batches:
            a, m, p, t = models.score(b)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(a), pa.array(m), pa.array(p), pa.array(p >= KEEP), pa.array(t)], ["doc_id", "text_score", "metadata_score", "score", "keep", "toxic_score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *metadata_columns())
    return (given if features is None else features).mapInArrow(run, SCHEMA)


def keep_documents(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, targets: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """The rows that none of ``targets`` rejects, with all their columns.

    Rows count as in ``score_documents``: null and empty texts, null ids, very long texts and repeated rows are judged like any others, without
    labels every row stays, and an empty table gives no rows.
    """
    models, columns = fit_both(docs, labels, labelled), docs.columns
    models.features = None

    def run(batches):
        for b in batches:
            row = pa.RecordBatch.from_struct_array(b["row"])
            _, _, p, t = models.score(pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b["text"], *(b[c] for c in BINS)], ["doc_id", "text", *BINS]))
            keep = (p >= KEEP if "quality" in targets else p >= 0) & (t < TOXIC if "toxic" in targets else t >= 0)
            yield row.filter(pa.array(keep))

    held = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"), *metadata_columns())
    return held.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_documents(read("documents"), read("labels"))


SQL = None
