"""Functions that need Python: regex checks, stemming, embedding and extraction. All run on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MAX_PATTERN
from . import columns as X


def _usable(p: str | None) -> bool:
    """No pattern, or one that compiles and is not too long."""
    if p is None:
        return True
    if len(p) > MAX_PATTERN:
        return False
    try:
        re.compile(p)
    except (re.error, OverflowError, RecursionError):
        return False
    return True


def pattern_ok(pattern: str | Column) -> Column:
    return F.pandas_udf(lambda s: s.map(_usable).astype(bool), "boolean")(pattern)


# ---------------------------------------------------------------- stemming


def _measure(w: str) -> int:
    """Vowel-consonant turns of a word."""
    return len(re.findall("vc", re.sub(r"(.)\1*", r"\1", _shape(w))))


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _short_end(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# Suffixes of the published English stemmer (Porter, 1980), by step.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _swap(w: str, table: str, least: int) -> str:
    pairs = sorted((x.partition(":")[::2] for x in table.split()), key=lambda p: -len(p[0]))
    for end, new in pairs:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) >= least and not (end == "ion" and base[-1:] not in ("s", "t")):
                return base + new
            return w
    return w


def stem_word(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, 1)
    w = _swap(w, _STEP3, 1)
    w = _swap(w, " ".join(f"{x}:" for x in _STEP4.split()), 2)
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem(word: str | Column) -> Column:
    return F.pandas_udf(lambda s: s.map(stem_word, na_action="ignore"), "string")(word)


# ---------------------------------------------------------------- models


def hashed_embedder(dimensions: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A stand-in that needs no model: signed word counts by hash, without signs where those cancel out, so that only a text without words has no vector."""

    def load():
        import zlib

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions))
            for i, t in enumerate(texts):
                hashes = [zlib.crc32(w.encode()) for w in re.findall(r"\w+", t.lower())]
                for h in hashes:
                    out[i, h % dimensions] += 1 if h & (1 << 31) else -1
                if hashes and not out[i].any():
                    for h in hashes:
                        out[i, h % dimensions] += 1
            return out

        return embed

    return load


def _unit_rows(m) -> list:
    m = np.asarray(m, float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return [x.astype(np.float32).tolist() if n > 0 else None for x, n in zip(m / np.where(norm > 0, norm, 1), norm[:, 0], strict=True)]


def embed(df: DataFrame, text: str = "raw_text", to: str = "embedding", load=None, batch: int = 64) -> DataFrame:
    """Adds the unit vector of a text. ``load`` makes an embedder (texts -> matrix) once for each worker; the rows of a batch that
    fails are tried one at a time, and those that fail alone have null vectors and a message in ``<to>_error``.
    """
    load = load or hashed_embedder()
    rest = [c for c in df.columns if c not in (to, f"{to}_error")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for s in batches:
            vectors, errors = [], []
            for i in range(0, len(s), batch):
                some = s.iloc[i : i + batch].fillna("").tolist()
                try:
                    model = model or load()
                    made = _unit_rows(model(some)), [None] * len(some)
                except Exception as e:  # a model's failure is a result
                    made = [], []
                    for t in some:  # which rows it fails on does not depend on their batch
                        try:
                            if model is None or len(some) == 1:
                                raise e
                            one = _unit_rows(model([t])), [None]
                        except Exception as why:
                            one = [None], [f"{type(why).__name__}: {why}"]
                        made[0].extend(one[0])
                        made[1].extend(one[1])
                vectors += made[0]
                errors += made[1]
            yield pd.DataFrame({"vector": vectors, "error": errors})

    made = F.pandas_udf(run, "vector array<float>, error string")(F.col(text).cast("string"))
    return df.select(*rest, made.alias("_made")).select(*rest, F.col("_made.vector").alias(to), F.col("_made.error").alias(f"{to}_error"))


def extract(df: DataFrame, extractor: Callable[[str], str | None], fallback: Callable[[str], str | None] | None = None, prompt: str = "prompt") -> DataFrame:
    """Adds outcome (ok, skip, error) and data from a model's answer to the prompt. The fallback sees only rows whose first
    answer was missing or no JSON.
    """

    def asked(f: Callable[[str], str | None]):
        def run(s: pd.Series) -> pd.Series:
            out = []
            for p in s:
                try:
                    out.append(f(p) if p is not None else None)
                except Exception:  # counted as no answer
                    out.append(None)
            return pd.Series(out, dtype=object)

        return F.pandas_udf(run, "string")

    parsed = df.withColumn("_p", X.parse_extraction(asked(extractor)(prompt)))
    if fallback:
        needs = F.when(F.col("_p.outcome") == "error", F.col(prompt))
        parsed = parsed.withColumn("_q", X.parse_extraction(asked(fallback)(needs))).withColumn("_p", F.when(F.col("_p.outcome") == "error", F.col("_q")).otherwise(F.col("_p"))).drop("_q")
    return parsed.select(*df.columns, F.col("_p.outcome").alias("outcome"), F.col("_p.data").alias("data"))


def register(spark: SparkSession) -> None:
    """Names for SQL: stem, pattern_ok, and the JVM expressions as SQL functions."""
    spark.udf.register("stem_word", F.pandas_udf(lambda s: s.map(stem_word, na_action="ignore"), "string"))
    spark.udf.register("pattern_ok", F.pandas_udf(lambda s: s.map(_usable).astype(bool), "boolean"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION derive_project(cwd STRING) RETURNS STRING RETURN CASE WHEN coalesce(cwd, '') = '' THEN 'unknown' ELSE regexp_extract(rtrim('/', cwd), '([^/]*)$', 1) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION recency(age_days DOUBLE) RETURNS DOUBLE RETURN CASE WHEN age_days IS NULL THEN 1.0D ELSE 1.0D + exp(-greatest(age_days, 0.0D) / 10.0D) END")
