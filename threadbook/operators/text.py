"""Weighted full-text search over a postings table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.udfs import stem as stemmed
from ..functions.udfs import stem_word
from ..schemas import FIELD_WEIGHTS

WORD = r"[\p{L}\p{N}]+"
# English stop words.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has
    had having do does did doing a an the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then once here there when where why how
    all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

_STOP = frozenset(STOP_WORDS)
#: Lexemes of a search up to which they are looked for within the rows.
FEW_LEXEMES = 64


def lexemes(text: str | Column) -> Column:
    """Words in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


_stem_of = lru_cache(1 << 18)(stem_word)


def _grouped_words(words: pa.Array, stem: bool = False) -> pa.Array:
    """For each list of words its distinct ones but for stop words, or their stems, in order, with their number and places."""
    words = words.fill_null([]) if words.null_count else words
    off = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    stop = np.array([n in _STOP for n in names], bool)[code] if names else np.zeros(0, bool)
    if names:  # each distinct word of a batch is stemmed once; numbers are in order of names
        held = np.array([_stem_of(n) for n in names] if stem else names, object)
        names, number = np.unique(held, return_inverse=True)
        code = number[code]
    row = np.repeat(np.arange(len(words)), np.diff(off))
    place = np.arange(len(code)) - (off[:-1] - off[0])[row]
    kept = np.flatnonzero(~stop)
    kept = kept[np.lexsort((place[kept], code[kept], row[kept]))]
    new = np.append(True, (row[kept][1:] != row[kept][:-1]) | (code[kept][1:] != code[kept][:-1]))[: len(kept)]
    first = np.append(np.flatnonzero(new), len(kept))
    lexeme = pa.array(names, pa.string()).take(pa.array(code[kept[first[:-1]]]))
    positions = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(place[kept], pa.int32()))
    entries = pa.StructArray.from_arrays([lexeme, pa.array(np.diff(first), pa.int64()), positions], ["lexeme", "tf", "positions"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[kept[first[:-1]]], np.arange(len(words) + 1)), pa.int32()), entries)


def build_postings(df: DataFrame, weights: dict[str, float] | None = None, stem: bool = False, key: str = "id", only: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """lexeme, id, field, weight, tf, positions (from 0, ascending) of the weighted text fields, without stop words. Null fields are empty.

    ``key`` names a row. Each field's words, or their stems, are grouped where the row is, in Arrow batches, so there is no shuffle. ``only`` (lexeme)
    leaves out all others, before anything else is done with them: a search that has no stored index needs a handful. ``tasks`` deals the texts
    out first where files give less than a task for each core (a row group is read by one); all other texts stay where they are.
    """
    weights = weights or FIELD_WEIGHTS
    if tasks is not None:
        df = df.select(key, *weights)
        if df.select(F.spark_partition_id()).distinct().count() < min(tasks, df.sparkSession.sparkContext.defaultParallelism):
            df = df.repartition(tasks)
    grouped = F.arrow_udf(lambda words: _grouped_words(words, stem), "array<struct<lexeme: string, tf: long, positions: array<int>>>")
    wanted = None
    if only is not None and not stem:
        wanted = [r.lexeme for r in only.select("lexeme").distinct().limit(FEW_LEXEMES + 1).collect()]
        wanted = F.array(*map(F.lit, wanted)).cast("array<string>") if len(wanted) <= FEW_LEXEMES else None

    def words_of(f: str) -> Column:
        words = lexemes(f)
        if wanted is None:
            return grouped(words)
        places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(wanted, x["w"]))

        def entries(held: Column) -> Column:
            each = lambda w: F.transform(F.filter(held, lambda x: x["w"] == w), lambda x: x["i"])
            return F.transform(F.array_distinct(F.transform(held, lambda x: x["w"])), lambda w: F.struct(w.alias("lexeme"), F.size(each(w)).cast("long").alias("tf"), each(w).alias("positions")))

        return F.element_at(F.transform(F.array(places), entries), 1)  # as a variable, the text is split once

    one = df.select(F.col(key).alias("id"), *[words_of(f).alias(f"_{n}") for n, f in enumerate(weights)])
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), F.col(f"_{n}").alias("words")) for n, (f, w) in enumerate(weights.items())])
    words = one.select("id", F.explode(fields).alias("f")).select("id", "f.field", "f.weight", F.explode("f.words").alias("w")).select("w.lexeme", "id", "field", "weight", "w.tf", "w.positions")
    if only is not None and wanted is None and not stem:
        words = words.join(only.select("lexeme").distinct(), "lexeme", "left_semi")
    return words


BUCKETS = 64


def lexeme_bucket(lexeme: str | Column = "lexeme") -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(BUCKETS)).cast("int")


#: Postings that are packed at once on their way to their files.
PACKED = 1 << 17


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with bucket and part, as compressed columns: a row for each bucket and part of ``PACKED`` postings or so."""

    def blobs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by([("bucket", "ascending"), ("part", "ascending"), ("lexeme", "ascending")]).combine_chunks()
        bucket, part = table["bucket"].to_numpy(), table["part"].to_numpy()
        starts = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])))
        rows, out = table.drop_columns(["bucket", "part"]), []
        for first, last in zip(starts, [*starts[1:], len(table)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows.slice(first, last - first))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(part[starts], pa.int32()), pa.array(out, pa.binary())], ["bucket", "part", "rows"])

    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= PACKED:
            yield blobs(held)
            held, n = [], 0
    if held:
        yield blobs(held)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, blob in zip(batch["bucket"].to_pylist(), batch["rows"], strict=True):
            for rows in pa.ipc.open_stream(blob.as_buffer()):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), bucket, np.int32))], [*rows.schema.names, "bucket"])


def write_postings(postings: DataFrame, path: str, files: int = 1) -> None:
    """Stores an index by buckets of lexemes, so that a search reads the buckets of its words only. A bucket is ``files`` files,
    each sorted by lexeme: one common word does not make one large file. Postings go there in packs of compressed columns, which take a fraction of the room of rows.
    """
    columns = [c for c in postings.columns if c != "bucket"]
    kinds = ", ".join(f"`{c}` {postings.schema[c].dataType.simpleString()}" for c in columns)
    named = postings.select(*columns, lexeme_bucket().alias("bucket"), F.pmod(F.xxhash64("id"), F.lit(files)).cast("int").alias("part"))
    tasks = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), BUCKETS * files)
    dealt = named.mapInArrow(lambda x: _packed(x), "bucket int, part int, rows binary").repartition(tasks, "bucket", "part").mapInArrow(lambda x: _unpacked(x), f"{kinds}, bucket int")
    dealt.sortWithinPartitions("bucket", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """A stored index. Its bucket column lets searches prune."""
    return spark.read.parquet(path)


def query_lexemes(queries: DataFrame, first_words: int | None = None, stem: bool = False) -> DataFrame:
    """query_id, lexeme, needed: the distinct lexemes of each query (query_id, text). ``first_words`` looks at so many words only."""
    text = F.col("text") if first_words is None else F.concat_ws(" ", F.slice(F.split(F.trim("text"), r"\s+"), 1, first_words))
    words = queries.select("query_id", F.explode(F.array_distinct(lexemes(text))).alias("lexeme")).where(~F.col("lexeme").isin(*STOP_WORDS))
    if stem:
        words = words.select("query_id", stemmed("lexeme").alias("lexeme")).distinct()
    return words.withColumn("needed", F.count("*").over(W.partitionBy("query_id")))


#: Rows of searches that are sent to every task; more are shuffled.
SENT = 100_000


@dataclass(frozen=True)
class _Searches:
    """Queries with the same lexemes are one search: its matches are scored once, however many ask. ``asked`` has query_id and search (the least query_id of the same lexemes),
    ``words`` has search, lexeme and needed.
    """

    asked: DataFrame
    words: DataFrame

    @classmethod
    def of(cls, queries: DataFrame, first_words: int | None, stem: bool) -> _Searches:
        held = query_lexemes(queries, first_words, stem).groupBy("query_id").agg(F.sort_array(F.collect_list("lexeme")).alias("lexemes"))
        once = held.groupBy("lexemes").agg(F.min("query_id").alias("search"), F.count("*").alias("n"))
        words = once.select("search", F.explode("lexemes").alias("lexeme"), F.size("lexemes").cast("long").alias("needed"))
        asked = held.join(once.select("lexemes", "search"), "lexemes").select("query_id", "search")
        sizes = once.agg(F.sum("n"), F.sum(F.size("lexemes"))).first()
        few = lambda df, n: F.broadcast(df) if (n or 0) <= SENT else df
        return cls(few(asked, sizes[0]), few(words, sizes[1]))

    def expanded(self, scored: DataFrame) -> DataFrame:
        """Rows of searches as rows of queries."""
        return scored.join(self.asked, scored["search"].eqNullSafe(self.asked["search"])).select("query_id", *[c for c in scored.columns if c != "search"])


def _hits(searches: _Searches, postings: DataFrame) -> DataFrame:
    if "bucket" in postings.columns:
        return postings.join(searches.words.withColumn("bucket", lexeme_bucket()), ["bucket", "lexeme"])
    return postings.join(searches.words, "lexeme")


def _ranks(searches: _Searches, postings: DataFrame) -> DataFrame:
    hits = _hits(searches, postings)
    gain = F.col("weight") * (F.col("tf") / (F.col("tf") + 1.0))
    found = hits.groupBy("search", "id").agg(F.count_distinct("lexeme").alias("n"), F.first("needed").alias("needed"), F.round(F.sum(gain), 6).alias("score"))
    return found.where("n = needed").select("search", "id", "score")


def fts_match(queries: DataFrame, postings: DataFrame, first_words: int | None = None, stem: bool = False) -> DataFrame:
    """query_id, id of rows that hold every lexeme of the query. A query without lexemes matches nothing."""
    return fts_rank(queries, postings, first_words, stem).select("query_id", "id")


def fts_rank(queries: DataFrame, postings: DataFrame, first_words: int | None = None, stem: bool = False) -> DataFrame:
    """The matches with score, the sum of weight * tf / (tf + 1) over lexemes and fields, to six digits."""
    searches = _Searches.of(queries, first_words, stem)
    return searches.expanded(_ranks(searches, postings))


def cover_score(positions: list, words: list, weights: list, needed: int) -> float:
    """Sum of weight / span over the minimal covers: stretches that hold every word and no shorter such stretch."""
    order = np.argsort(positions, kind="stable").tolist()
    counts: dict = {}
    total, left = 0.0, 0
    for right, at in enumerate(order):
        counts[words[at]] = counts.get(words[at], 0) + 1
        while len(counts) == needed:
            w = words[order[left]]
            if counts[w] > 1:
                counts[w] -= 1
                left += 1
                continue
            span = positions[at] - positions[order[left]] + 1
            total += fsum(weights[i] for i in order[left : right + 1]) / (right + 1 - left) / span  # a place is in as many covers as there are words, at most
            del counts[w]
            left += 1
    return total


#: Places between the last hit in a field and the next field.
GAP = 1_000_000


def _cover_ranks(searches: _Searches, postings: DataFrame) -> DataFrame:
    places = F.collect_list(F.struct("field", "weight", "lexeme", "positions")).alias("places")
    found = _hits(searches, postings).groupBy("search", "id").agg(places, F.first("needed").alias("needed"))
    found = found.where(F.size(F.array_distinct("places.lexeme")) == F.col("needed"))

    def score(places: pa.Array, needed: pa.Array) -> pa.Array:
        out, ends, hits = [], places.offsets.to_numpy(), places.values
        positions = hits.field("positions")
        at, spots = positions.offsets.to_numpy(), positions.values.to_numpy(zero_copy_only=False).astype(np.int64)
        field, weight, lexeme = (hits.field(n).to_pylist() for n in ("field", "weight", "lexeme"))
        for n, first, last in zip(needed.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            fields: dict = {}
            for i in range(first, last):
                fields.setdefault((-weight[i], field[i]), []).append(i)
            where, words, weights, offset = [], [], [], 0
            for key in sorted(fields):
                for i in fields[key]:
                    where.append(spots[at[i] : at[i + 1]] + offset)
                    words += [lexeme[i]] * len(where[-1])
                    weights += [weight[i]] * len(where[-1])
                offset += int(max(spots[at[i + 1] - 1] for i in fields[key])) + GAP
            out.append(cover_score(np.concatenate(where).tolist(), words, weights, n))
        return pa.array(out, pa.float64())

    return found.select("search", "id", F.round(F.arrow_udf(score, "double")("places", "needed"), 6).alias("score"))


def fts_cover_rank(queries: DataFrame, postings: DataFrame, first_words: int | None = None, stem: bool = False) -> DataFrame:
    """The matches with a cover-density score: the closer the query's words stand, the higher. Fields follow each other with a gap."""
    searches = _Searches.of(queries, first_words, stem)
    return searches.expanded(_cover_ranks(searches, postings))


def ranked(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query with rank from 0; ties to the smaller id."""
    best = W.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("int"))


def fts_topk(queries: DataFrame, postings: DataFrame, k: int, first_words: int | None = None, stem: bool = False, cover: bool = False, within: DataFrame | None = None) -> DataFrame:
    """``ranked`` of ``fts_rank``, or with ``cover`` of ``fts_cover_rank``: each search is ranked once, and the queries that ask for it get its k rows. ``within`` (id) leaves out other rows."""
    searches = _Searches.of(queries, first_words, stem)
    scored = (_cover_ranks if cover else _ranks)(searches, postings)
    if within is not None:
        scored = scored.join(within, "id", "left_semi")
    return searches.expanded(ranked(scored, k, "search").select("search", "id", "score", "rank"))
