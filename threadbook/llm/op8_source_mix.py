"""Mixing sources to target weights: blocks, multinomial draws, index permutations. DataFrame functions only."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

WEIGHTS = (5, 2, 1)
CAP = 3
#: Words in a block, and blocks in an output shard.
BLOCK = 64
SHARD = 4096
SEED = 20240215
#: Rounds of the index permutation, an even number.
ROUNDS = 6
#: Slots that one row stands for until they are dealt out, and that a task makes of such rows.
CHUNK, TASK_SLOTS = 1 << 14, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the space behind it, the first one with that before it too: all of them in order are the text.
SPACED = r"(?:\A[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


@dataclass
class Mix:
    """documents: row_id, doc_id, source, size, source_size, target, offset (words of the source before the document).
    drawn: shard, source, epoch, block: the blocks that each output shard takes, one row a slot.
    texts: row_id, doc_id, source, size, source_size, target, taken and pieces (shard, epoch, block, at, words, text) of each document
    that is taken. Written in the shared folder.
    """

    documents: DataFrame
    drawn: DataFrame
    texts: DataFrame

    @property
    def corpus(self) -> DataFrame:
        """shard, source, epoch, block, at, row_id, words, text: the text of the blocks in ``drawn``, a row for each document that is
        in one, in order of ``at`` (words of the source before it).
        """
        return self.texts.select("row_id", "source", F.explode("pieces").alias("p")).select("p.shard", "source", "p.epoch", "p.block", "p.at", "row_id", "p.words", "p.text")

    @property
    def taken(self) -> DataFrame:
        """row_id, taken: the words of the document that are in ``corpus``."""
        return self.texts.select("row_id", "taken")


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key, at x.

    Rounds of a Feistel network go over pairs (u, v) below (a, b), where a * b is n or the least more: u moves by a hash of v,
    then they change places. That permutes 0..a*b-1; a result of n or more goes in again until it is less (cycle walking).
    Less than a of the a * b are n or more, so that happens once in the square root of n, and the walk ends within a * b - n steps.
    """
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")

    def once(x: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            moved = F.pmod(s["u"] + F.pmod(F.xxhash64(*key, i, s["v"]), s["a"]), s["a"])
            return F.struct(s["v"].alias("u"), moved.alias("v"), s["b"].alias("a"), s["a"].alias("b"))

        pair = F.struct(F.pmod(x, a).alias("u"), F.floor(x / a).cast("long").alias("v"), a.alias("a"), b.alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, turn, lambda s: s["v"] * s["a"] + s["u"])

    first = once(x)
    walked = lambda start: F.aggregate(F.sequence(F.lit(0).cast("long"), a * b - n), start, lambda y, _: F.when(y < n, y).otherwise(once(y)))
    return F.element_at(F.transform(F.array(first), lambda y: F.when(y < n, y).otherwise(walked(y))), 1)


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` has source and source_size. Adds target: shares of the total by weight, at most cap * source_size,
    the excess reshared by weight. Sources in order of the ratio of cap to weight: those whose ratio is at most
    the level of the rest are full.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    upto, onward = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everywhere = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    full = F.col("full").cast("double")
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum(full).over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    out = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * cap).withColumn("ratio", F.col("full") / F.col("weight"))
    out = out.withColumn("level", level).withColumn("level", F.when(F.col("level") < F.col("ratio"), F.col("level")))
    rest = F.first("level", ignorenulls=True).over(everywhere)
    return out.withColumn("target", F.when(F.col("level").isNull(), full).otherwise(rest * F.col("weight"))).select("source", "source_size", "target")


def named(df: DataFrame) -> DataFrame:
    """Adds nil and name, by which a null source joins as others do and rows stay where a grouping has sent them."""
    return df.withColumn("nil", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))


def starts(df: DataFrame, bucket: str, order: list[str], value: str, extra: DataFrame) -> DataFrame:
    """Adds offset, the sum of ``value`` over the earlier rows of the source: by bucket first, so that no task holds
    more of a source than the square root of its rows. ``extra`` is joined on the source by way of the buckets.
    """
    df = named(df)
    inner = W.partitionBy("nil", "name", bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("nil", "name").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy("nil", "name", bucket).agg(F.sum(value).alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    totals = totals.join(named(extra).drop("source"), ["nil", "name"])
    out = df.withColumn("within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = out.join(totals.hint("merge"), ["nil", "name", bucket]).withColumn("offset", F.col("base") + F.col("within"))
    return joined.drop("base", "within")


@contextmanager
def by_leading_keys(spark: SparkSession):
    """Lets joins keep rows where a grouping by some of the keys has sent them, so that texts move once."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def cut(placed: DataFrame, block: int) -> DataFrame:
    """The pieces of blocks: nil, name, bucket, row_id, about, block, at, words and text. Each text is split once."""
    end = F.col("offset") + F.col("size")

    def piece(words: Column, b: Column) -> Column:
        begin, stop = F.greatest(F.col("offset"), b * block), F.least(end, (b + 1) * block)
        n = stop - begin
        text = F.array_join(F.slice(words, (begin - F.col("offset") + 1).cast("int"), n.cast("int")), "")
        return F.struct(b.alias("block"), begin.alias("at"), n.alias("words"), text.alias("text"))

    numbers = F.sequence(F.floor(F.col("offset") / block), F.floor((end - 1) / block))
    cuts = F.transform(F.array(F.regexp_extract_all("text", F.lit(SPACED), 0)), lambda words: F.transform(numbers, lambda b: piece(words, b)))
    keys = ["nil", "name", "bucket", "row_id", "about"]
    return placed.select(*keys, F.explode(F.element_at(cuts, 1)).alias("p")).select(*keys, "p.*")


def draw_slots(sources: DataFrame, cap: int = CAP, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``sources`` has source, source_size, target and blocks. Returns shard, source, epoch and block, one row a slot.

    A source has as many slots as give its target, a whole number, and at most ``cap`` times its blocks. The slots of all sources are
    dealt to output shards of ``shard`` slots by one permutation, so each shard's source counts are drawn as a multinomial whose
    totals over all shards are given. The j-th slot of a source takes block p(j) by the source's permutation p, a new one each time round.
    """
    n = F.least(F.round(F.col("target") / (F.col("source_size") / F.col("blocks"))).cast("long"), F.col("blocks") * cap)
    share = sources.where("target > 0").select("source", "blocks", n.alias("n")).where("n > 0")
    by_name = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    share = share.withColumn("base", F.coalesce(F.sum("n").over(by_name), F.lit(0)))
    n_slots = share.agg(F.sum("n")).first()[0] or 1
    total, tasks = F.lit(n_slots).cast("long"), max(shuffle_partitions(sources.sparkSession), -(-n_slots // TASK_SLOTS))
    step = F.lit(CHUNK).cast("long")
    chunks = share.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step))).repartition(tasks, "source", "low")
    rows = chunks.withColumn("slot", F.explode(F.sequence("low", F.least(F.col("low") + CHUNK, F.col("n")) - 1)))
    place = permuted(F.col("base") + F.col("slot"), total, F.lit(seed))
    rows = rows.select("source", "blocks", "slot", F.floor(place / shard).cast("long").alias("shard"), F.floor(F.col("slot") / F.col("blocks")).cast("long").alias("epoch"))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("source"), F.col("epoch"))
    return rows.select("shard", "source", "epoch", block.alias("block"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Mix:
    """Draws a corpus in which each source has its target share of words.

    Documents are packed by source into blocks of ``block`` words; ``draw_slots`` draws how many blocks of each source an output
    shard takes, and maps slots to blocks by permutations of the source's blocks, at most ``cap`` times round. The texts,
    cut at the bounds of blocks, are joined with the slots by block and written.

    Null and empty texts have size 0 and are never taken; a very long text is cut into blocks as others are, and no task holds its source. A null source is a source, last in order. Equal rows are
    documents of their own; rows that share id, size and text may change places. With no words at all, all targets are 0. An empty table gives no rows. Hashes of ids
    and sources make all draws, so reruns agree. Other columns are ignored.
    """
    source, digest = F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("digest")
    rows = written(docs.select("doc_id", source, n_words("text").alias("size"), digest).withColumn("row_id", F.monotonically_increasing_id()))
    n = rows.count()
    buckets = max(1, round(n**0.5))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sources = written(sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")))
    bucket = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets))
    in_bucket = W.partitionBy("nil", "name", "bucket")
    placed = starts(rows.withColumn("bucket", bucket), "bucket", ["doc_id", "digest", "row_id"], "size", sources.drop("blocks"))
    placed = written(placed.withColumn("nth", F.row_number().over(in_bucket.orderBy("doc_id", "digest", "row_id"))))

    slots = written(draw_slots(sources, cap, shard, seed))  # written, so that joins know their size

    keys = ["nil", "name", "bucket"]
    full = placed.where("size > 0")
    # merge: Spark takes an exploded table to be as small as what it was made of, and would send all blocks through the driver
    ranges = full.groupBy(*keys).agg(F.min("offset").alias("low"), F.max(F.col("offset") + F.col("size") - 1).alias("high"))
    ranges = ranges.select(*keys, F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))).alias("block"))
    wanted = ranges.join(named(slots).hint("merge"), ["nil", "name", "block"])
    # equal ids and digests are equal texts, so it does not matter which of them is the n-th
    texts = named(docs.select("doc_id", source, F.col("text").cast("string").alias("text"), digest)).withColumn("bucket", bucket)
    texts = texts.withColumn("nth", F.row_number().over(in_bucket.orderBy("doc_id", "digest"))).select(*keys, "nth", "text")
    with by_leading_keys(docs.sparkSession):
        about = F.struct("doc_id", "source", "size", "source_size", "target").alias("about")
        pieces = cut(texts.join(full.select(*keys, "nth", "row_id", "offset", "size", about).hint("merge"), [*keys, "nth"]), block).join(wanted.drop("source").hint("merge"), [*keys, "block"])
        pieces = pieces.groupBy(*keys, "row_id").agg(F.first("about").alias("about"), F.collect_list(F.struct("shard", "epoch", "block", "at", "words", "text")).alias("pieces"))
        words = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"])
        corpus = written(pieces.select("row_id", "about.*", words.alias("taken"), "pieces"))
    return Mix(placed.drop(*keys, "nth", "digest"), slots, corpus)


def shard_texts(mix: Mix) -> DataFrame:
    """The output shards, one row a block: shard, source, epoch, block, text. A shard is in one partition, its blocks in a hashed order; an empty line parts documents."""
    blocks = mix.corpus.groupBy("shard", "source", "epoch", "block").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("pieces"))
    out = blocks.select("shard", "source", "epoch", "block", F.array_join("pieces.text", "\n\n").alias("text"))
    return out.repartition("shard").sortWithinPartitions("shard", F.xxhash64("shard", "source", "epoch", "block"))


def mixed(mix: Mix) -> DataFrame:
    out = mix.documents.join(mix.taken.hint("merge"), "row_id", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed_texts(mix: Mix) -> DataFrame:
    """As ``mixed``, with the pieces of each document's text that the mix takes, in order; none for one that is not taken."""
    columns = ["doc_id", "size", "source_size", "target", "taken", "source", "pieces"]
    taken = mix.texts.withColumn("pieces", F.sort_array("pieces"))
    rest = mix.documents.join(mix.texts.select("row_id").hint("merge"), "row_id", "left_anti").withColumn("taken", F.lit(0).cast("long"))
    return taken.select(columns).unionByName(rest.withColumn("pieces", F.array().cast(mix.texts.schema["pieces"].dataType)).select(columns))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: Draws are beyond SQL; tests hold them against counting.
SQL = None


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """The part of ``op8_source_mix`` that SQL can say."""
    return op8_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


EXTRA = {
    "mix_targets": (
        mix_targets,
        r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT min_by(level, ratio) AS level FROM v WHERE level < ratio),
t AS (SELECT v.source, source_size, CASE WHEN v.level < ratio THEN l.level * weight ELSE cap END AS target FROM v LEFT JOIN l ON true)
SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
""",
    )
}
