"""Corpus pipeline: from raw documents to a mixed training corpus, one operator a stage.

All stages take documents with any further columns. Null and empty texts pass through every stage (the classifier judges them like others);
very long texts are treated whole; rows without an id are never held to be copies; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadbook.llm.common import cleared, mark, written
from threadbook.llm.op3_secret_scan import redact
from threadbook.llm.op4_ngram_join import ngram_components
from threadbook.llm.op5_quality import keep_documents
from threadbook.llm.op7_decontaminate import strip_contamination
from threadbook.llm.op8_source_mix import mix_sources, mixed_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects for neither their quality nor toxic text. Repeated rows and null ids are judged each."""
    return keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links join, one row of it; rows without an id stay. Documents without
    words link with nothing and stay.
    """
    others = ngram_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    again = left.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    once = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that benchmark windows hit. Repeated rows stay; without benchmark items no text changes."""
    return strip_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked. Repeated rows stay."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row a document: its size, its source's size and target, the words that the mix takes from it, and the pieces
    of its text that make them up, each with its output shard and block. Repeated rows are documents of their own.
    """
    return mixed_texts(mix_sources(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mixture", mixture)]

#: A trained classifier and hash draws are not expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage has written on the way is deleted once its result is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            cleared(spark, before, keep=1)
    return docs
