"""The corpus pipeline: five operators of ``lumenlog.llm`` in a row, each stage's result written and read again.

Quality by the line field, fitted on the labels (rejected documents go); one document of each group of SimHash near
duplicates; repeated passages cut out; sources mixed to their target weights (a document read several times has several
rows); token ids and the text they decode to. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.storage import materialise
from lumenlog.llm import bpe, mixture, passages, quality, simhash


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality field accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "text")
    return quality.classify(marked, quality.fit(docs, labels)).filter("predicted = 1").select("_row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.deduplicate(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each repeated passage of 50 words or more in one document only; what is left of the others."""
    return passages.drop_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions."""
    return mixture.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded) of every document row; ``decoded`` is the text that the ids stand for."""
    coded = bpe.transcode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("passages", cut_passages), ("mix", mix), ("encode", encode)]
#: The stages are a trained model, hashes and a tokenizer: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
