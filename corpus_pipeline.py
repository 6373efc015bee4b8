"""Documents to packed training sequences: toxicity filter, near-dedup, suffix-array dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraloc.llm.common import discard, save, tune
from terraloc.llm.packing import pack
from terraloc.llm.simhash import near_dedup
from terraloc.llm.suffixes import dedup
from terraloc.llm.toxicity import filter_toxic, train


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model scores as toxic go. The labels of held-out documents aren't learnt."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_toxic(docs, train(docs, labels))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies stays; near copies are texts whose fingerprints over four words link, as the operator's contract has it."""
    return near_dedup(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller doc_id has too are cut out."""
    return dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences that they are packed into."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("packing", packing_stage),
]
#: SQL has neither the trained scores nor the fingerprints of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table goes when the next one is written."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        kept = save(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
