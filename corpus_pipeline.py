"""A corpus from raw documents to packed token sequences, stage by stage.

Each stage takes the documents that the one before kept and returns documents of the same
columns; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import mixing, near_dedup, packing, pii, quality
from varloom.llm.common import documents, materialize, scope
from varloom.llm.subwords import vocabulary_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return quality.keep_good(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    gone = near_dedup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with identifiers replaced by their kind."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as their source's target takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a smaller cache, as workers still hold what earlier stages loaded."""
    return packing.pack_documents(docs, vocabulary_path("byte_bpe_50k.json"), cache_units=150_000)


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Hash draws, trained weights and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scope(spark):  # what a stage wrote for itself goes once its result is written
            docs = materialize(stage(spark, docs, sf_dir), name, outside=True)
    return STAGES[-1][1](spark, docs, sf_dir)
