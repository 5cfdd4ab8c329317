"""The training-data pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every
stage's rows to the shared folder as Parquet and rereads them as the next one's
docs, so a lost executor costs at most the stage at work.  All stages but the last
return the columns of documents.

The near-duplicate stage takes five-word shingles and a similarity of 0.8.  What
mixing repeats is packed once per copy.  Packed ids are 2-byte little-endian.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from domloom.llm import minhash, mixing, packing, pii, toxicity
from domloom.llm.common import documents, shared_folder, stage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by their language's threshold go."""
    return toxicity.drop_toxic(docs, toxicity.training_labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until the sources reach their targets."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces with their token ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: A classifier trained in numpy and a tokenizer stand in the way of SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), shared_folder(spark)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", folder)
    return STAGES[-1][1](spark, docs, sf_dir)
