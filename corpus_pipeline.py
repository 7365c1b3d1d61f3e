"""A training corpus in five stages, each a table that the next one reads.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the rows that go
on with the columns of documents; the last returns the packed pieces.

Cases: rows of a null or empty text pass the toxicity model by its bias alone, are exact copies
of each other, have no near copies, and give a piece of length 0. Rows of null doc_id are never
trained on, come last in the choice of an exact copy that stays, are no near copies, and are
mixed and packed like others. Rows that are repeated leave one. Ties are settled as the operators
say. Very long texts are handled whole. Other columns go through all stages but the last,
whatever their names. An empty table gives empty tables; without labels no row is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import exact_dedup, minhash, mixing, packing, toxicity
from vellum.llm.queries import MIX_MOST, MIX_SHARE, MIX_WEIGHTS, mix_propensity
from vellum.llm.scratch import Scratch

#: 100 * intersection over union of five-word shingles from which two documents are near copies.
NEAR_SIMILARITY = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near(docs, NEAR_SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, MIX_WEIGHTS, MIX_SHARE, MIX_MOST, propensity=mix_propensity())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a packing heuristic have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
