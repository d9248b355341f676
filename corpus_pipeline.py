"""A corpus from raw documents to packed training sequences.

Five stages, each on all rows that its predecessor kept: the quality
classifier drops what it rejects, exact and near duplicates leave one document
of each group, the mix takes sources in their target shares (a document taken
twice is two rows), and packing cuts everything into sequences.  Each stage's
result is written to the shared folder and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadence.llm import exact_dedup, minhash, mixing, packing, quality
from cadence.llm._common import read_table
from cadence.llm.queries import END_ID, MAX_EPOCHS, SEQUENCE_LENGTH, SOURCE_WEIGHTS, TOKENIZER
from cadence.plans.lineage import cut_lineage
from cadence.session import ship_package


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, SOURCE_WEIGHTS, max_epochs=MAX_EPOCHS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=SEQUENCE_LENGTH, end_id=END_ID)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "table")
    return STAGES[-1][1](spark, docs, sf_dir)


# The classifier and the tokenizer have no SQL form; tests/llm checks the
# pipeline against a brute-force version.
ORACLE_SQL = None
