"""From raw documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the ``docs`` of the next one. All but the last return the columns of ``documents``. A row that a
mix takes twice is two rows from there on. Null texts are empty, and stages without any documents give none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridlake.llm.common import read, remainder, stored
from gridlake.llm.decontamination import drop_contaminated
from gridlake.llm.mixing import mix
from gridlake.llm.simhash import drop_near_duplicates
from gridlake.llm.token_files import encode_documents
from gridlake.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is 0.7 or more, learned from two thirds of the labels."""
    model = train(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return drop_toxic(docs, model, 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near fingerprints."""
    return drop_near_duplicates(docs, words=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a twentieth of their words in passages of the benchmark."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents of each source by weights 5, 2, 1, some up to three times."""
    return mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files, and return start, length and checksum of each document in them."""
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

# The stages learn a model, hash with XXH64 and encode tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
