"""From raw documents to packed training sequences: quality rules, near-dedup, secrets, source mixing, packing.

Each stage reads what the one before wrote. Quality rules drop documents, near-dedup keeps one of each class, secrets are
masked in the texts, the mix repeats or drops documents, and packing returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.base import materialise, table
from corvane.llm.mixing import take_copies
from corvane.llm.neardup import keep_one
from corvane.llm.packing import pack, token_pieces
from corvane.llm.quality import keep_good
from corvane.llm.secrets import mask_secrets
from corvane.llm.tokens import vocabulary_path


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(token_pieces(docs, vocabulary_path()))


STAGES = [
    ("quality rules", keep_good),
    ("near-dedup", keep_one),
    ("secret scans", mask_secrets),
    ("source mixing", take_copies),
    ("packing", pack_documents),
]

#: Hashes, Newton's iterations and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
