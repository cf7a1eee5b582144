"""A corpus from raw documents to token ids: rules, near duplicates, repeated passages, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from seriesmill.llm import bpe, mixing, near_copies, quality_rules, repeats  # noqa: E402
from seriesmill.llm.common import read, settle  # noqa: E402

MIX_SEED = 17


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go."""
    return quality_rules.kept_rows(docs, quality_rules.STANDARD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a likeness of 0.8 or more."""
    return near_copies.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 or more that occur earlier are cut out of the texts."""
    return repeats.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows that are not taken go, rows taken twice come twice."""
    return mixing.mix(docs, mixing.cuts(docs, seed=MIX_SEED), seed=MIX_SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", rules), ("simhash_dedup", near_duplicates), ("suffix_array_dedup", passages), ("mixing", mixture),
    ("bpe", tokens),
]
ORACLE_SQL = None  # near duplicates and token ids cannot be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
