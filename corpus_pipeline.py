"""The corpus pipeline: quality rules, SimHash near-dedup, secret scans, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each result as Parquet and rereads it. The near-dedup
stage links documents whose 5-word shingles have a similarity of 0.8 or more; 64-bit fingerprints can't tell those, so its candidates come from MinHash
bands (see basalt.llm.nearcopies).

Defined cases, of all stages: a null or empty text fails the quality rules, is a near copy of other texts without words, holds no secret, has size 0 in the
mix and packs as one token; null ids and sources are kept; rows that are alike are near copies of each other, else each a document; docs may come from files,
joins, unions or generators; an empty table gives an empty result; other columns are kept, whatever they are called."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from basalt.llm import mixing, nearcopies, packing, quality, secrets
from basalt.llm.store import staged
from basalt.session import ship

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return nearcopies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays."""
    return secrets.redact(docs, secrets.train(spark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as the mix takes them."""
    ship(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("source mixing", source_mix),
    ("best-fit packing", pack),
]

#: A learned model, tokenizers and dynamic programming have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
