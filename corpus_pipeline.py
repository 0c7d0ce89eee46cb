"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Junk goes, passages that earlier documents have are cut, one document of each
group of near-duplicates stays, sources are mixed to their weights, and the mix
is encoded. Each stage works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from nestfold.llm import bpe
from nestfold.llm.line_dedup import drop_repeats
from nestfold.llm.minhash import keep_one
from nestfold.llm.mixing import mix
from nestfold.llm.quality_rules import keep_good
from nestfold.sources.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of 50 words or more that an earlier document has are cut; documents with nothing left go."""
    return drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a similarity of 0.8 or more on 5-word shingles, the first stays."""
    return keep_one(docs, size=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn and repeated so that sources come near their weights."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every drawn document, and a check that they decode to its text."""
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    both = bpe.decode(bpe.encode(docs, ranks), ranks)
    return both.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", source_mix),
    ("encoding", encoding),
]
#: The splitting tree draws at random and the encoder merges bytes: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
