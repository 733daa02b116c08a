"""The corpus pipeline: documents -> token ids, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs.  All stages but the last return the columns of ``documents``.

1. quality rules: documents that a rule rejects go.
2. SimHash near-dedup: one document of each component stays, the least doc_id.
3. benchmark decontamination: documents in which an item's coverage reaches the
   threshold go.
4. PII: entities are replaced by surrogates (``n_chars`` follows the text).
5. byte-level BPE: doc_id, n_tokens, ids_sha256, decoded_sha256, valid_utf8.

A token encoding cannot be stated in SQL, so ``ORACLE_SQL`` is None and the
tests hold the pipeline against brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from haulspark.llm import bpe, pii, quality, simhash, tiling
from haulspark.llm.queries import KEY, RANKS, read
from haulspark.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, KEY)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii_surrogates", pii_surrogates),
    ("bpe_codec", bpe_codec),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
