"""A corpus from raw documents to packed windows: STAGES in order, each written as Parquet and reread by the next.

Defined cases, for every stage: a null or empty text has no words, so the first stage drops it; after it, a text that a later
stage empties stays a document. A text of any length is worked on whole. A null source is one host. Rows that share a doc_id are
one document for near copies and stay or go together; repeated rows are each kept; null doc_ids are one document (-2**63
counts as null). Ties: of near copies the smallest doc_id stays, of a shared line the largest doc_id keeps it. Extra columns pass
through all stages but the last under their names, whatever these are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import line_dedup, minhash, packing, quality_rules, secret_scan
from attesta.llm.common import scope, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules or their host's verdict reject."""
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share; every document stays."""
    return line_dedup.rewrite(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies, at the operator's own defaults: five-word shingles, a similarity of 0.8 or more."""
    return minhash.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; every document stays."""
    return secret_scan.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes and packs what is left."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_dedup", near_copy_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage wrote goes when the next has read it, the last one's output when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark, keep=(STAGES[-1][0],)):
        for name, stage in STAGES:
            with scope(spark, keep=(name,)):
                docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: Token ids have no SQL; tests hold the result against a plain version.
ORACLE_SQL = None
