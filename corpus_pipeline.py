"""Stages that turn ``documents`` into packed training batches.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.

Defined results
- null, empty and blank texts fail the quality rules and go in the first stage, as do texts of fewer than 50 words.
- null doc_id: kept where its text is; never a duplicate. Null source: a source of its own.
- repeated rows: judged alike by the rules; one stays after near-dedup.
- very long texts are treated whole; packing cuts them into segments.
- empty documents: an empty result of packing's columns. Empty labels: the base rules alone decide, and the secret models are counted from the built-in samples.
- extra columns of documents, whatever their names: dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from tessera.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.judge(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("kept").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.deduplicated(docs).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.redacted(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their targets: documents left out, cut at a source's budget, or repeated."""
    return mixing.mixed(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a segment with its bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", good),
    ("near-dedup", distinct),
    ("secret scans", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL: hashed n-gram scores and Markov models decide what is kept; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}-{name.replace(' ', '-')}")
    return docs
