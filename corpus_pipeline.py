"""A training corpus in five stages: quality, rules, near-duplicates, decontamination, packing.

Each stage takes what its predecessor kept, as a written table, and all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontam, gam, packing, rules, simhash
from mnemospark.llm.common import written
from mnemospark.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier scores 0.3 or more."""
    return gam.good(docs, table(spark, sf_dir, "labels"), least=0.3)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that fail none of the rules."""
    return rules.kept(docs, rules.STRICT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked at 0.8 or more over five-word shingles."""
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold less than half of every benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences of at most 2048 ids."""
    out = packing.pack(docs, tokenizer_path(), size=2048, end_id=0)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: No SQL for the learned, iterative and tokenizer stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
