"""The training-data pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's ``docs``; all but the last return the columns of documents.

Every stage follows its operator in nulls, empty and very long texts, ties and repeated rows: a null or empty text fails the
quality rules, rows with a null doc_id pass near-dedup and decontamination (no id can be named for them), rows with one
doc_id share one fate in both, an empty table gives an empty result, and columns beside those of documents are carried
through under their own names up to the last stage, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.common import table
from skyloom.llm.decontam import decontaminate
from skyloom.llm.linededup import line_dedup
from skyloom.llm.minhash import near_duplicates
from skyloom.llm.packing import pack
from skyloom.llm.quality import judged
from skyloom.llm.queries import bpe_path, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the divergence rule keep."""
    return judged(docs, *docs.columns).where("judged.kept").select("carried.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated windows of two lines or more; n_chars counts what is left."""
    return line_dedup(docs, counts=False, every=True).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8): its smallest doc_id."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    leaks = decontaminate(docs, read(spark, sf_dir, "benchmark")).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return pack(docs, bpe_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL cannot express the stages (SimHash, BPE, divergence references); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is a table before the next starts."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
