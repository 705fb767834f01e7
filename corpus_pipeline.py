"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsmith.llm import bpe, decontaminate, ngram_join, quality, secrets
from oddsmith.llm.common import cut, read, small
from oddsmith.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the learned rules reject go, empty and null texts among them; null ids and
    repeated rows are decided like others. Columns stay as they are, whatever their names."""
    return quality.quality_rules(docs, read(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join, the document of least doc_id stays, with all its rows. Documents
    without words or without id belong to no group and stay."""
    others = cut(ngram_join.ngram_jaccard_join(docs, count_links=False).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(small(others), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id; rows without id are not searched and stay."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, null texts as they are."""
    return secrets.redact(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of token counts and digests for each row that is left; a null text counts as empty."""
    return bpe.encode(docs, vocabulary(), digest=True)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("BPE encoding and decoding", token_stage),
]

# No SQL: learned rules, components and a tokenizer are not expressible; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
