"""A corpus through five stages: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the docs
of the next one.  All but the last return the columns of documents.  They share executors with the workers that the
stages before left, so texts pass in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treelift.llm.decontamination import drop_contaminated
from treelift.llm.line_dedup import drop_repeated_lines
from treelift.llm.near_dedup import drop_near_duplicates
from treelift.llm.packing import pack_documents
from treelift.llm.toxicity import drop_toxic
from treelift.sources.scratch import Scratch
from treelift.sources.shipping import ship
from treelift.sources.tables import in_small_batches, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that nearest labelled examples don't predict to be toxic."""
    in_small_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; one that loses all its text goes, n_chars follows the text."""
    in_small_batches(spark)
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    in_small_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item occur."""
    in_small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in pieces, packed into sequences."""
    in_small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Token ids, line windows and votes aren't SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
