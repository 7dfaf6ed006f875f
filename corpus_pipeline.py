"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

All stages but the last return the columns of documents and pass other columns through, whatever their names. Every stage
works on whole texts, however long, and gives an empty table for an empty one. A row without doc_id passes the stages
that compare documents with one another, since it has no place among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitlake.llm.common import shared_dir
from pitlake.llm.decontam import decontaminated
from pitlake.llm.jaccard import one_of_each
from pitlake.llm.linededup import without_repeated_lines
from pitlake.llm.packing import pack
from pitlake.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the fences of their language and source go, and those that break the base rules.

A null text has no words and so goes; null languages and sources form groups; repeated rows are judged alike; a value on
a fence stays."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id has go; a document that loses lines and is left without a word goes.

A null text stays null. Rows that share a doc_id count as one document and keep their common lines; exact copies under
other ids lose all their lines of ten characters or more."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the smallest id stays.

Rows that agree in doc_id and text are one document and leave one row. Texts that share a doc_id are judged apart: each
component keeps one. Null and wordless texts link with nothing and stay."""
    return one_of_each(docs, words=5, num=8, den=10)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null texts, and all documents where the benchmark has no words, stay; repeated rows are judged alike."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token sequences and their places. A null text is its end token alone; repeated rows are packed each; of equal fits the latest sequence is taken."""
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark), ("best-fit packing", packing)]

#: Quantile fences, links and packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what they write lies below spark.checkpoint.dir until the session ends."""
    docs, home = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/stage-{k}")
        docs = spark.read.parquet(f"{home}/stage-{k}")
    return docs
