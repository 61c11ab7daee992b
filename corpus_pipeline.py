"""The document pipeline: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows to the shared folder and reads them again as the next one's docs. Rows without a doc_id are judged as rows like others;
an empty table gives an empty result at every stage. Extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import free_names, table, written
from corpusloom.llm.decontaminate import drop_contaminated
from corpusloom.llm.lines import dedup_lines
from corpusloom.llm.neardup import drop_near_duplicates
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import filter_documents


#: Least similarity of near duplicates in hundredths.
SHARE = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return filter_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those of which nothing but white space is left go."""
    counts = free_names(docs, "_lines", "_removed")
    kept = dedup_lines(docs, counts=tuple(counts)).where((F.col(counts[1]) == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    return kept.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by the general rule; op10's own contract has 85."""
    return drop_near_duplicates(docs, share=SHARE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Thresholds by exact binomial tails, near-duplicate components and tokenizers are beyond SQL; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
