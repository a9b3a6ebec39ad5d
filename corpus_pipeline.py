"""Corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of ``docs``.  ``run`` writes every stage's rows as Parquet to the shared folder and reads them again; the last
stage's rows stay there, those of the others are removed when the next stage is written.

Odd input: null, empty and letterless texts go in the first stage; rows without an id are kept as their texts are (of equal
texts, one); of rows that repeat an id and a text one is kept, and rows that share an id only are documents of their
own; texts of any length are read whole; columns of any name pass through all stages but the last; an empty
``documents`` or ``benchmark`` table gives no rows, or nothing to remove.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fuseline.llm import common
from fuseline.llm.decontaminate import drop_contaminated
from fuseline.llm.exact_dedup import drop_exact_copies
from fuseline.llm.langid import drop_unidentified
from fuseline.llm.packing import pack_documents
from fuseline.llm.simhash import drop_near_copies
from fuseline.sources.shared import remove


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go: null texts, texts without a letter, and texts of whose n-grams no
    language has a tenth."""
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id stays."""
    return drop_exact_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts linked by a 5-word-shingle similarity of 0.8 or more, the row with the smallest doc_id
    stays."""
    return drop_near_copies(docs, similarity=0.8, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left and their places in the sequences."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL expresses neither the n-gram filters nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before is not None:
            remove(spark, before)  # what a stage has read is not needed any more
        before = at
    return docs
