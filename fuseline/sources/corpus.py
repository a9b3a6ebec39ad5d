"""Corpora: any Spark source becomes (doc_id, text), then (doc_id, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_seq, bytes_to_seq, normalize_bytes
from .shared import is_folder


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder of tables as a stream of its files; the table is one file or a folder of files."""
    path, rows = f"{folder}/{name}.parquet", spark.readStream.schema(read_table(spark, folder, name).schema)
    if is_folder(spark, path):
        return rows.parquet(path)
    return rows.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # streams read folders only


def read_corpus(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    id_col: str | None = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """(doc_id, text) from Parquet, ORC, CSV, JSON lines or plain text files (``fmt="text"``: a document per line;
    with ``wholetext=True`` one per file).  Without an id column, ids follow from the text itself."""
    df = spark.read.format(fmt).options(**options).load(path)
    column = "value" if fmt == "text" else text_col
    doc_id = F.col(id_col) if id_col and id_col in df.columns else F.xxhash64(column)
    return df.select(doc_id.alias("doc_id"), F.col(column).cast("string").alias("text"))


def from_bytes(spark: SparkSession, corpus: bytes, form: str = "NFC") -> DataFrame:
    """A corpus of one contiguous sequence, as (doc_id, seq)."""
    rows = spark.createDataFrame([(0, bytearray(corpus))], "doc_id long, bytes binary")
    return rows.select("doc_id", bytes_to_seq(normalize_bytes(F.col("bytes"), form)).alias("seq"))


def to_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str | None = "NFC") -> DataFrame:
    """(doc_id, seq) of a text table; a null text has no sequence and stays null."""
    return docs.select(F.col(id_col).alias("doc_id"), base_seq(F.col(text_col), form).alias("seq"))
