"""Pair counts of a growing corpus: a stateful stream that gives out the counts that change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairs import pair_counts
from ..plans.heap import PairTable
from ..sources.corpus import to_sequences


def pair_count_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str | None = "NFC") -> DataFrame:
    """(a, b, cnt) of a stream of texts, for output mode ``update``: each micro-batch gives the new counts of the pairs it holds.  What a
    batch shuffles and the state keeps are numbers for distinct pairs, never texts."""
    return pair_counts(to_sequences(docs, id_col, text_col, form))


def follow(counts: DataFrame, folder: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] = lambda rows, k: None) -> StreamingQuery:
    """Writes every batch's changed counts to a folder of its own, so that a batch that runs again after a restart writes the
    same rows in the same place; ``on_batch`` gets the rows too.  Runs until the source has nothing new."""

    def write(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={k}")
        on_batch(rows.sparkSession.read.parquet(f"{folder}/batch={k}"), k)

    sink = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return sink.trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(a, b, cnt) after all batches: the last count that each pair had."""
    rows = spark.read.schema("a int, b int, cnt long, batch long").parquet(folder)
    return rows.groupBy("a", "b").agg(F.max_by("cnt", "batch").alias("cnt"))


def into_table(table: PairTable) -> Callable[[DataFrame, int], None]:
    """For ``follow``: brings a pair table and its heap up to date with each batch's changes."""

    def push(rows: DataFrame, k: int) -> None:
        changed = [(r["a"], r["b"], r["cnt"]) for r in rows.toArrow().to_pylist()]  # distinct pairs of a batch
        table.push_changed([(a, b, n - int(table.count[table.index[a, b]]) if (a, b) in table.index else n) for a, b, n in changed])

    return push
