"""Compression of vectors to short codes: product codebooks by delta-maintained Lloyd rounds, in exact integers.

Every component becomes floor(scale x); vectors are cut into equal consecutive parts, and each part position has a codebook
of ``entries`` entries, which starts as that part of the vectors with the smallest ids.  A round assigns every part to
its codebook's nearest entry (squared distance, ties to the lower index) and moves each entry to the componentwise
floor of its parts' mean; an entry that no part chose stays.

Delta maintenance.  The table of parts with their last assignments is persisted (written to the shared folder, the
one before removed once it has been read), and the driver keeps running sums and counts of every entry: ``parts`` x
``entries`` rows, whatever the number of vectors.  A round compares new with old assignments; only parts whose entry
changed contribute, minus for the old and plus for the new one, summed in each task before the shuffle.  In later
rounds few parts change, and what is shuffled dwindles with them.  Integer sums are exact, so the result is that of full
recounts, and does not depend on the partitioning or on tasks that run twice.

Odd input: vectors that are null or hold a null or non-finite component are dropped, and so are those whose length is not
that of the vector with the smallest id (null ids come last; equal ids go by components).  A length that ``parts`` does not divide is
cut as evenly as possible.  Of fewer than ``entries`` vectors all start an entry.  Repeated rows are vectors of their own.  An
empty table gives no rows and empty codebooks.  Components beyond ``LIMIT`` in integers raise an error, as their squares would
not be exact.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, scratch
from .common import BROADCAST_ROWS, checkpointed, joined_back

LIMIT = 1 << 26
#: Vectors that a worker compares with the codebooks at a time.
PORTION = 4096


@dataclass(frozen=True)
class Codebooks:
    """``entries[p]``: entries x components of part position p, as integers; ``moved``: parts that changed their entry in
    each round, the first assignment included."""

    entries: tuple[np.ndarray, ...]
    moved: tuple[int, ...] = ()

    @property
    def sha256(self) -> str:
        numbers = (str(x) for part in self.entries for entry in part.tolist() for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def cuts(size: int, parts: int) -> list[int]:
    return [k * size // parts for k in range(parts + 1)]


def nearest(values: np.ndarray, books: Codebooks, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (n x parts) and its squared distance."""
    codes = np.zeros((len(values), len(books.entries)), np.int64)
    far = np.zeros_like(codes)
    for p, book in enumerate(books.entries):
        own = values[:, at[p] : at[p + 1]]
        d = np.stack([((own - entry) ** 2).sum(axis=1) for entry in book], axis=1)
        codes[:, p] = d.argmin(axis=1)  # the first of equal ones
        far[:, p] = np.take_along_axis(d, codes[:, p : p + 1], axis=1)[:, 0]
    return codes, far


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v): components as integers, of vectors without null or non-finite components."""
    v = F.col(vec_col)
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    whole = lambda x: F.floor(x.cast("double") * scale)
    checked = lambda x: F.when(F.abs(x.cast("double")) * scale < LIMIT, whole(x)).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more")).cast("long")
    )
    return vectors.filter(sound).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, checked).cast("array<int>").alias("v")
    )


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(np.int64)


def _round(state: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """``state`` (id, label, v, code) with its parts assigned anew: ``code`` and, as ``old``, what it was."""
    at = cuts(size, len(books.entries))

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, PORTION):
                batch = whole.slice(k, PORTION)
                codes, _ = nearest(_matrix(batch.column(2), size), books, at)
                new = pa.array([c.tobytes() for c in codes.astype("<u2")], pa.binary())
                yield pa.record_batch([*batch.columns, new], names=[*batch.schema.names[:3], "old", "code"])

    types = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    return state.select("id", "label", "v", "code").mapInArrow(
        assigned, f"id {types['id']}, label {types['label']}, v array<int>, old binary, code binary"
    )


def _changes(state: DataFrame, parts: int, size: int) -> DataFrame:
    """(part, entry, n, total): what the parts whose entry changed take from their old entry and add to their new one."""
    at = cuts(size, parts)
    width = max(y - x for x, y in zip(at, at[1:], strict=False))

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}  # parts x entries at most
        for whole in batches:
            for k in range(0, whole.num_rows, PORTION):
                batch = whole.slice(k, PORTION)
                v = _matrix(batch.column(0), size)
                new = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, parts).astype(np.int64)
                old = np.stack(
                    [np.full(parts, -1) if c is None else np.frombuffer(c, "<u2").astype(np.int64) for c in batch.column(1).to_pylist()]
                )
                for p in range(parts):
                    rows = np.flatnonzero(old[:, p] != new[:, p])
                    own = v[rows, at[p] : at[p + 1]]
                    for sign, entry in ((-1, old[rows, p]), (1, new[rows, p])):
                        for e in np.unique(entry[entry >= 0]).tolist():
                            add = np.zeros(width + 2, np.int64)
                            chosen = entry == e
                            add[0] = sign * chosen.sum()
                            add[1] = chosen.sum() if sign > 0 else 0
                            add[2 : 2 + own.shape[1]] = sign * own[chosen].sum(axis=0)
                            sums[p, e] = sums.get((p, e), 0) + add
        if sums:
            keys, values = zip(*sorted(sums.items()), strict=True)
            yield pa.record_batch(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([x.tolist() for x in values])],
                names=["part", "entry", "add"],
            )

    rows = state.select("v", "old", "code").mapInArrow(summed, "part int, entry int, add array<long>")
    return rows.groupBy("part", "entry").agg(*[F.sum(F.col("add")[k]).alias(f"c{k}") for k in range(width + 2)])


def learn(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks]:
    """The state after ``rounds`` rounds (id, label, v, old, code of the last one) and the codebooks; ``vectors`` is (id, label, v) of
    integers."""
    spark = vectors.sparkSession
    folder = scratch(spark, "codebooks")
    smallest = lambda rows: rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    seeds = smallest(vectors)
    if not seeds:
        return vectors.select("*", F.lit(None).cast("binary").alias("code")), Codebooks(())
    size = len(seeds[0]["v"])
    at = cuts(size, parts)
    if any(len(r["v"]) != size for r in seeds):
        seeds = smallest(vectors.filter(F.size("v") == size))
    first = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), size)
    books = Codebooks(tuple(first[:, x:y] for x, y in zip(at, at[1:], strict=False)))
    sums = [np.zeros((len(first), y - x), np.int64) for x, y in zip(at, at[1:], strict=False)]
    counts = np.zeros((parts, len(first)), np.int64)

    state = vectors.filter(F.size("v") == size).withColumn("code", F.lit(None).cast("binary"))
    moved: list[int] = []
    for k in range(rounds):
        path = f"{folder}/{k}"
        _round(state, books, size).write.parquet(path)
        state = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}")
        plus = 0
        for r in _changes(state, parts, size).collect():  # parts x entries rows
            p, e, (n, entered, *total) = r["part"], r["entry"], r[2:]
            counts[p, e] += n
            plus += entered
            sums[p][e] += np.array(total[: sums[p].shape[1]], np.int64)
        moved.append(plus)
        books = Codebooks(
            tuple(np.where(counts[p][:, None] > 0, sums[p] // np.maximum(counts[p][:, None], 1), book) for p, book in enumerate(books.entries)),
            tuple(moved),
        )
        if not plus:  # nothing moved, so no later round would move anything
            break
    return state, books


def encode_vectors(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): indexes in part order, two hex digits each, and the squared distances summed over the parts.
    ``vectors`` is (id, label, v) of the codebooks' length."""
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = f"id {types['id']}, label {types['label']}, code string, error long"
    if not books.entries:
        return vectors.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    widths = [b.shape[1] for b in books.entries]
    at = [0, *np.cumsum(widths).tolist()]

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, PORTION):
                batch = whole.slice(k, PORTION)
                codes, far = nearest(_matrix(batch.column(2), at[-1]), books, at)
                text = pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)])
                yield pa.record_batch([batch.column(0), batch.column(1), text, pa.array(far.sum(axis=1))], names=["id", "label", "code", "error"])

    return vectors.filter(F.size("v") == at[-1]).select("id", "label", "v").mapInArrow(coded, schema)


def with_label_sums(coded: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``coded`` (id, label, code, error) with ``label_error``, the error summed over equal labels, nulls together."""
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("."), F.col("label").cast("string")), F.lit("")))
    sums = checkpointed(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("times")))
    return joined_back(keyed, sums, ["key"], "times", most).drop("key", "times")


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors and the codebooks they refer to: (id, label, code, error, label_error)."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256, two hex digits")
    state, books = learn(integer_vectors(vectors, id_col, vec_col, label_col, scale), parts, entries, rounds)
    return with_label_sums(encode_vectors(state.select("id", "label", "v"), books)), books
