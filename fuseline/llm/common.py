"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, small_batches

__all__ = ["ascii_lower", "checkpointed", "fresh_name", "joined_back", "maybe_among", "raw_hash", "shared_folder", "small_batches", "table", "without"]

#: Rows of narrow keys up to which a side is broadcast (about 16 bytes each).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    ``lower`` has a fast path for pure ASCII strings, where both agree; other strings go through
    ``translate``, which leaves every non-ASCII letter alone.
    """
    only_ascii = F.octet_length(col) == F.char_length(col)
    return F.when(only_ascii, F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )


def raw_hash(text_col: str) -> Column:
    """A 64-bit hash of a text as it stands (null as the empty text), which with the row's id names the row."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fresh_name(taken: Iterable[str], wish: str) -> str:
    """``wish``, with underscores added until no column of that name (in any case) exists."""
    used = {c.lower() for c in taken}
    while wish.lower() in used:
        wish += "_"
    return wish


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and cuts its lineage, so that a lost executor costs a re-read and not a
    recomputation of everything above."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def flagged(rows: DataFrame, key: Column, wanted: DataFrame, n: int, flag: str) -> DataFrame:
    """``rows`` with a boolean column ``flag``: whether the 64-bit ``key`` may be among the ``n`` values of ``wanted`` (one
    column of longs).  It is true for all that are, and for about one in sixteen of the others.

    A bit map of 16 bits a value is broadcast, from 128 KB to 32 MB.  Beyond 16 million values it fills up and
    tells fewer rows apart; none that is wanted is ever missed.
    """
    bits = 1 << min(28, max(20, (16 * max(n, 1) - 1).bit_length()))
    bucket, bit, plane = (fresh_name([*rows.columns, flag], c) for c in ("bucket_", "bit_", "plane_"))

    def place(value: Column) -> list[Column]:
        at = F.pmod(value, F.lit(bits).cast("long"))
        return [F.shiftright(at, 15).alias(bucket), at.bitwiseAND(F.lit(32767)).alias(bit)]

    planes = wanted.select(*place(F.col(wanted.columns[0]))).groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias(plane))
    held = rows.select("*", *place(key)).join(F.broadcast(planes), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring({plane}, cast(shiftright({bit}, 3) as int) + 1, 1)")), 16, 10).cast("int")
    mask = F.expr(f"shiftleft(1, cast({bit} & 7 as int))")
    found = F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))
    return held.select(*[F.col(f"`{c}`") for c in rows.columns], found.alias(flag))


def maybe_among(rows: DataFrame, key: Column, wanted: DataFrame, n: int) -> DataFrame:
    """The rows that ``flagged`` tells to be wanted."""
    flag = fresh_name(rows.columns, "wanted_")
    return flagged(rows, key, wanted, n, flag).filter(flag).drop(flag)


def without(rows: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    """The rows whose id and raw hash are not in ``gone`` (``id``, ``raw``), with their columns as they were.

    Up to ``BROADCAST_ROWS`` rows of ``gone`` are broadcast, and no text is shuffled.  Beyond, texts that a bit map shows
    to stay pass where they are, and only the others meet ``gone`` in a shuffle.
    """
    n = gone.count()
    if not n:
        return rows

    def anti(left: DataFrame, right: DataFrame) -> DataFrame:
        d, g = left.alias("d"), right.alias("g")
        return d.join(g, F.col(f"d.`{id_col}`").eqNullSafe(F.col("g.id")) & (raw_hash(f"d.`{text_col}`") == F.col("g.raw")), "left_anti")

    if n <= BROADCAST_ROWS:
        return anti(rows, F.broadcast(gone))
    flag = fresh_name(rows.columns, "suspect_")
    marked = flagged(rows, F.xxhash64(F.col(id_col), raw_hash(text_col)), gone.select(F.xxhash64("id", "raw").alias("key")), n, flag)
    suspects = marked.filter(flag).drop(flag)
    return marked.filter(~F.col(flag)).drop(flag).unionByName(anti(suspects, gone.hint("shuffle_hash")))


def joined_back(rows: DataFrame, totals: DataFrame, keys: list[str], times: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with the columns of ``totals``, which has one row for every combination of ``keys`` in them and, as ``times``, in
    how many rows (or how often) it occurs; read several times, so written down before.

    Up to ``most`` totals (counted) are broadcast.  Of more, those that occur most are broadcast, as many as fit, and only
    rows of the others meet their total in a shuffle; none of those can be hot, as ``most`` / 2 others are as frequent."""
    level = F.floor(F.log2(times)).cast("int")
    levels = totals.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # 64 rows at most
    held, least = 0, 64
    for k, n in sorted(((r["level"], r["n"]) for r in levels), reverse=True):
        if held + n > most:
            break
        held, least = held + n, k
    if held == sum(r["n"] for r in levels):
        return rows.join(F.broadcast(totals), keys)
    tried = rows.join(F.broadcast(totals.filter(level >= least)), keys, "left")
    rest = tried.filter(F.col(times).isNull()).select(*rows.columns).join(totals.filter(level < least), keys)
    return tried.filter(F.col(times).isNotNull()).unionByName(rest)
