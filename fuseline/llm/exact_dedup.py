"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups.

Two documents are equal when their texts are identical after lower-casing A-Z; a null text counts as empty.

Plan.  The texts are read once for digests: a narrow row (id, hash of the text as it stands, 128-bit hash, SHA-256, row
number) is written for each document, and grouping goes over those.  A class of one row needs nothing else.  For classes
of several, the texts are read again, and only those whose hash is among them (a bit map of bounded size tells) are
grouped by (128-bit hash, normalised text): the text is part of that key, so the aggregate itself compares bytes, and
its map-side half collapses the copies that a task holds, hence a class that holds a third of all rows sends one row
per task.  Each class is then told to its salts (at most ``SALTS`` rows each) and the members meet it by digests and
salt, so a hot class is spread over that many tasks.

Defined results for odd input:

* null text: the empty text; null id: a member like any other, never the one that stays unless its class has no id;
* rows repeated with the same id and text: each is returned and counted, one of them is ``kept``;
* one id with different texts: the rows belong to their texts' classes;
* empty table: no rows; additional columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, maybe_among, raw_hash, without

#: Parts into which the members of each class are dealt.
SALTS = 128


def _md5(col: Column) -> Column:
    return F.unhex(F.md5(col))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    hash128=_md5,
) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``raw`` (a 64-bit
    hash of the text as it stands, which with the id names the row).

    ``keep`` is ``"max"`` or ``"min"``: which id of a class stays; of rows that share that id, the one with the smallest
    ``raw``, and of those any one.  ``hash128`` maps a text column to its hash.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    texts = docs.select(
        F.col(id_col).alias("id"),
        raw_hash(text_col).alias("raw"),
        ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"),
    ).withColumn("h128", hash128(F.col("norm")))
    rows = checkpointed(
        texts.select("id", "raw", "h128", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    )
    # A null id is never the one that stays unless its class has no other.
    none = F.col("id").isNull()
    last = F.max(F.struct("id", F.bitwise_not("raw").alias("raw"), (-F.col("row")).alias("row")))
    first = F.min(F.struct(none.alias("none"), "id", "raw", "row"))
    found = rows.groupBy("h128", "sha").agg(F.count(F.lit(1)).alias("group_size"), (last if keep == "max" else first).alias("best"))
    several = checkpointed(
        found.filter("group_size > 1").select("h128", "sha", "group_size", F.col("best.id").alias("keep_id"), F.abs("best.row").alias("keep_row"))
    )
    again = maybe_among(texts, F.xxhash64("h128"), several.select(F.xxhash64("h128").alias("key")), several.count())
    by_bytes = again.groupBy("h128", "norm").agg(F.count(F.lit(1)).alias("n"))
    compared = (
        by_bytes.select("h128", F.unhex(F.sha2("norm", 256)).alias("sha"), "n")
        .groupBy("h128", "sha")
        .agg(F.max("n").alias("same"), F.count(F.lit(1)).alias("texts"))
    )
    # The bytes decide; membership goes by both digests, which must therefore name one text of as many rows.
    one = (F.col("texts") == 1) & (F.col("same") == F.col("group_size"))
    sure = F.when(one, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long"))
    classes = several.join(compared, ["h128", "sha"]).select("h128", "sha", "keep_id", "keep_row", sure.alias("group_size"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    told = salted.select("h128", "sha", "salt").distinct().join(classes, ["h128", "sha"])
    return salted.join(told, ["h128", "sha", "salt"], "left").select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_row", F.col("row")) == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "raw",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were."""
    rows = exact_groups(docs, id_col, text_col, keep).groupBy("id", "raw")
    odd = checkpointed(
        rows.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1")
    )
    out = without(docs, id_col, text_col, odd.filter("not stays").select("id", "raw"))
    twice = odd.filter("stays").select("id", "raw")
    if twice.isEmpty():
        return out
    # Rows that repeat both id and text: one of each is left.
    t = twice.alias("t")
    o = out.alias("o")
    same = F.col(f"o.`{id_col}`").eqNullSafe(F.col("t.id")) & (raw_hash(f"o.`{text_col}`") == F.col("t.raw"))
    repeated = o.join(t, same, "left_semi").dropDuplicates([id_col, text_col])
    return without(out, id_col, text_col, twice).unionByName(repeated)
