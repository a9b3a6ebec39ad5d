"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints.  A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are three words joined by a space
(repeats count; fewer words: the whole sequence as one shingle; no words or a null text: fingerprint zero).  Bit i
of the fingerprint is set when over half of the shingles' XXH64 values (seed 42) have it.

Links.  Two fingerprints link when they differ in at most ``radius`` bits.  The 64 bits are cut into ``blocks``
pieces; a pair within the radius agrees on at least ``blocks - radius`` of them, so comparing only inside buckets
that agree on such a choice of pieces loses no pair.  More pieces mean narrower buckets at the price of more copies;
``blocks=None`` takes the number from the count of distinct fingerprints, which changes the cost, never the result.

Comparison inside buckets is vertical: the fingerprints of a run of buckets lie as 64 bit planes, one bit per
fingerprint.  A plane xor the same plane shifted by k positions gives that bit's difference for every pair (i, i+k)
at once; carry-save counters add the planes up, and a block of shifts is abandoned as soon as every counter has
passed the radius.

With ``similarity`` set, texts link by the Jaccard similarity of their shingle sets instead, and ``radius`` only screens
the pairs; ``similar`` has how candidates are found at such wide radii.

Skew.  Copies collapse to distinct fingerprints before anything is compared.  A bucket larger than ``tile`` is cut
into hashed chunks, and each pair of chunks is a task's worth of its own, so that no bucket is too large and none is
left out.  Out of a bucket come the edges of a spanning forest, at most one per fingerprint, never all its pairs.

Components come from alternating large-star and small-star steps on DataFrames, checkpointed each round; nothing but
two numbers per round reaches the driver.  The joins of these steps carry pairs of numbers only; a node with very many
neighbours is left to the skew join of adaptive execution.

Odd input: null or empty text has fingerprint zero; rows without an id are linked, but give no component its name
(the component is null if none of its rows has an id); repeated rows are returned as often as they occur; an empty table gives no rows; additional
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, raw_hash, small_batches, without
from .similar import SEED, majority, prints_of, words_of
from .similar import links as similar_links

#: Parts into which the rows of each fingerprint are dealt.
SALTS = 64

def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    line = words_of(text)
    if not line:
        return 0
    digest = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(gaps) < size:
        return digest(line, SEED)
    starts = [0, *(gaps[: len(gaps) + 1 - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(line)]
    hashes = np.array([digest(line[i:j], SEED) for i, j in zip(starts, ends, strict=True)], np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id``, ``raw`` (a 64-bit hash of the text as it stands) and ``fp`` (the fingerprint's 64 bits as a long), one
    row per input row."""

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), size) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return small_batches(docs).select(F.col(id_col).alias("id"), raw_hash(text_col).alias("raw"), of(F.col(text_col).cast("string")).alias("fp"))


# ---------------------------------------------------------------------------------------------- bit planes


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit i of row p is bit p of values[i]."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    words = -(-len(values) // 64)
    packed = np.zeros((64, words * 8), np.uint8)
    packed[:, : -(-len(values) // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return packed.view(np.uint64)


def _shifted(words: np.ndarray, shifts: np.ndarray, width: int) -> np.ndarray:
    """Row s: the bit vector moved down by shifts[s]."""
    padded = np.concatenate([words, np.zeros(int(shifts[-1]) // 64 + 2, np.uint64)])
    at = np.arange(width)[None, :] + (shifts // 64)[:, None]
    by = (shifts % 64).astype(np.uint64)[:, None]
    low = padded[at] >> by
    high = np.where(by == 0, np.uint64(0), padded[at + 1] << ((np.uint64(64) - by) % np.uint64(64)))
    return low | high


def near_pairs(values: np.ndarray, run: np.ndarray, radius: int, lanes: int = 1 << 20) -> Iterator[tuple]:
    """Index pairs (i, j), i < j, of the same run (sorted run numbers) within the radius, in portions."""
    values = np.ascontiguousarray(values, np.uint64)
    counters = max(1, radius.bit_length())
    left = np.arange(len(values))  # positions that still have a partner at the next shift
    shift = 1
    while True:
        size = np.bincount(run[left], minlength=1)[run[left]] if len(left) else np.zeros(0, int)
        left = left[size > shift]
        if not len(left):
            return
        runs, vals = run[left], values[left]
        planes = planes_of(vals)
        width = planes.shape[1]
        # The layout is made anew when half of the positions have dropped out.
        sizes = np.sort(np.bincount(runs)[runs])
        until = max(shift + 1, int(sizes[len(sizes) // 2]))
        while shift < until:
            shifts = np.arange(shift, min(until, shift + max(1, min(64, lanes // len(left)))))
            shift = int(shifts[-1]) + 1
            beyond = np.concatenate([runs, np.full(int(shifts[-1]), -1)])
            same = np.stack([runs == beyond[k : k + len(runs)] for k in shifts])
            valid = np.zeros((len(shifts), width * 8), np.uint8)
            valid[:, : -(-len(runs) // 8)] = np.packbits(same, axis=1, bitorder="little")
            over = ~valid.view(np.uint64)
            count = [np.zeros_like(over) for _ in range(counters)]
            for p in range(64):
                carry = planes[p][None, :] ^ _shifted(planes[p], shifts, width)
                for c in range(counters):
                    count[c], carry = count[c] ^ carry, count[c] & carry
                over |= carry
                if p % 8 == 7 and bool((over == ~np.uint64(0)).all()):
                    break
            else:
                hit = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(runs)]
                k, i = np.nonzero(hit)
                j = i + shifts[k]
                if radius + 1 != 1 << counters and len(i):  # the counters hold more than the radius
                    far = np.bitwise_count(vals[i] ^ vals[j]) > radius
                    i, j = i[~far], j[~far]
                if len(i):
                    yield left[i], left[j]


def forest(n: int, pairs: Iterator[tuple]) -> np.ndarray:
    """For each of n positions the smallest position of its component."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if not (differ := a != b).any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != (up := root[root])).any():
                root = up
    return root


def _linker(radius: int, hold: int):
    """Per stream of rows sorted by bucket: edges (a, b) of each bucket's spanning forest."""

    def flush(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        run = np.zeros(len(fp), np.int64)
        run[change] = 1
        run = np.cumsum(run)
        # Small first inside a run, so that roots are the smallest fingerprints.
        order = np.lexsort((fp, run))
        fp = fp[order]
        root = forest(len(fp), near_pairs(fp.view(np.uint64), run, radius))
        tied = root != np.arange(len(fp))
        return pa.record_batch([pa.array(fp[tied]), pa.array(fp[root[tied]])], names=["a", "b"]) if tied.any() else None

    def link(batches):
        keys, fps, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)
            keys.append(k)
            fps.append(batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64))
            held += len(k)
            if held < hold:
                continue
            key, fp = np.concatenate(keys), np.concatenate(fps)
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            if len(other):  # all but the last bucket, which may go on
                cut = int(other[-1]) + 1
                if (out := flush(key[:cut], fp[:cut])) is not None:
                    yield out
                key, fp = key[cut:], fp[cut:]
            keys, fps, held = [key], [fp], len(fp)
        if held and (out := flush(np.concatenate(keys), np.concatenate(fps))) is not None:
            yield out

    return link


def masks(blocks: int, radius: int) -> list[int]:
    """One mask for each choice of pieces on which a pair within the radius may agree."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    piece = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(piece[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, radius: int = 3, blocks: int | None = None, tile: int = 4096) -> DataFrame:
    """Edges ``a``, ``b`` between fingerprints (column ``fp``, each once) that keep the components of all links."""
    if blocks is None:
        n = distinct.count()
        blocks = radius + 1
        # A bucket should hold a few hundred fingerprints at most where these are spread evenly.
        while blocks < radius + 5 and n >> (64 * (blocks - radius) // blocks) > 256:
            blocks += 1
    tables = [
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks(blocks, radius))
    ]
    placed = distinct.select("fp", F.explode(F.array(*tables)).alias("at")).select("at.t", "at.key", "fp")
    chunks = (
        placed.groupBy("t", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("t", "key", F.ceil(F.col("n") / tile).cast("int").alias("chunks"))
    )
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    # With one chunk the bucket is one cell; else a fingerprint goes to the cells of its chunk with each other one.
    cells = F.when(F.col("chunks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: other != F.col("chunk")),
            lambda other: F.struct(
                F.least(other, F.col("chunk")).alias("i"), F.greatest(other, F.col("chunk")).alias("j")
            ),
        )
    )
    return (
        placed.join(chunks, ["t", "key"])
        .withColumn("chunk", chunk)
        .select("t", "key", F.explode(cells).alias("cell"), "fp")
        .select("t", "key", "cell.i", "cell.j", "fp")
        .repartition("t", "key", "i", "j")
        .sortWithinPartitions("t", "key", "i", "j")
        .mapInArrow(_linker(radius, 1 << 17), "a long, b long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node reachable) for every node that has an edge ``a`` - ``b``."""
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # Large star: each node ties its larger neighbours to the smallest it knows.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node ties its smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        edges = checkpointed(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        before = now


def _named(prints: DataFrame, distinct: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``prints`` with ``component``, by the roots of their ``key``."""
    rooted = distinct.join(found.withColumnRenamed("node", key), key, "left").select(key, "least", F.coalesce("root", key).alias("root"))
    # A component of very many members meets its name in a join that may be split; the minimum is pre-aggregated.
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(names, "root").select(key, "component")
    # One fingerprint may be that of a third of all rows: its rows are dealt over salts, and so is its name.
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("id", "raw"), F.lit(SALTS)).cast("int"))
    told = salted.select(key, "salt").distinct().join(named, key)
    return salted.join(told, [key, "salt"])


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    radius: int = 3,
    blocks: int | None = None,
    tile: int = 4096,
) -> DataFrame:
    """One row per input row: ``id``, ``raw``, ``fp``, ``component`` (the smallest id reachable over links, itself included)."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, size))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(distinct.select("fp"), radius, blocks, tile))
    return _named(prints, distinct, found, "fp").select("id", "raw", "fp", "component")


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: float = 0.8,
    radius: int = 26,
    bands: int = 30,
    rows: int = 5,
    tile: int = 256,
) -> DataFrame:
    """As ``near_groups``, with links between texts whose sets of ``size``-word shingles have this Jaccard similarity or
    more; ``fp`` is the fingerprint of the set."""
    prints = checkpointed(prints_of(docs, id_col, text_col, size, bands, rows))
    # Texts of the same words have the same keys; one text speaks for them.
    least = prints.groupBy("node").agg(F.min("id").alias("least"), F.min("raw").alias("raw"))
    keys = prints.select("node", "fp", "keys").dropDuplicates(["node"])
    distinct = checkpointed(keys.join(least, "node"))
    found = components(similar_links(docs, distinct, text_col, size, similarity, radius, tile))
    return _named(prints.drop("keys"), distinct.select("node", "least"), found, "node").select("id", "raw", "fp", "component")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options
) -> DataFrame:
    """The rows whose id names their component, with their columns as they were.  Rows without an id name nothing
    and all stay; rows that repeat both id and text stay together (exact deduplication is there for those).
    ``similarity`` links by shingle sets (``similar_groups``), None by fingerprints alone (``near_groups``)."""
    if similarity is None:
        groups = near_groups(docs, id_col, text_col, **options)
    else:
        groups = similar_groups(docs, id_col, text_col, similarity=similarity, **options)
    gone = checkpointed(groups.filter("id is not null and id <> component").select("id", "raw").distinct())
    return without(docs, id_col, text_col, gone)
