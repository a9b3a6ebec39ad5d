"""Links of SimHash near-duplicates at a similarity of word shingles, for radii too wide for buckets of equal pieces.

At a Jaccard similarity of 0.8 two fingerprints differ in about 10 of 64 bits and now and then in 20; no choice of
equal pieces finds such pairs.  So the buckets come from MinHash: ``rows`` MinHash values make a band, ``bands`` of
them are taken, and two texts meet when a band is equal.  At a similarity s a pair is missed with probability
(1 - s^rows)^bands, 7 in a million at 0.8 and fewer above.

Inside the buckets the bit-sliced comparison of ``simhash`` decides which pairs are worth a look: those within ``radius``
bits (unrelated texts differ in 32 bits, give or take 4; at a similarity of 0.8 more than 26 are rarer than one in a
hundred thousand).  The shingle sets themselves are compared for these, and a pair links at ``similarity`` or more.

Large groups.  First every member is compared with the smallest fingerprint's owner of its bucket only: one comparison
for each member, spread over salts where many share one.  Their links make components, and what is left are pairs of
different components inside one bucket.  Those are compared in cells of ``tile`` texts: of the bucket's main component only
with the others, never with itself, so a bucket that is one group of copies costs no more than its members.  Nothing
is capped or left out.  Sets travel only for texts that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, maybe_among, raw_hash, small_batches

SEED = 42
_WORDS = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> bytes:
    """The words of a text in lower case, joined by one space."""
    return b" ".join((text or "").encode("utf-8").translate(_WORDS).split())


#: Bytes that are hashed at a time.
_RUN = 1 << 18
_FACTOR = 0x5851F42D4C957F2D
#: Bytes of shingle sets that a worker hands over at a time.
PORTION = 1 << 22


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2^64, and a number for each byte."""
    tables = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        table = np.full(_RUN + 1, base, np.uint64)
        table[0] = 1
        tables.append(np.cumprod(table, dtype=np.uint64))
    values = np.random.RandomState(SEED).randint(0, 1 << 62, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return tables[0], tables[1], values


def _hashes(line: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of substrings, which depend on their bytes alone: differences of a running polynomial, mixed."""
    import xxhash

    power, inverse, values = _powers()
    out = np.empty(len(starts), np.uint64)
    flat = np.frombuffer(line, np.uint8)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        until = int(np.searchsorted(ends, base + _RUN, side="right"))
        if until <= at:  # one that is so long by itself
            out[at] = xxhash.xxh64_intdigest(line[base : int(ends[at])], SEED)
            at += 1
            continue
        own = flat[base : int(ends[until - 1])]
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[own] * power[: len(own)], dtype=np.uint64)])
        first, last = starts[at:until] - base, ends[at:until] - base
        h = (run[last] - run[first]) * inverse[first]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
        out[at:until] = h ^ h >> np.uint64(32)
        at = until
    return out


def shingles(line: bytes, size: int = 5) -> np.ndarray:
    """Sorted hashes of the shingles of ``words_of`` a text, each once."""
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(gaps) < size:
        starts, ends = np.array([0]), np.array([len(line)])
    else:
        starts = np.concatenate([[0], gaps[: len(gaps) + 1 - size] + 1])
        ends = np.concatenate([gaps[size - 1 :], [len(line)]])
    return np.unique(_hashes(line, starts, ends))


def majority(hashes: np.ndarray) -> int:
    """Bit i is one if it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(SEED)
    by = rng.randint(0, 1 << 31, n, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return by, rng.randint(0, 1 << 32, n, np.int64).astype(np.uint32)


def band_keys(hashes: np.ndarray, bands: int = 30, rows: int = 5) -> np.ndarray:
    """One key for each band of the MinHash values of a set; keys of different bands differ too."""
    import xxhash

    by, plus = _permutations(bands * rows)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(bands * rows, ~np.uint32(0))
    for k in range(0, len(upper), 256):
        part = np.bitwise_xor(upper[k : k + 256], plus)
        np.multiply(part, by, out=part)
        np.minimum(least, part.min(axis=0), out=least)
    raw, width = least.tobytes(), 4 * rows
    return np.array([xxhash.xxh64_intdigest(raw[width * t : width * (t + 1)], SEED + t) for t in range(bands)], np.uint64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes have this Jaccard similarity."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _sets(nodes: list[int], sets: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sets, pa.binary())], names=["node", "own"])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])


def _stars(similarity: float):
    """Per stream of rows (hub, salt, node, own), a hub's own row first: edges of the members that are similar to it."""

    def link(batches):
        at, hub = None, None
        for batch in batches:
            found = []
            hubs, salts, nodes = (batch.column(c).to_pylist() for c in range(3))
            for h, s, node, own in zip(hubs, salts, nodes, batch.column(4), strict=True):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                if node == h:
                    at, hub = (h, s), own
                elif at == (h, s) and similar(hub, own, similarity):
                    found.append((node, h))
            if found:
                yield _edges(found)

    return link


def _cells(batches, columns: int, room: int) -> Iterator[list[list]]:
    """Rows sorted by their first three columns, as lists of columns that hold whole cells, at about ``room`` bytes."""
    held, last, size = [[] for _ in range(columns)], None, 0
    for batch in batches:
        own = [batch.column(c).to_pylist() for c in range(columns)]
        for row in zip(*own, strict=True):
            if row[:3] != last:
                if size > room:
                    yield held
                    held, size = [[] for _ in range(columns)], 0
                last = row[:3]
            for c, value in zip(held, row, strict=True):
                c.append(value)
            size += 64 + (len(row[-1]) if type(row[-1]) is bytes else 0)
    if held[0]:
        yield held


def _candidates(held: list[list], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of one cell, of different components and within the radius, by bit planes."""
    from .simhash import near_pairs

    run, last = [], None
    for cell in zip(*held[:3], strict=True):
        run.append(run[-1] + (cell != last) if run else 0)
        last = cell
    comp = np.array(held[5], np.int64)
    for i, j in near_pairs(np.array(held[4], np.int64).view(np.uint64), np.array(run, np.int64), radius):
        differ = comp[i] != comp[j]
        if differ.any():
            yield i[differ], j[differ]


def _screen(radius: int):
    """Rows (key, i, j, node, fp, comp): those that have a candidate in their cell."""
    names = ["key", "i", "j", "node", "fp", "comp"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def keep(batches):
        for held in _cells(batches, 6, 1 << 23):
            wanted = np.zeros(len(held[0]), bool)
            for i, j in _candidates(held, radius):
                wanted[i] = wanted[j] = True
            if wanted.any():
                at = np.flatnonzero(wanted)
                yield pa.record_batch([pa.array([c[k] for k in at], t) for c, t in zip(held, kinds, strict=True)], names=names)

    return keep


def _linked(radius: int, similarity: float):
    """Rows (key, i, j, node, fp, comp, own): edges that join the components of each cell."""

    def link(batches):
        for held in _cells(batches, 7, 1 << 25):
            sets = [np.frombuffer(s, np.uint64) for s in held[6]]
            root: dict[tuple, tuple] = {}

            def find(x):
                while x in root:
                    x = root[x]
                return x

            found = []
            name = list(zip(*held[:3], held[5], strict=True))  # a component, in its cell
            for i, j in _candidates(held, radius):
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = find(name[a]), find(name[b])
                    if x != y and similar(sets[a], sets[b], similarity):
                        root[x] = y
                        found.append((held[3][a], held[3][b]))
            if found:
                yield _edges(found)

    return link


def prints_of(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """``id``, ``raw``, ``node`` (a hash of the words), ``fp`` and ``keys``, one row per input row."""
    import xxhash

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(texts: pa.Array) -> pa.Array:
        found = []
        for t in texts:
            line = words_of(t.as_py())
            own = shingles(line, size)
            head = np.array([xxhash.xxh64_intdigest(line, SEED), majority(own)], np.uint64)
            found.append(np.concatenate([head, band_keys(own, bands, rows)]).view(np.int64))
        return pa.array(found, pa.list_(pa.int64()))

    each = small_batches(docs).select(F.col(id_col).alias("id"), raw_hash(text_col).alias("raw"), of(F.col(text_col).cast("string")).alias("all"))
    return each.select("id", "raw", F.col("all")[0].alias("node"), F.col("all")[1].alias("fp"), F.slice("all", 3, bands).alias("keys"))


def links(
    docs: DataFrame, distinct: DataFrame, text_col: str, size: int, similarity: float, radius: int, tile: int
) -> DataFrame:
    """Edges ``a``, ``b`` between nodes that keep the components of all links.  ``distinct`` has each node once, with ``raw``
    (of one of its texts), ``fp`` and ``keys``."""
    import xxhash

    from .simhash import components

    placed = distinct.select("node", "fp", F.explode("keys").alias("key"))
    buckets = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"),
        F.min("node").alias("hub"),
        F.min_by("fp", "node").alias("hub_fp"),
    )
    # Of buckets with the same members one is compared.
    once = checkpointed(
        buckets.filter("n > 1").groupBy("n", "members", "hub", "hub_fp").agg(F.min("key").alias("key")).drop("members")
    )
    members = checkpointed(
        maybe_among(placed, F.col("key"), once.select("key"), once.count()).join(once, "key").filter("node <> hub")
    )

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub_fp"))) <= radius
    salts = F.ceil(F.max("n") / 4096).cast("int")
    rays = members.filter(near).groupBy("hub", "node").agg(salts.alias("salts"))
    rays = checkpointed(rays.select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node"))
    rest = members.filter("n > 2")

    def sets_of(batches):
        """The node and the shingle set of each text.  A map, not a column: the join below asks for nodes that are not null, and
        Spark would put that question under the projection, so that a second worker in each task computed every set again."""
        for batch in batches:
            nodes, sets, held = [], [], 0
            for t in batch.column(0):
                line = words_of(t.as_py())
                nodes.append(xxhash.xxh64_intdigest(line, SEED))
                sets.append(shingles(line, size).tobytes())
                held += len(sets[-1])
                if held > PORTION:
                    yield _sets(nodes, sets)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield _sets(nodes, sets)

    def with_sets(rows: DataFrame) -> DataFrame:
        """``rows`` with ``own``, the shingle set of their node."""
        wanted = checkpointed(distinct.join(rows.select("node").distinct(), "node").select("node", "raw"))
        some = maybe_among(docs.select(F.col(text_col).cast("string").alias("text")), raw_hash("text"), wanted.select("raw"), wanted.count())
        sets = some.mapInArrow(sets_of, "node long, own binary").groupBy("node").agg(F.first("own").alias("own"))
        return rows.join(sets, "node")

    hubs = rays.select("hub", "salt", F.col("hub").alias("node")).distinct()
    starred = with_sets(checkpointed(rays.unionByName(hubs))).select("hub", "salt", "node", (F.col("node") != F.col("hub")).alias("ray"), "own")
    stars = checkpointed(
        starred.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "ray").mapInArrow(_stars(similarity), "a long, b long").distinct()
    )

    known = components(stars)
    rest = checkpointed(
        rest.join(known.withColumnRenamed("root", "comp"), "node", "left").select("key", "node", "fp", F.coalesce("comp", "node").alias("comp"))
    )
    mixed = rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by("comp", "node").alias("main")).filter("low <> high")
    mixed = checkpointed(mixed.select("key", "main"))
    open_ = checkpointed(
        maybe_among(rest, F.col("key"), mixed.select("key"), mixed.count()).join(mixed, "key").withColumn("side", (F.col("comp") != F.col("main")).cast("int"))
    )
    sizes = open_.groupBy("key").agg(
        F.ceil(F.sum(1 - F.col("side")) / tile).cast("int").alias("mains"), F.ceil(F.sum("side") / tile).cast("int").alias("others")
    )
    cells = open_.join(sizes, "key").select("key", "node", "fp", "comp", F.explode(_cell_list()).alias("cell"))
    cells = cells.select("key", "cell.i", "cell.j", "node", "fp", "comp")
    order = ["key", "i", "j"]
    screened = checkpointed(
        cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(_screen(radius), "key long, i int, j int, node long, fp long, comp long")
    )
    joined = (
        with_sets(screened).select(*order, "node", "fp", "comp", "own").repartition(*order).sortWithinPartitions(*order)
    ).mapInArrow(_linked(radius, similarity), "a long, b long")
    return stars.unionByName(joined).distinct()


def _cell_list() -> Column:
    """The cells of a member: chunks of the main component are 0 to ``mains`` - 1, the others' follow; a cell is a chunk of
    others with any other chunk, and pairs inside one chunk meet in each of its cells."""
    other = F.col("side") == 1
    chunk = F.when(other, F.col("mains") + F.pmod(F.xxhash64("node"), F.col("others")).cast("int")).otherwise(
        F.pmod(F.xxhash64("node"), F.greatest("mains", F.lit(1))).cast("int")
    )
    every = F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1)
    partners = F.when(other, every).otherwise(F.slice(every, F.col("mains") + 1, F.col("others")))
    one = F.array(F.struct(chunk.alias("c"), partners.alias("p")))
    return F.flatten(
        F.transform(
            one,
            lambda x: F.transform(
                F.filter(x["p"], lambda p: p != x["c"]),
                lambda p: F.struct(F.least(p, x["c"]).alias("i"), F.greatest(p, x["c"]).alias("j")),
            ),
        )
    )
