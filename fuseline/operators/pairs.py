"""Adjacent-pair statistics and selection.

Counting is a partial aggregation inside each Arrow batch (NumPy over the concatenated sequences, with a separator
between documents), then a shuffle of partial counts only: its size follows the number of distinct pairs, not the
length of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, simplex
from ..sources.shared import small_batches

_PAD = 0x110000  # no character has it


def _codes(seqs: list[str]) -> np.ndarray:
    """Token ids of all sequences, a separator after each."""
    joined = np.frombuffer("\ud800".join([*seqs, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(joined == 0xD800, _PAD, np.where(joined >= 0xE000, joined - 0x800, joined))


def portions(seqs: list[str | None], size: int = 1 << 21) -> Iterator[list[int]]:
    """Positions of the sequences that are not empty, in lists of about ``size`` tokens: what a worker holds as arrays
    does not grow with the batch."""
    held, room = [], size
    for k, s in enumerate(seqs):
        if s:
            held.append(k)
            room -= len(s)
            if room <= 0:
                yield held
                held, room = [], size
    if held:
        yield held


def _count_by(seqs: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group, a, b and count of the pairs of sequences that belong to groups (numbers from 0)."""
    ids = _codes(seqs)
    owner = np.repeat(group, [len(s) + 1 for s in seqs])
    left, right, owner = ids[:-1], ids[1:], owner[:-1]
    inside = (left != _PAD) & (right != _PAD)
    left, right, owner = left[inside], right[inside], owner[inside]
    if not len(left):
        return left, left, left, left
    size = int(max(left.max(), right.max())) + 1
    key = (owner * size + left) * size + right
    total = (int(owner.max()) + 1) * size * size
    if total <= 1 << 23:  # few enough to count in place, else sort
        n = np.bincount(key, minlength=total)
        found = np.flatnonzero(n)
        n = n[found]
    else:
        found, n = np.unique(key, return_counts=True)
    return found // (size * size), found // size % size, found % size, n


def _count(seqs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _count_by(seqs, np.zeros(len(seqs), np.int64))[1:]


def pair_counts(seqs: DataFrame, by: Sequence[str] = (), seq: str = "seq", min_count: int = 1) -> DataFrame:
    """(``by``..., a, b, cnt): how often each pair of neighbours occurs; overlapping pairs all count, and no pair
    spans two rows."""
    names = list(by)
    schema = ", ".join([f"`{n}` {seqs.schema[n].dataType.simpleString()}" for n in names] + ["a int", "b int", "cnt long"])

    def partial(batches):
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True)) if names else [()] * len(texts)
            kinds = [batch.schema.field(k).type for k in range(len(names))]
            for live in portions(texts):
                number: dict[tuple, int] = {}
                group = np.array([number.setdefault(keys[k], len(number)) for k in live], np.int64)
                own, a, b, n = _count_by([texts[k] for k in live], group)
                columns = [pa.array([k[c] for k in number], kind).take(pa.array(own)) for c, kind in enumerate(kinds)]
                columns += [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64))]
                yield pa.record_batch(columns, names=[*names, "a", "b", "cnt"])

    counted = (
        small_batches(seqs.select(*names, seq)).mapInArrow(partial, schema).groupBy(*names, "a", "b").agg(F.sum("cnt").alias("cnt"))
    )
    return counted.filter(F.col("cnt") >= min_count) if min_count > 1 else counted


def pair_places(ids: np.ndarray, wanted: Sequence[tuple[int, int]] | None = None) -> np.ndarray:
    """Positions of the first tokens of the pairs (of those ``wanted``) in sequences with separators."""
    left, right = ids[:-1], ids[1:]
    inside = (left != _PAD) & (right != _PAD)
    if wanted is not None:
        keys = np.array([a << 21 | b for a, b in wanted], np.int64)
        inside &= np.isin(left.astype(np.int64) << 21 | right, keys)
    return np.flatnonzero(inside)


def context_keys(ids: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash, as two numbers, of the context of the pair at each place: up to ``window`` tokens on either side."""
    padded = np.concatenate([np.full(window + 1, _PAD, ids.dtype), ids, np.full(window + 2, _PAD, ids.dtype)])
    at = places + window + 1
    tokens: list[np.ndarray] = []
    for step, start in ((-1, 0), (1, 1)):
        live, side = np.ones(len(places), bool), []
        for k in range(1, window + 1):
            t = padded[at + start + step * k]
            live = live & (t != _PAD)
            side.append(np.where(live, t.astype(np.int64) + 1, 0))
        tokens += side[::-1] if step < 0 else side
    one = np.full(len(places), 0x9E3779B97F4A7C15, np.uint64)
    two = np.full(len(places), 0xC2B2AE3D27D4EB4F, np.uint64)
    for t in tokens:  # what is missing at an edge is left out, so that the border is not kept
        there, t = t > 0, t.astype(np.uint64)
        for h, by in ((one, np.uint64(0xFF51AFD7ED558CCD)), (two, np.uint64(0xC4CEB9FE1A85EC53))):
            mixed = (h ^ t) * by
            mixed ^= mixed >> np.uint64(32)
            np.copyto(h, mixed, where=there)
    return one.view(np.int64), two.view(np.int64)


def context_classes(ids: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of the context of the pair at each place: equal for equal contexts, and several times cheaper than ``context_keys``, from
    which those come that an edge cuts."""
    n, size = len(ids), 2 * window + 2
    padded = np.concatenate([np.full(window, _PAD, np.uint64), ids.astype(np.uint64), np.full(window + 1, _PAD, np.uint64)])
    h, by = np.zeros(n, np.uint64), 1
    for k in range(size):
        by = by * 0x5851F42D4C957F2D % (1 << 64)
        if k not in (window, window + 1):
            h += padded[k : k + n] * np.uint64(by)
    h = h[places]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    ends = np.cumsum(np.append(0, padded == _PAD))
    cut = ends[places + size] != ends[places]
    if cut.any():
        h[cut] = context_keys(ids, places[cut], window)[0].view(np.uint64)
    return h


def count_contexts(ids: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(a, b, h1, h2, n) of the pairs at these places: each context with the times it occurs (now and then in two rows)."""
    h1, h2 = context_keys(ids, places, window)
    a, b = ids[places].astype(np.int64), ids[places + 1].astype(np.int64)
    key = h1 ^ (a << 21 | b) * np.int64(0x5851F42D4C957F2D)
    order = np.argsort(key, kind="stable")
    a, b, h1, h2, key = a[order], b[order], h1[order], h2[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (h2[1:] != h2[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return a[first], b[first], h1[first], h2[first], np.diff(np.append(first, len(order)))


CONTEXT = "a int, b int, h1 long, h2 long, cnt long"


def context_batch(ids: np.ndarray, places: np.ndarray, window: int) -> pa.RecordBatch:
    a, b, h1, h2, n = count_contexts(ids, places, window)
    columns = [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(n.astype(np.int64))]
    return pa.record_batch(columns, names=["a", "b", "h1", "h2", "cnt"])


def context_hashes(
    seqs: DataFrame, window: int, wanted: Sequence[tuple[int, int]] | None = None, seq: str = "seq"
) -> DataFrame:
    """(a, b, h1, h2, cnt): the contexts of the pairs (of those ``wanted``, a list that the caller bounds) by a 128-bit hash, counted in
    portions of bounded size; what is shuffled are numbers."""

    def partial(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for live in portions(texts, 1 << 20):
                ids = _codes([texts[k] for k in live])
                yield context_batch(ids, pair_places(ids, wanted), window)

    return small_batches(seqs.select(seq)).mapInArrow(partial, CONTEXT).groupBy("a", "b", "h1", "h2").agg(F.sum("cnt").alias("cnt"))


#: Tokens of the gram that names the bucket of a full window, buckets, and windows that a reader sorts at a time.
GRAM, BUCKETS, SORTED = 6, 2048, 1 << 22


def _mixed(h: np.ndarray, t: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ t) * np.uint64(by)
    return h ^ h >> np.uint64(32)


def window_runs(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, bucket): runs of ``n`` windows of ``size`` tokens, none a separator, that begin at ``first`` and the places after it
    and whose least gram, by hash, stands in one place.  Equal windows have equal least grams, so they meet in one bucket."""
    none = np.zeros(0, np.int64)
    n, m = len(ids) - size + 1, min(GRAM, size)
    if n <= 0:
        return none, none, none
    ends = np.cumsum(np.append(0, ids == _PAD))
    full = ends[size:] == ends[:-size]
    h = np.full(len(ids) - m + 1, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(m):
        h = _mixed(h, ids[k : k + len(h)].astype(np.uint64) + np.uint64(1), 0xFF51AFD7ED558CCD)
    low = np.uint64(0xFF)
    least = h[:n] & ~low
    for k in range(1, size - m + 1):  # the last eight bits hold the place; of equal grams the first counts
        least = np.minimum(least, h[k : k + n] & ~low | np.uint64(k))
    place = np.arange(n) + (least & low).astype(np.int64)
    new = np.append(True, (place[1:] != place[:-1]) | (full[1:] != full[:-1]))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    kept = full[first]
    bucket = (least[first] >> np.uint64(8)) % np.uint64(BUCKETS)
    return first[kept], length[kept], bucket[kept].astype(np.int64)


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def packed_runs(ids: np.ndarray, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, bytes a token, bytes, compressed body) of the runs of windows; a body holds the windows of each run as a byte and
    their tokens one behind the other."""
    first, n, bucket = window_runs(ids, size)
    if not len(first):
        return
    order = np.argsort(bucket, kind="stable")
    first, n, bucket = first[order], n[order], bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
    for k, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
        tokens = ids[_spans(first[k:end], n[k:end] + size - 1)]
        width = 1 if tokens.max() < 1 << 8 else 2 if tokens.max() < 1 << 16 else 4
        body = np.uint32(end - k).tobytes() + n[k:end].astype(np.uint8).tobytes() + tokens.astype(f"<u{width}").tobytes()
        yield int(bucket[k]), width, len(body), pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(width: int, length: int, body: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a body, and the places where its windows begin."""
    body = pa.decompress(body, length, codec="zstd", asbytes=True)
    runs = int(np.frombuffer(body, np.uint32, 1)[0])
    n = np.frombuffer(body, np.uint8, runs, 4).astype(np.int64)
    tokens = np.frombuffer(body, f"<u{width}", offset=4 + runs)
    lengths = n + size - 1
    return tokens, _spans(np.cumsum(lengths) - lengths, n)


def _summed(pair: np.ndarray, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((c, pair))
    pair, c, m = pair[order], c[order], m[order]
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (c[1:] != c[:-1]))) if len(pair) else np.zeros(0, np.int64)
    return pair[first], c[first], np.add.reduceat(m, first) if len(first) else m


def _window_kinds(bodies: list[tuple[int, int, bytes]], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, c, m): how many of a bucket's windows occur c times; sorted in shares by hash, so that memory does not follow the bucket."""
    middle = size // 2 - 1
    parts = 1 + sum(length // width for width, length, _ in bodies) // SORTED
    for part in range(parts):
        ones, twos, pairs = [], [], []
        for width, length, body in bodies:
            tokens, at = _unpacked(width, length, body, size)
            one, two = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64), np.full(len(at), 0xC2B2AE3D27D4EB4F, np.uint64)
            for k in range(size):
                t = tokens[at + k].astype(np.uint64) + np.uint64(1)
                one, two = _mixed(one, t, 0xFF51AFD7ED558CCD), _mixed(two, t, 0xC4CEB9FE1A85EC53)
            pair = tokens[at + middle].astype(np.int64) << 21 | tokens[at + middle + 1]
            if parts > 1:
                own = two % np.uint64(parts) == part
                one, two, pair = one[own], two[own], pair[own]
            ones.append(one), twos.append(two), pairs.append(pair)
        one, two, pair = np.concatenate(ones), np.concatenate(twos), np.concatenate(pairs)
        order = np.argsort(one, kind="stable")
        if ((one[order][1:] == one[order][:-1]) & (two[order][1:] != two[order][:-1])).any():
            order = np.lexsort((two, one))
        one, two, pair = one[order], two[order], pair[order]
        first = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else np.zeros(0, np.int64)
        yield _summed(pair[first], np.diff(np.append(first, len(one))), np.ones(len(first), np.int64))


def context_kinds(seqs: DataFrame, window: int, seq: str = "seq") -> DataFrame:
    """(a, b, c, m): how many contexts of a pair occur c times, in several rows to be summed.

    A pair with a whole context is a window of tokens.  Windows that overlap and share their least gram travel as one run of text to the
    bucket of that gram, so that an occurrence costs a few bytes of shuffle instead of a row; where equal windows meet they
    are counted.  Contexts that an edge cuts are fewer than 2 x ``window`` a sequence and go as hashes; none of them equals a whole one."""
    size = 2 * window + 2

    def runs(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for live in portions(texts):
                found = list(packed_runs(_codes([texts[k] for k in live]), size))
                columns = list(zip(*found, strict=True)) or [[]] * 4
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "width", "length", "body"])

    def edges(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for live in portions(texts, 1 << 20):
                ids = _codes([texts[k] for k in live])
                at = pair_places(ids)
                missing = np.concatenate([np.ones(window, bool), ids == _PAD, np.ones(window, bool)])
                ends = np.cumsum(np.append(0, missing))
                cut = ends[at + size] != ends[at]
                yield context_batch(ids, at[cut], window)

    def kinds(batches):
        held: list[tuple[int, int, bytes]] = []
        at, found = None, [(np.zeros(0, np.int64),) * 3]
        for batch in batches:
            for bucket, *body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    found += _window_kinds(held, size) if held else []
                    if sum(len(x[0]) for x in found) > 1 << 20:
                        found = [_summed(*(np.concatenate(x) for x in zip(*found, strict=True)))]
                    at, held = bucket, []
                held.append(tuple(body))
        found += _window_kinds(held, size) if held else []
        pair, c, m = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.record_batch(
            [pa.array((pair >> 21).astype(np.int32)), pa.array((pair & (1 << 21) - 1).astype(np.int32)), pa.array(c), pa.array(m)], names=["a", "b", "c", "m"]
        )

    texts = small_batches(seqs.select(seq))
    dealt = texts.mapInArrow(runs, "bucket int, width int, length int, body binary").repartition("bucket").sortWithinPartitions("bucket")
    whole = dealt.mapInArrow(kinds, "a int, b int, c long, m long")
    short = texts.mapInArrow(edges, CONTEXT).groupBy("a", "b", "h1", "h2").agg(F.sum("cnt").alias("c"))
    return whole.unionByName(short.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("m")))


def entropy_of_kinds(kinds: DataFrame, key: Sequence[str] = ("a", "b")) -> DataFrame:
    """(key..., n, entropy) from (key..., c, m), m contexts that occur c times each."""
    lists = kinds.groupBy(*key).agg(
        F.sum(F.col("c") * F.col("m")).alias("n"), F.sort_array(F.collect_list(F.struct("c", "m"))).alias("cs")
    )
    term = lambda s: (s["c"] / F.col("n")) * F.ln(s["c"] / F.col("n") + 1e-10) * s["m"]
    return lists.select(*key, "n", F.aggregate("cs", F.lit(0.0), lambda acc, s: acc - term(s)).alias("entropy"))


def entropy_of(counts: DataFrame, key: Sequence[str] = ("a", "b"), cnt: str = "cnt") -> DataFrame:
    """(key..., n, entropy) from context counts: H = -sum p ln(p + 1e-10).

    Equal counts fall together first, so that what is gathered for a pair is at most its distinct counts (about the
    root of twice its occurrences), summed in ascending order whatever the partitioning.
    """
    return entropy_of_kinds(counts.groupBy(*key, F.col(cnt).alias("c")).agg(F.count(F.lit(1)).alias("m")), key)


def context_entropy(
    seqs: DataFrame, window: int = 5, min_count: int = 1, wanted: Sequence[tuple[int, int]] | None = None, seq: str = "seq"
) -> DataFrame:
    """(a, b, cnt, entropy) of pairs that occur at least ``min_count`` times."""
    if wanted is None:
        found = entropy_of_kinds(context_kinds(seqs, window, seq).groupBy("a", "b", "c").agg(F.sum("m").alias("m")))
    else:
        found = entropy_of(context_hashes(seqs, window, wanted, seq))
    found = found.withColumnRenamed("n", "cnt")
    return found.filter(F.col("cnt") >= min_count)


def capped_context_entropy(
    seqs: DataFrame, window: int = 3, cap: int = 64, order: str = "doc_id", seq: str = "seq"
) -> DataFrame:
    """(a, b, cnt, entropy) over the first ``cap`` occurrences of each pair in corpus order; ``cnt`` is the full count.

    The smallest ``cap`` by (order, position) are taken as a tree: by portion, by pair and salt (as many salts as the root of the
    number of tasks), by pair.  Spark applies the bound of a rank before its shuffle too, so no task meets more than ``cap`` rows
    of a pair from each task before it, and no salt or pair more than ``cap`` from each of a root of the tasks.
    """
    kind = seqs.schema[order].dataType.simpleString()

    def partial(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            by_key = pa.compute.sort_indices(keys, null_placement="at_start").to_pylist()
            for live in portions([texts[k] for k in by_key], 1 << 20):
                rows = [by_key[k] for k in live]
                ids = _codes([texts[k] for k in rows])
                places = pair_places(ids)
                a, b = ids[places].astype(np.int64), ids[places + 1].astype(np.int64)
                pair = a << 21 | b
                by_pair = np.argsort(pair, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(pair[by_pair]) != 0)) if len(pair) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(first, len(pair)))
                rank = np.arange(len(pair)) - np.repeat(first, sizes)
                chosen = by_pair[rank < cap]
                h1, h2 = context_keys(ids, places[chosen], window)
                starts = np.cumsum([0, *(len(texts[k]) + 1 for k in rows)])
                doc = np.searchsorted(starts, places[chosen], side="right") - 1
                yield pa.record_batch(
                    [
                        pa.array(a[chosen].astype(np.int32)),
                        pa.array(b[chosen].astype(np.int32)),
                        keys.take(pa.array(np.array(rows, np.int64)[doc])),
                        pa.array(places[chosen] - starts[doc]),
                        pa.array(h1),
                        pa.array(h2),
                    ],
                    names=["a", "b", "doc", "pos", "h1", "h2"],
                )

    rows = small_batches(seqs.select(order, seq)).mapInArrow(partial, f"a int, b int, doc {kind}, pos long, h1 long, h2 long")
    salts = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def smallest(found: DataFrame, *key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*key).orderBy("doc", "pos"))
        return found.withColumn("place", place).filter(F.col("place") <= cap).drop("place")

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(salts)).cast("int"))
    first = smallest(smallest(salted, "a", "b", "salt"), "a", "b")
    counts = first.groupBy("a", "b", "h1", "h2").agg(F.count(F.lit(1)).alias("cnt"))
    entropies = entropy_of(counts).select("a", "b", "entropy")
    return pair_counts(seqs, seq=seq).join(entropies, ["a", "b"]).select("a", "b", "cnt", "entropy")


# ---------------------------------------------------------------------------------------------- scores


def with_distance(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``pairs`` with the distance ``d`` of their points; 0 of a token to itself and when an id has no point.  The vocabulary's size is known to
    the planner, which broadcasts it while it is small."""
    a = vocab.select(F.col("coord_id").alias("a"), F.col("vector").alias("va"))
    b = vocab.select(F.col("coord_id").alias("b"), F.col("vector").alias("vb"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    # The overlap of a point with itself leaves rounding noise; that distance is 0.
    apart = F.when(F.col("a") != F.col("b"), simplex.distance(F.col("va"), F.col("vb")))
    return joined.withColumn("d", F.coalesce(apart, F.lit(0.0))).drop("va", "vb")


def with_coupling(pairs: DataFrame, vocab: DataFrame, length: int) -> DataFrame:
    """``pairs`` with ``d`` and ``coupling``; ``length`` is the number of tokens in the corpus."""
    known = with_distance(pairs, vocab)
    return known.withColumn("coupling", scores.coupling(F.col("cnt"), F.lit(float(max(length, 1))), F.col("d")))


def pair_stats(seqs: DataFrame, vocab: DataFrame, length: int, window: int = 5, min_count: int = 5, seq: str = "seq") -> DataFrame:
    """Count, entropy and coupling of every pair that occurs often enough."""
    return with_coupling(context_entropy(seqs, window, min_count, seq=seq), vocab, length)


def top_pairs(stats: DataFrame, score: Column, k: int) -> DataFrame:
    """The k best pairs; equal scores go to the smaller pair."""
    return stats.withColumn("score", score).orderBy(F.desc("score"), "a", "b").limit(k)


def best_pair(stats: DataFrame, score: Column) -> tuple[int, int] | None:
    row = top_pairs(stats, score, 1).first()
    return None if row is None else (row["a"], row["b"])


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(a, b, cnt) of pairs whose count differs; 0 for those that are gone."""
    x, y = before.alias("x"), after.alias("y")
    on = (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b"))
    new = F.coalesce("y.cnt", F.lit(0)).cast("long")
    return (
        x.join(y, on, "full_outer")
        .filter(F.coalesce("x.cnt", F.lit(0)) != new)
        .select(F.coalesce("x.a", "y.a").alias("a"), F.coalesce("x.b", "y.b").alias("b"), new.alias("cnt"))
    )


def cluster_scores(targets: DataFrame, stats: DataFrame, vocab: DataFrame, near: float = 1.0) -> DataFrame:
    """``targets`` (a, b; any number) with ``cluster``: 1 / (d + 0.1) plus at most 1 from
    pairs that touch a or b and whose other end lies closer than ``near`` to both, a tenth of their count each."""
    known = vocab.select("coord_id")
    t = with_distance(targets.select("a", "b").distinct(), vocab)
    for x in ("a", "b"):
        t = t.join(known.withColumnRenamed("coord_id", x), x, "left_semi")
    # Each entry of the statistics touches a target through its first or its second member.
    ends = stats.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("end"), F.col("b").alias("other"), "cnt", F.lit(0).alias("side")),
                F.struct(F.col("b").alias("end"), F.col("a").alias("other"), "cnt", F.lit(1).alias("side")),
            )
        ).alias("e")
    ).select("e.*").join(known.withColumnRenamed("coord_id", "other"), "other", "left_semi")
    touched = t.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("end"))
    around = ends.join(touched, "end").filter((F.col("other") != F.col("a")) & (F.col("other") != F.col("b"))).select("a", "b", "other", "cnt")
    # Each distance once, whatever the number of targets that need it; the smaller token first, as distances are symmetric.
    sides = around.select(F.explode(F.array(*[F.struct(F.least("other", x).alias("a"), F.greatest("other", x).alias("b")) for x in ("a", "b")])).alias("p"))
    close = with_distance(sides.select("p.a", "p.b").distinct(), vocab).filter(F.col("d") < near)
    for x in ("a", "b"):
        side = close.select(F.col("a").alias("low"), F.col("b").alias("high"))
        around = around.withColumn("low", F.least("other", x)).withColumn("high", F.greatest("other", x)).join(side, ["low", "high"], "left_semi").drop("low", "high")
    weights = around.groupBy("a", "b").agg(F.sum("cnt").alias("weight"))
    bonus = F.least(F.coalesce("weight", F.lit(0)) * 0.1, F.lit(1.0))
    return t.join(weights, ["a", "b"], "left").select("a", "b", (1.0 / (F.col("d") + 0.1) + bonus).alias("cluster"))
