"""Best-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

Bound-certified repacking.  Pieces are dealt into partitions.  Each partition is packed best-fit decreasing, and a lower
bound from dual-feasible functions certifies its number of bins: a partition that meets its bound is final.
Partitions with a gap exchange documents (they are pooled two by two) and are packed again, until each is certified
or one pool is left.  Then the same certificate is held against the whole: bins that are not full cost at most one
bin each certified partition, so if the total exceeds the bound of all pieces together, the partitions' part-filled
bins are dissolved and their pieces packed once more together; the better packing stands.

Scale.  Pieces of one length are interchangeable, so a partition is its histogram of lengths: at most ``capacity``
rows whatever the number of documents, and ``capacity`` x ``PARTITIONS`` rows are all that the driver ever gets.
Best fit works on counts too: c pieces of one length go into the fullest bins that they fit, a whole group of equal
bins at a time.  The plan (which ranks of a length go to which group of bins) is as bounded.  Pieces find their place
by their rank among the pieces of their length and partition, and by an equi-join with the plan.  Ranks are taken
inside (partition, length, salt), where the number of salts follows the rows, and each salt begins where the ones
before it end; so one length that holds a third of all rows is ranked by many tasks.  A piece of ``capacity`` tokens is a
sequence of its own, which no rank and no shuffle has to tell.

Odd input: a null text is the empty text, whose only token is the end mark; rows with a null or repeated id are
pieces like any other (the id is carried, not used); an empty table gives no rows; ``pack_documents`` ignores other
columns, ``pack`` keeps them whatever their names, except that ``sequence_id`` and ``offset`` are made anew.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh_name, small_batches

PARTITIONS = 16
#: Rows of one partition and length that one task ranks, about.
RANKED = 50_000
END_ID = 2

# ------------------------------------------------------------------------------------------------- tokens


#: Ranges whose characters have long had their classes in all Unicode versions in use: Latin, Greek, Cyrillic, Hebrew, Arabic,
#: Devanagari, Thai, punctuation, symbols, kana, common Han, Hangul, full-width forms, emoji.
_SETTLED = (
    (0x20, 0x52F), (0x5D0, 0x5EA), (0x620, 0x64A), (0x660, 0x669), (0x900, 0x97F), (0xE01, 0xE3A), (0xE40, 0xE5B), (0x2000, 0x22FF),
    (0x2500, 0x27BF), (0x3000, 0x303F), (0x3041, 0x3096), (0x3099, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F),
    (0xFF01, 0xFF5E), (0x1F300, 0x1FAFF),
)
#: The pre-tokens of byte-level BPE; a fixed value.
_PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Tokens:
    """Ids of the byte-level BPE in ``path`` as little-endian 32-bit integers.

    The same vocabulary in ``ranks_path`` is read by a library that is several times faster.  Texts with code points on
    whose class Unicode versions may differ, and those that hold the string of one of the tokenizer's added tokens,
    go through the tokenizer itself.
    """

    _loaded: dict[str, Tokens] = {}

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or r"(?!)").search
        settled = "".join(f"{chr(a)}-{chr(b)}" for a, b in _SETTLED)
        self.unsettled = re.compile(f"[^\t-\r{re.escape(settled[0])}{settled[1:]}]").search
        self.fast = None
        if ranks_path is not None:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("pieces", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str, ranks_path: str | None) -> Tokens:
        key = f"{path} {ranks_path}"
        if key not in cls._loaded:
            cls._loaded[key] = cls(path, ranks_path)
        return cls._loaded[key]

    def ids(self, text: str) -> bytes:
        if self.fast is None or self.unsettled(text) or self.special(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


def tokenize(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = END_ID,
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian unsigned 32-bit).

    ``tokenizer`` and ``ranks`` name files of the public tokenizers (or are paths); ``ranks`` holds the same
    vocabulary for the faster library, None does without.  Only documents longer than ``capacity`` are cut; of their
    pieces the first may be shorter, the others are full.
    """

    def cut(batches: Iterable[pa.RecordBatch]):
        import public_tokenizers

        paths = [p and (p if "/" in p else public_tokenizers.path(p)) for p in (tokenizer, ranks)]
        tokens = Tokens.of(*paths)
        end = np.array([end_id], "<u4").tobytes()

        def batch(rows):
            ids, piece, start, payload = zip(*rows, strict=True)
            return pa.record_batch(
                [
                    pa.array(ids, kind),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(p) // 4 for p in payload], pa.int64()),
                    pa.array(payload, pa.binary()),
                ],
                names=["id", "piece", "start", "length", "ids"],
            )

        for b in batches:
            kind = b.schema.field(0).type
            rows, size = [], 0
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                all_ids = tokens.ids(t.as_py() or "") + end
                n = len(all_ids) // 4
                first = n if n <= capacity else (n - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    until = first if k == 0 else at + capacity
                    rows.append((key, k, at, all_ids[4 * at : 4 * until]))
                size += len(all_ids)
                if size > 1 << 22:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, ids binary"
    )


# ------------------------------------------------------------------------------------------------- bins


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions: the plain sum, the threshold functions (pieces over
    capacity - t count whole, pieces under t not at all) and the rounding functions of Fekete and Schepers."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return 0
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    best = -(-int((lengths * counts).sum()) // capacity)
    for t in {int(x) for x in lengths if 2 * x <= capacity} | {int(capacity - x) for x in lengths if 2 * x > capacity}:
        value = np.where(lengths > capacity - t, capacity, np.where(lengths < t, 0, lengths))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 33):  # u_k: multiples of 1/(k+1) stay, else floor((k+1)x)/k
        scaled = (k + 1) * lengths
        whole = scaled % capacity == 0
        # In units of 1 / (k * capacity).
        value = np.where(whole, k * lengths, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing on counts: groups (bins, ((length, pieces of it in each bin), ...))."""
    open_: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # room left -> groups
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in open_ if r >= length):
            # In a bin of this room the same length fits again and again, each time the best fit once more.
            groups = open_.pop(room)
            fits = room // length
            while groups and left:
                bins, content = groups.pop()
                full = min(bins, left // fits)
                if full:
                    open_[room - fits * length].append((full, (*content, (length, fits))))
                    left -= full * fits
                    bins -= full
                if bins and left:
                    open_[room - left * length].append((1, (*content, (length, left))))
                    left, bins = 0, bins - 1
                if bins:
                    groups.append((bins, content))
            if groups:
                open_[room] += groups
            if not left:
                break
        if left:
            fits = capacity // length
            if full := left // fits:
                open_[capacity - fits * length].append((full, ((length, fits),)))
            if rest := left % fits:
                open_[capacity - rest * length].append((1, ((length, rest),)))
    return [g for room in sorted(open_) for g in open_[room]]


def _pooled(histograms: Iterable[dict[int, int]]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for h in histograms:
        for length, n in h.items():
            out[length] += n
    return dict(out)


def _bins(groups) -> int:
    return sum(n for n, _ in groups)


def repack(parts: list[dict[int, int]], capacity: int) -> list[tuple[dict[int, int], list]]:
    """Packs partitions, given as histograms, by bound-certified repacking: (histogram, groups) of each final pool.

    The pools' histograms add up to those given; which partition a piece came from no longer matters.
    """
    done, gaps = [], []
    for h in parts:
        groups = best_fit(h, capacity)
        (done if _bins(groups) == lower_bound(h, capacity) else gaps).append((h, groups))
    while len(gaps) > 1:
        gaps.sort(key=lambda p: sum(p[0].values()))
        pairs = [_pooled(h for h, _ in gaps[k : k + 2]) for k in range(0, len(gaps), 2)]
        before, gaps = gaps, []
        for k, h in enumerate(pairs):
            own = before[2 * k : 2 * k + 2]
            groups = best_fit(h, capacity)
            if _bins(groups) == lower_bound(h, capacity):
                done.append((h, groups))
            elif len(own) == 2 and _bins(groups) > sum(_bins(g) for _, g in own):
                # Apart they are better: keep their bins as one pool.
                gaps.append((h, own[0][1] + own[1][1]))
            else:
                gaps.append((h, groups))
    pools = [p for p in done + gaps if p[0]]
    whole = _pooled(h for h, _ in pools)
    if sum(_bins(g) for _, g in pools) > lower_bound(whole, capacity):
        # Certified apart, yet not together: what part-filled bins hold is packed once more, then everything.
        used = lambda content: sum(n * x for x, n in content)
        full = [g for _, gs in pools for g in gs if used(g[1]) == capacity]
        loose = _pooled({x: bins * n for x, n in content} for _, gs in pools for bins, content in gs if used(content) < capacity)
        again = min(full + best_fit(loose, capacity), best_fit(whole, capacity), key=_bins)
        if _bins(again) < sum(_bins(g) for _, g in pools):
            return [(whole, again)]
    return pools


def _plan(parts: dict[int, dict[int, int]], pools):
    """Rows (part, length, from, until, first bin, bins, offset, seen): pieces with rank r in [from, until) of their part
    and length go to bin first + j % bins, at offset + (j // bins) * length, where j = seen + r - from."""
    supply: dict[int, list[list[int]]] = defaultdict(list)
    for part, h in sorted(parts.items()):
        for length, n in h.items():
            supply[length].append([part, 0, n])
    rows, first = [], 0
    for _, groups in pools:
        for bins, content in groups:
            offset = 0
            for length, fits in content:
                need, seen = bins * fits, 0
                while need:
                    source = supply[length][-1]
                    take = min(need, source[2] - source[1])
                    rows.append((source[0], length, source[1], source[1] + take, first, bins, offset, seen))
                    source[1] += take
                    seen += take
                    need -= take
                    if source[1] == source[2]:
                        supply[length].pop()
                offset += fits * length
            first += bins
    return rows, first


def pack(pieces: DataFrame, capacity: int = 1024, partitions: int = PARTITIONS, length_col: str = "length") -> DataFrame:
    """``pieces`` (any rows with a length from 1 to ``capacity``) with ``sequence_id`` (any numbers; those of full pieces are
    negative) and ``offset``, gapless from 0.

    The order inside a sequence is free.  ``pieces`` is written to the checkpoint folder once, so that everything
    below sees the same rows; pass what you need of them and no more.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    taken = list(columns)
    names = {}
    for n in ("size_", "part_", "row_", "salt_", "rank_", "before_", "own_", "ranges_"):
        names[n[:-1]] = fresh_name(taken, n)
        taken.append(names[n[:-1]])
    size, part, row, salt, rank, before, own, ranges = names.values()
    kept = [F.col(f"`{c}`") for c in columns]
    length = F.col(f"`{length_col}`").cast("long")
    wrong = F.raise_error(F.lit(f"lengths must be from 1 to {capacity}")).cast("long")
    dealt = checkpointed(
        pieces.select(*kept).select(
            *kept,
            F.when(length.between(1, capacity), length).otherwise(wrong).alias(size),
            F.pmod(F.xxhash64(*kept), F.lit(partitions)).cast("int").alias(part),
            F.monotonically_increasing_id().alias(row),
        )
    )
    full = dealt.filter(F.col(size) == capacity).select(*kept, (-1 - F.col(row)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = dealt.filter(F.col(size) < capacity)
    counted = rest.groupBy(part, size).agg(F.count(F.lit(1)).alias("n")).toArrow()  # partitions x capacity rows at most
    parts: dict[int, dict[int, int]] = defaultdict(dict)
    for p, x, n in zip(*(c.to_pylist() for c in counted.columns), strict=True):
        parts[p][x] = n
    rows, _ = _plan(parts, repack([h for _, h in sorted(parts.items())], capacity))

    fields = {"part": "int", "length": "long", "low": "long", "high": "long", "first": "long", "bins": "long", "at": "long", "seen": "long"}
    cells = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    arrow = pa.table({n: pa.array(c, pa.int32() if t == "int" else pa.int64()) for (n, t), c in zip(fields.items(), cells, strict=True)})
    # One row of the plan for each (part, length), with its ranges inside: an equi-join, not a range join.
    plan = (
        spark.createDataFrame(arrow, ", ".join(f"{n} {t}" for n, t in fields.items()))
        .groupBy(F.col("part").alias(part), F.col("length").alias(size))
        .agg(F.sort_array(F.collect_list(F.struct(*list(fields)[2:]))).alias(ranges))
    )
    # A second, independent number splits what has the same length in one partition.
    salts = max(1, -(-max((n for h in parts.values() for n in h.values()), default=0) // RANKED))
    salted = rest.withColumn(salt, F.pmod(F.xxhash64(F.lit(1), row), F.lit(salts)).cast("int"))
    ahead = Window.partitionBy(part, size).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy(part, size, salt)
        .agg(F.count(F.lit(1)).alias(rank))
        .select(part, size, salt, F.coalesce(F.sum(rank).over(ahead), F.lit(0)).alias(before))
        .join(plan, [part, size])
    )
    inside = Window.partitionBy(part, size, salt).orderBy(row)
    ranked = salted.withColumn(rank, F.row_number().over(inside).cast("long") - 1).join(starts, [part, size, salt])
    at = F.col(before) + F.col(rank)
    placed = ranked.withColumn(rank, at).withColumn(
        own, F.element_at(F.filter(ranges, lambda x: (x["low"] <= F.col(rank)) & (F.col(rank) < x["high"])), 1)
    )
    nth = F.col(f"{own}.seen") + F.col(rank) - F.col(f"{own}.low")
    bins = F.col(f"{own}.bins")
    return placed.select(
        *kept,
        (F.col(f"{own}.first") + F.pmod(nth, bins)).alias("sequence_id"),
        (F.col(f"{own}.at") + F.floor(nth / bins).cast("long") * F.col(size)).alias("offset"),
    ).unionByName(full)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, **options) -> DataFrame:
    """One row per piece with its digest and place: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.  For the ids themselves join ``tokenize`` on (id, piece), or pack its rows whole."""
    pieces = tokenize(docs, id_col, text_col, capacity, **options)
    return pack(pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
