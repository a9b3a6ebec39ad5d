"""A corpus in training: blocks of token ids, an index from pairs to blocks, and scans that open only what they need.

The sequences are dealt once, evenly, into at most ``MAX_BLOCKS`` blocks, each a partition folder of a Parquet table (ids as
16-bit integers, or 32-bit ones where they need it, a separator behind each sequence).  Rules taken since the table was written are *pending*: a scan
applies them by rank to the blocks it opens.  After ``cut_every`` of them the table is written anew with all of them
applied, and its predecessor is deleted.

A scan tells, for several rules in turn, how each changes the pair counts.  Inside a portion the ids carry links to their
neighbours and the places of every rule's pair wait under that rule, so that a rule costs its occurrences and not a pass.

The index has a row for each (pair, block) of the written table.  A pair of the present has its *anchor* there: itself, if both tokens
are older than the table, else the anchor of a token that is younger; for a fused token is only where its two parts were
neighbours, and fusing never makes older tokens neighbours.  So the blocks of the anchors hold all occurrences.  The index is built
when the occurrences looked for are fewer than half of the blocks, after which it serves until the next table;
for pairs that are nearly everywhere a scan opens all blocks.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merging import PAD, PORTION, Merger, by_rank, to_ids, to_seqs
from ..operators import pairs as P
from ..operators.rewrite import apply_rules
from ..sources.shared import remove, scratch, small_batches

Rule = tuple[int, int, int]
Pair = tuple[int, int]
MAX_BLOCKS, BLOCK_TOKENS = 1024, 1 << 19
#: Fewest and most ids by which the next merges are guessed, and the share of the corpus between them.
SAMPLE, MOST, SHARE = 1 << 18, 1 << 20, 5
#: Tokens of a row of the table, about, and rows of changes that a task holds before it adds them up.
ROW, HELD = 1 << 16, 1 << 18
#: Contexts that meet in a group, at most about; classes of a row of their counts.
GROUP, SLICE = 1 << 20, 1 << 16
ROWS = (pa.int32(), pa.int32(), pa.binary())
SHIFT, LOW = 21, (1 << 21) - 1
#: The separator among ids of 16 bits.
NARROW = 0xFFFF


def pair_keys(token: np.ndarray, after: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the pairs that begin at these places, without those that meet a separator."""
    left, right = token[at].astype(np.int64), token[after[at]].astype(np.int64)
    inside = (left != PAD) & (right != PAD)
    return left[inside] << SHIFT | right[inside]


def distinct_keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs of ids with separators, and how often each occurs."""
    left, right = ids[:-1], ids[1:]
    inside = (left != PAD) & (right != PAD)
    return np.unique(left[inside].astype(np.int64) << SHIFT | right[inside], return_counts=True)


def step_changes(ids: np.ndarray, rules: Sequence[Rule], window: int) -> tuple[np.ndarray, list[tuple]]:
    """The ids after all rules, and for each rule in turn: keys and differences of the pair counts, how many places it
    fuses, and (with ``window``) keys of the pairs whose contexts it changes."""
    none = np.zeros(0, np.int64)
    n = len(ids)
    found = [(none, none, 0, none)] * len(rules)
    if not n or not rules:
        return ids, found
    merger = Merger(rules)
    token = np.append(ids, PAD).astype(np.int32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[n] = n
    waiting: dict[int, list[np.ndarray]] = {}

    def wait(places: np.ndarray, ranks: np.ndarray) -> None:
        for r, own in by_rank(places, ranks):
            waiting.setdefault(r, []).append(own)

    wait(*merger.candidates(token[:n]))
    for t, (a, b, new) in enumerate(rules):
        if t not in waiting:
            continue
        parts = waiting.pop(t)
        at = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
        right = after[at]
        here = (token[at] == a) & (token[right] == b)
        at, right = at[here], right[here]
        if a == b and len(at):  # of a run of places every second one
            starts = np.flatnonzero(np.append(True, at[1:] != right[:-1])[: len(at)])
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            at, right = at[rank % 2 == 0], right[rank % 2 == 0]
        if not len(at):
            continue
        ahead, behind = before[at], after[right]
        touching = ahead[1:] == right[:-1]  # a fused place behind a fused place
        x, y = token[ahead[np.append(True, ~touching)]], token[behind[np.append(~touching, True)]]
        x, y = x[x != PAD], y[y != PAD]
        token[at], token[right] = new, -1
        after[at], before[behind] = behind, at
        found[t] = (*_differences((a, b, new), len(at), int(touching.sum()), x, y), len(at), none)
        if window:
            near, back, forth = np.zeros(n + 1, bool), at, at
            near[at] = True
            for k in range(window + 1):
                back = before[back]
                near[back] = True
                if k < window:
                    forth = after[forth]
                    near[forth] = True
            keys = pair_keys(token, after, np.flatnonzero(near))
            found[t] = (*found[t][:3], np.sort(pa.array(keys).unique().to_numpy()))
        x, y = token[before[at]], token[behind]
        left, follow = (x != PAD) & (x != new), y != PAD  # a pair of two new tokens is the follower of the one ahead
        for places, ranks in ((before[at[left]], merger.rank(x[left], np.int32(new))), (at[follow], merger.rank(np.int32(new), y[follow]))):
            later = ranks > t
            if later.any():
                wait(places[later], ranks[later])
    token = token[:n]
    return token[token >= 0], found


def _differences(rule: Rule, fused: int, touching: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and differences of the pair counts when a rule fuses so many places, of which some follow one another; ``x`` and ``y`` are the
    other tokens ahead and behind."""
    a, b, new = rule
    ahead, behind = np.bincount(x), np.bincount(y)
    before, after = np.flatnonzero(ahead), np.flatnonzero(behind)
    n, m = ahead[before], behind[after]
    keys = [before << SHIFT | a, before << SHIFT | new, b << SHIFT | after, new << SHIFT | after, np.array([a << SHIFT | b, b << SHIFT | a, new << SHIFT | new])]
    keys, where = np.unique(np.concatenate(keys), return_inverse=True)
    diff = np.bincount(where, weights=np.concatenate([-n, n, -m, m, [-fused, -touching, touching]]), minlength=len(keys)).astype(np.int64)
    return keys[diff != 0], diff[diff != 0]


def summed(held: list[np.ndarray]) -> np.ndarray:
    """Rows of (step, key, n, near) with equal step and key added up: the sum of n and the greatest near."""
    step, key, n, near = np.concatenate(held, axis=1)
    order = np.lexsort((key, step))
    step, key, n, near = step[order], key[order], n[order], near[order]
    first = np.flatnonzero(np.append(True, (step[1:] != step[:-1]) | (key[1:] != key[:-1])))
    return np.stack([step[first], key[first], np.add.reduceat(n, first), np.maximum.reduceat(near, first)])


def context_rows(held: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    """(pair, bucket, body) of contexts (pair, h1, h2): the hashes of a pair that fall into a bucket, one behind the other."""
    pair, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
    bucket = (two.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    own = pair.astype(np.int64) * buckets + bucket
    order = np.argsort(own, kind="stable")
    own, both = own[order], np.stack([one[order], two[order]], axis=1)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    bodies = [both[k:end].tobytes() for k, end in zip(starts, [*starts[1:], len(own)], strict=True)]
    columns = (own[starts] // buckets, own[starts] % buckets, bodies)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, ROWS, strict=True)], names=["pair", "bucket", "body"])


def context_counts(bodies: list[bytes]) -> np.ndarray:
    """How often each context of these bodies occurs."""
    one, two = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in bodies]).T
    order = np.argsort(one)
    same = one[order][1:] == one[order][:-1]
    if (same & (two[order][1:] != two[order][:-1])).any():
        order = np.lexsort((two, one))
    one, two = one[order], two[order]
    starts = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    return np.diff(np.append(starts, len(one)))


def entropy_of_counts(c: np.ndarray, m: np.ndarray) -> float:
    """Entropy of m contexts that occur c times each, summed in ascending order."""
    total, h = float((c * m).sum()), 0.0
    for k, n in zip(c.tolist(), m.tolist(), strict=True):
        h -= (k / total) * math.log(k / total + 1e-10) * n
    return h


def packed(ids: np.ndarray) -> bytes:
    """A row of the table: 16 bits an id and a last byte, where all ids are small enough, else 32 bits an id."""
    small = np.where(ids == PAD, NARROW, ids)
    if small.max(initial=0) > NARROW or (ids == NARROW).any():
        return ids.astype("<i4").tobytes()
    return small.astype("<u2").tobytes() + b"\0"


def unpacked(row: bytes) -> np.ndarray:
    """The ids of a row."""
    if len(row) % 2 == 0:
        return np.frombuffer(row, "<i4")
    ids = np.frombuffer(row, "<u2", len(row) // 2).astype(np.int32)
    ids[ids == NARROW] = PAD
    return ids


def joined(batches: Iterator[pa.RecordBatch], merger: Merger) -> Iterator[np.ndarray]:
    """The ids of rows in portions, pending rules applied."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for row in batch.column(0):
            held.append(unpacked(row.as_py()))
            size += len(held[-1])
            if size >= PORTION:
                yield merger.merge(np.concatenate(held))
                held, size = [], 0
    if held:
        yield merger.merge(np.concatenate(held))


class Blocks:
    """``seqs`` (doc_id, seq) of ``length`` tokens in training.  Tables go to ``folder``, or to a scratch folder; ``written`` is a
    table that is there already, with the rules ``done`` applied."""

    batch = 16

    def __init__(
        self,
        seqs: DataFrame,
        length: int,
        cut_every: int = 128,
        block_tokens: int = BLOCK_TOKENS,
        folder: str | None = None,
        written: str | None = None,
        done: Sequence[Rule] = (),
    ):
        self.spark, self.docs, self.cut_every = seqs.sparkSession, seqs, cut_every
        self.rules: list[Rule] = list(done)  # all that were taken
        self.pending: list[Rule] = []
        self.folder, self.keep = folder or scratch(self.spark, "training"), folder is not None
        self.stale: list[str] = []
        self.index: DataFrame | None = None
        self.sample: tuple[int, list[int]] | None = None
        self.guessed_by: np.ndarray | None = None
        #: Blocks opened and blocks there, over all scans.
        self.opened = self.there = 0
        self.tokens, self.count = length, min(MAX_BLOCKS, max(1, length // block_tokens))
        if written is not None:
            self.path, self.table = written, self._read(written)
            return

        count, room = self.count, min(ROW, max(block_tokens, length // self.count))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                texts = [t for t in batch.column(0).to_pylist() if t]
                k = 0
                while k < len(texts):
                    end, size = k, 0
                    while end < len(texts) and size < room:
                        size += len(texts[end])
                        end += 1
                    row = packed(to_ids(texts[k:end]))
                    block = (zlib.crc32(row) if block is None else block + 1) % count  # a task deals its rows in turn
                    yield pa.record_batch([pa.array([row], pa.large_binary()), pa.array([block], pa.int32())], names=["ids", "block"])
                    k = end

        self._write(small_batches(seqs.select("seq")).mapInArrow(pack, "ids binary, block int").repartition(self.count, "block"))

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("ids binary, block int").parquet(path)

    def _write(self, rows: DataFrame) -> None:
        path = f"{self.folder}/blocks-{uuid.uuid4().hex}"
        rows.write.option("parquet.enable.dictionary", "false").partitionBy("block").parquet(path)
        if hasattr(self, "path"):
            self.stale.append(self.path)
        self.path, self.table = path, self._read(path)
        if not self.keep:  # else only when a manifest names the new table
            self.drop_stale()

    def drop_stale(self) -> None:
        for path in self.stale:
            remove(self.spark, path)
        self.stale = []

    # ------------------------------------------------------------------------------------------ scans

    def _map(self, rows: DataFrame, work, schema: str) -> DataFrame:
        pending = list(self.pending)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from work(joined(batches, Merger(pending)))

        return self._few(rows.select("ids")).mapInArrow(run, schema)

    def _few(self, rows: DataFrame) -> DataFrame:
        """``rows`` in a few tasks a core: a block alone is often too little for a task."""
        return small_batches(rows).coalesce(2 * self.spark.sparkContext.defaultParallelism)

    def live(self) -> DataFrame:
        """(seq): the sequences as they are now."""

        def texts(portions: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for ids in portions:
                yield pa.record_batch([pa.array(to_seqs(ids), pa.string())], names=["seq"])

        return self._map(self.table, texts, "seq string")

    def pair_counts(self) -> list[tuple[int, int, int]]:
        def counted(portions: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for ids in portions:
                keys, n = distinct_keys(ids)
                yield pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "n"])

        found = self._map(self.table, counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        keys, n = (c.to_numpy() for c in found.columns)
        return list(zip((keys >> SHIFT).tolist(), (keys & LOW).tolist(), n.tolist(), strict=True))

    def anchor(self, pair: Pair) -> Pair:
        """A pair of the written table without which ``pair`` cannot be in a block."""
        young = {new: (a, b) for a, b, new in self.pending}
        while True:
            parts = young.get(pair[0]) or young.get(pair[1])
            if parts is None:
                return pair
            pair = parts

    def holding(self, pairs: Sequence[Pair]) -> list[int]:
        """The blocks that hold one of these pairs of the written table, from the index."""
        if self.index is None:

            def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row, block in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                        own, _ = distinct_keys(unpacked(row.as_py()))
                        yield pa.record_batch([pa.array(own), pa.array(np.full(len(own), block, np.int32))], names=["key", "block"])

            path = f"{self.path}-index"
            self._few(self.table.select("ids", "block")).mapInArrow(keys, "key long, block int").distinct().orderBy("key").write.parquet(path)
            self.index = self.spark.read.schema("key long, block int").parquet(path)
        wanted = [int(a << SHIFT | b) for a, b in pairs]
        return [r["block"] for r in self.index.filter(F.col("key").isin(wanted)).select("block").distinct().collect()]  # MAX_BLOCKS at most

    def changes(self, rules: Sequence[Rule], window: int, occurrences: int | None = None) -> list[tuple]:
        """For each rule in turn: the pair counts' differences, the places fused and the pairs with new contexts.
        ``occurrences`` bounds how often the rules' pairs occur, where that is known."""
        rules, rows = list(rules), self.table
        self.there += self.count
        if occurrences is not None and occurrences < self.count // 2:
            young = {r[2] for r in rules}
            blocks = self.holding(sorted({self.anchor(r[:2]) for r in rules if not young & set(r[:2])}))
            rows = rows.filter(F.col("block").isin(blocks))
            self.opened += len(blocks)
        else:
            self.opened += self.count

        def work(portions: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for ids in portions:
                for t, (keys, diff, fused, dirty) in enumerate(step_changes(ids, rules, window)[1]):
                    for k, d, kind in ((keys, diff, 0), ([-1], [fused], 0), (dirty, 0, 1)):
                        held.append(np.empty((4, len(k)), np.int64))
                        held[-1][0], held[-1][1], held[-1][2], held[-1][3] = t, k, d, kind
                        size += len(k)
                if size > HELD:
                    held = [summed(held)]
                    size = 2 * held[0].shape[1]  # what cannot be added up is not tried again at once
                    if size > HELD:
                        yield pa.record_batch([pa.array(c) for c in held[0]], names=["step", "key", "n", "near"])
                        held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(c) for c in summed(held)], names=["step", "key", "n", "near"])

        table = (
            self._map(rows, work, "step long, key long, n long, near long")
            .groupBy("step", "key")
            .agg(F.sum("n").alias("n"), F.max("near").alias("near"))
            .filter("n <> 0 or near <> 0")
            .toArrow()  # the pairs that these rules change
        )
        step, key, n, near = (c.to_numpy() for c in table.columns)
        out = []
        for t in range(len(rules)):
            own = step == t
            k, d, z = key[own], n[own], near[own]
            pairs = (k >= 0) & (d != 0)
            kp = k[pairs]
            dirty = k[(k >= 0) & (z != 0)]
            out.append(
                (
                    list(zip((kp >> SHIFT).tolist(), (kp & LOW).tolist(), d[pairs].tolist(), strict=True)),
                    int(d[k < 0].sum()),
                    set(zip((dirty >> SHIFT).tolist(), (dirty & LOW).tolist(), strict=True)),
                )
            )
        return out

    # ------------------------------------------------------------------------------------------ rules

    def accept(self, rules: Sequence[Rule], length: int | None = None) -> bool:
        """Takes rules, which leave ``length`` tokens; true when the table was written anew: with ``cut_every`` rules, or when
        two fifths of its tokens are gone (writing it costs two to four scans)."""
        self.rules += rules
        self.pending += rules
        if self.guessed_by is not None and rules:
            self.guessed_by = Merger(rules).merge(self.guessed_by)
        if self.sample is not None and rules:
            self.sample = (self.sample[0], Merger(rules).merge(np.array(self.sample[1], np.int32)).tolist())
        if not self.pending or len(self.pending) < self.cut_every and (length is None or length > 0.6 * self.tokens):
            return False
        self.tokens = self.tokens if length is None else length
        self.cut()
        return True

    def begin(self, rules: Sequence[Rule]) -> int:
        """Takes the rules of an earlier training and writes the table with them; the number of tokens that they leave."""
        self.rules, self.pending = list(rules), list(rules)
        self.cut()

        def lengths(portions: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            yield pa.record_batch([pa.array([sum(int((ids != PAD).sum()) for ids in portions)], pa.int64())], names=["n"])

        self.tokens = self._map(self.table, lengths, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).first()["n"]
        return self.tokens

    def cut(self) -> None:
        """Writes the table with all pending rules applied, and drops the one before and its index."""
        pending = list(self.pending)

        def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merger, held, size, at = Merger(pending), [], 0, -1

            def fused() -> Iterator[pa.RecordBatch]:
                ids = merger.merge(np.concatenate(held))
                ends = np.flatnonzero(ids == PAD) + 1  # rows end where sequences do
                cuts = [0, *ends[np.flatnonzero(np.diff(ends // ROW))].tolist(), len(ids)]
                rows = [packed(ids[k:end]) for k, end in zip(cuts, cuts[1:]) if k < end]
                yield pa.record_batch([pa.array(rows, pa.large_binary()), pa.array([at] * len(rows), pa.int32())], names=["ids", "block"])

            for batch in batches:
                for row, block in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    if held and (block != at or size >= PORTION):
                        yield from fused()
                        held, size = [], 0
                    held.append(unpacked(row.as_py()))
                    size, at = size + len(held[-1]), block
            if held:
                yield from fused()

        if self.index is not None:
            self.stale.append(f"{self.path}-index")
            self.index = None
        self._write(self._few(self.table.select("ids", "block")).mapInArrow(applied, "ids binary, block int"))
        self.pending = []

    def some(self) -> np.ndarray:
        """A quarter to one million ids, by which the next merges are guessed; a few rows of the table."""
        if self.guessed_by is None:
            few = min(MOST, max(SAMPLE, self.tokens >> SHARE)) // ROW
            rows = [unpacked(r["ids"])[:ROW] for r in self.table.select("ids").limit(few).collect()]
            self.guessed_by = Merger(self.pending).merge(np.concatenate(rows)) if rows else np.zeros(0, np.int32)
        return self.guessed_by

    def first(self, n: int) -> list[int]:
        """The first n tokens in document order.  Whole documents are kept in the driver, as few as hold them."""
        while self.sample is None or 0 <= self.sample[0] and sum(t != PAD for t in self.sample[1]) < n:
            few = max(4, n // 25) if self.sample is None else 4 * self.sample[0]
            # Ids alone at first: no other document's sequence is computed.
            head = self.docs.select("doc_id").orderBy("doc_id").limit(few).agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).first()
            upto = self.docs.filter((F.col("doc_id") <= F.lit(head["last"])) | F.col("doc_id").isNull()).orderBy("doc_id").limit(few)
            ids = to_ids([r["seq"] for r in upto.collect() if r["seq"]])
            self.sample = (-1 if head["n"] < few else few, Merger(self.rules).merge(ids).tolist())
        return [t for t in self.sample[1] if t != PAD][:n]

    def entropies(self, wanted: Sequence[Pair], window: int, classes: dict[Pair, int] | None = None) -> dict[Pair, float]:
        """Context entropies of the ``wanted`` pairs and, from the same scan, those of the pairs of ``classes`` with their contexts thrown
        together in so many classes (powers of two).  Exact ones shuffle 16 bytes an occurrence, in rows of many, the others a count for
        each class of a task; what comes back says how many contexts of a pair occur so many times."""
        classes = classes or {}
        pairs = [*wanted, *classes]
        if not pairs:
            return {}
        masks = np.array([n - 1 for n in classes.values()], np.uint64)
        first = np.cumsum([0, *classes.values()])
        buckets = max(1, -(-self.tokens // GROUP))  # no pair has more contexts than tokens

        def work(portions: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            of, seen = Merger([(*p, 0) for p in pairs]), np.zeros(int(first[-1]), np.int64)
            held, size, kept, room = [], 0, [], max(len(seen), HELD)
            for ids in portions:
                places, ranks = of.candidates(ids)
                exact = ranks < len(wanted)
                if exact.any():
                    held.append((ranks[exact].astype(np.int32), *P.context_keys(ids, places[exact], window)))
                    size += len(held[-1][0])
                    if size >= HELD:
                        yield context_rows(held, buckets)
                        held, size = [], 0
                if classes:
                    ranks = ranks[~exact].astype(np.int64) - len(wanted)
                    kept.append(first[ranks] + (P.context_classes(ids, places[~exact], window) & masks[ranks]).astype(np.int64))
                    room -= len(ranks)
                    if room <= 0:
                        seen += np.bincount(np.concatenate(kept), minlength=len(seen))
                        kept, room = [], max(len(seen), HELD)
            if held:
                yield context_rows(held, buckets)
            if kept:
                seen += np.bincount(np.concatenate(kept), minlength=len(seen))
            slices = [(k, seen[k : k + SLICE]) for k in range(0, len(seen), SLICE)]
            found = [(-1, k // SLICE, x.tobytes()) for k, x in slices if x.any()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 3, ROWS, strict=True)], names=["pair", "bucket", "body"])

        def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []

            def counted() -> Iterator[pa.RecordBatch]:
                pair, bucket = at
                if pair < 0:
                    seen = np.sum([np.frombuffer(x, np.int64) for x in held], axis=0)
                    cuts = first - bucket * SLICE
                    parts = [(len(wanted) + k, seen[max(0, cuts[k]) : max(0, cuts[k + 1])]) for k in range(len(classes))]
                else:
                    parts = [(pair, context_counts(held))]
                for k, counts in parts:
                    c, m = np.unique(counts[counts > 0], return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(c), k, np.int32)), pa.array(c.astype(np.int64)), pa.array(m.astype(np.int64))], names=["pair", "c", "m"])

            for batch in batches:
                for pair, bucket, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at != (pair, bucket):
                        if held:
                            yield from counted()
                        at, held = (pair, bucket), []
                    held.append(body)
            if held:
                yield from counted()

        rows = self._map(self.table, work, "pair int, bucket int, body binary").repartition("pair", "bucket").sortWithinPartitions("pair", "bucket")
        found = rows.mapInArrow(kinds, "pair int, c long, m long").groupBy("pair", "c").agg(F.sum("m").alias("m")).toArrow()  # a row for each count of a pair
        pair, c, m = (x.to_numpy() for x in found.columns)
        order = np.lexsort((c, pair))
        pair, c, m = pair[order], c[order], m[order]
        cuts = np.searchsorted(pair, np.arange(len(pairs) + 1))
        return {p: entropy_of_counts(c[k:end], m[k:end]) for p, k, end in zip(pairs, cuts, cuts[1:]) if k < end}

    def seqs(self) -> DataFrame:
        return self.docs.filter(F.col("seq").isNotNull()).withColumn("seq", apply_rules(F.col("seq"), self.rules))
