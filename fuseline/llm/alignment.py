"""Alignment of two tokenizers: which of their tokens cover the same bytes, and how often over the corpus.

Each text is tokenised by A (byte-level BPE over a space and the text, special strings as plain text) and by B
(SentencePiece pieces, which puts the space in front itself).  Both cut the same bytes, so:

* a *group* ends where tokens of both end at the same byte;
* a *link* is a pair of an A and a B token whose bytes overlap.  Between two neighbouring ends, of either side, lies
  exactly one token of each side, so a merge of the two ascending lists of ends meets every link once.

Plan.  ``mapInArrow`` (as ``mapInPandas``, without the detour through pandas objects) tokenises portions of bounded size
and merges the cumulative ends of a whole portion at once: texts lie one behind the other, and since both sides cover
a text's bytes, the ends stay in step.  It emits a row for each text, with its groups' digest and its distinct id
pairs.  These rows are written once to the shared folder.  ``groupBy`` on the id pair sums the counts (pre-summed in each
task), a second one takes each B id's maximum, and both are joined back to the texts' pairs and summed for each text.

Scale and skew.  What goes back is the table of distinct id pairs.  Up to ``BROADCAST_ROWS`` (counted) it is broadcast;
beyond, the pairs that occur most (as many as fit the bound) are broadcast and only rows of the others meet their
counts in a shuffle, where no key can be hot, as every one of them is rarer than half a million others.

Odd input: null and empty texts, and texts whose token bytes are not the text's (those with U+2581), have no tokens:
zeros and the empty digest.  Rows without an id, with repeated ids or repeated texts are rows of their own, each counted; of B ids
whose highest count is reached by several pairs all are best; texts of any length are read whole; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch
from .common import BROADCAST_ROWS, checkpointed, joined_back
from .packing import Tokens
from .pieces import MODEL, PieceModel, path_of

#: Bytes of text that are aligned at a time, about.
PORTION = 1 << 19


class PlainTokens(Tokens):
    """Byte-level ids; strings of special tokens are plain text."""

    _loaded: dict[str, Tokens] = {}

    def __init__(self, path: str, ranks_path: str | None):
        super().__init__(path, ranks_path)
        self.whole.encode_special_tokens = True
        self.special = lambda text: None
        # An entry has one character a byte: printable ones stand for themselves, the others for 256, 257, ... in order.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        entries = self.whole.get_vocab()
        self.raw = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.raw[k] = bytes(byte.get(c, 0x20) for c in entry)


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merges two ascending lists of ends (the last ones equal): every end once, the A token and the B token that lie
    before it, and whether a token of A, and one of B, ends there."""
    both = np.concatenate([ends_a, ends_b])
    order = np.argsort(both, kind="stable")  # two runs in order, which this sort merges
    ends, from_a = both[order], order < len(ends_a)
    again = np.append(ends[1:] == ends[:-1], False)  # of two equal ends A's comes first, and B's stands for both
    kept = ~again
    stop_a, stop_b = (from_a | np.append(False, again[:-1]))[kept], ~from_a[kept]
    passed_a, passed_b = np.cumsum(stop_a), np.cumsum(stop_b)
    return ends[kept], passed_a - stop_a, passed_b - stop_b, stop_a, stop_b


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``size`` (zero bytes for leading zeros), and how many they are."""
    width = len(str(max(size - 1, 1)))
    numbers = np.arange(size)
    cells = np.stack([numbers // 10**k % 10 + 48 for k in range(width - 1, -1, -1)], axis=1).astype(np.uint8)
    for k in range(width - 1):
        cells[numbers < 10 ** (width - 1 - k), k] = 0
    return cells, (cells != 0).sum(axis=1)


def align(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray, digits: tuple[np.ndarray, np.ndarray]):
    """Aligns texts given by their ids on both sides (each text has tokens, and the same bytes on both sides): for each
    text the numbers of groups and links and the groups' digest, and as arrays (text, a, b, n) its distinct id pairs.
    ``digits``: ``decimals`` for all ids."""
    a, b = np.concatenate(a_ids).astype(np.int64), np.concatenate(b_ids).astype(np.int64)
    n_a, n_b = np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])
    ends_a, ends_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    ends, at_a, at_b, stop_a, stop_b = merge_ends(ends_a, ends_b)
    shared = stop_a & stop_b
    until = np.searchsorted(ends, ends_a[np.cumsum(n_a) - 1], side="right")
    links, groups = np.diff(until, prepend=0), np.diff(np.cumsum(shared)[until - 1], prepend=0)

    text = np.repeat(np.arange(len(a_ids)), links)
    key = (text * len(a_size) + a[at_a]) * len(b_size) + b[at_b]
    pairs, times = np.unique(key, return_counts=True)
    owner, pair_a, pair_b = pairs // (len(a_size) * len(b_size)), pairs // len(b_size) % len(a_size), pairs % len(b_size)

    # In the digest's line A's ids of a group come before B's.
    last_a, last_b = shared[stop_a], shared[stop_b]  # for each token, whether its group ends with it
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    of_a, of_b = np.bincount(group_a), np.bincount(group_b)
    line, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    place_a, place_b = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a], np.arange(len(b)) + np.cumsum(of_a)[group_b]
    line[place_a], line[place_b] = a, b
    marks[place_a] = np.where(last_a, ord("|"), ord(","))
    marks[place_b] = np.where(last_b, ord(";"), ord(","))
    marks[np.cumsum(n_a + n_b) - 1] = 0
    cells, sizes = digits
    listed = np.concatenate([cells[line], marks[:, None]], axis=1)
    data = listed[listed != 0]
    cuts = np.append(0, np.cumsum(sizes[line] + (marks != 0))[np.cumsum(n_a + n_b) - 1])
    digests = [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return groups, links, digests, (owner, pair_a, pair_b, times)


def _portions(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in order, in lists of about ``PORTION`` characters, each with its first position."""
    held, room, first = [], PORTION, 0
    for k, t in enumerate(texts):
        held.append(t.as_py())
        room -= 64 + len(held[-1] or "")
        if room <= 0:
            yield first, held
            held, room, first = [], PORTION, k + 1
    if held:
        yield first, held


def align_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    model: str = MODEL,
) -> DataFrame:
    """One row per text: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and ``pair_a``, ``pair_b``,
    ``pair_n`` (arrays of equal length): its linked id pairs and how often each is linked."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterable[pa.RecordBatch]):
        first = PlainTokens.of(path_of(tokenizer), ranks and path_of(ranks))
        second = PieceModel.of(path_of(model))
        size_a, size_b = (np.array([len(x) for x in side.raw], np.int64) for side in (first, second))
        digits = decimals(max(len(size_a), len(size_b)))

        for batch in batches:
            for at, texts in _portions(batch.column(1)):
                a_ids, b_ids, live = [], [], []
                for k, t in enumerate(texts):
                    if not t:
                        continue
                    line = f" {t}"
                    a, b = np.frombuffer(first.ids(line), np.uint32), second.encode(t)
                    whole = line.encode()
                    if b"".join(map(second.raw.__getitem__, b)) == whole == b"".join(map(first.raw.__getitem__, a.tolist())):
                        a_ids.append(a)
                        b_ids.append(np.array(b, np.int64))
                        live.append(k)
                n = len(texts)
                counts = np.zeros((4, n), np.int64)
                digests, sizes = [""] * n, np.zeros(n, np.int64)
                pairs = [np.zeros(0, np.int64)] * 3
                if live:
                    groups, links, own, (owner, *pairs) = align(a_ids, b_ids, size_a, size_b, digits)
                    counts[:, live] = [[len(x) for x in a_ids], [len(x) for x in b_ids], groups, links]
                    sizes[live] = np.bincount(owner, minlength=len(live))
                    for k, d in zip(live, own, strict=True):
                        digests[k] = d
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in pairs]
                yield pa.record_batch(
                    [batch.column(0).slice(at, n), *[pa.array(c) for c in counts], pa.array(digests), *lists],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair_a", "pair_b", "pair_n"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows,
        f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pair_a array<int>, pair_b array<int>, pair_n array<int>",
    )


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, cnt, best) from link rows (a, b, n): how often each id pair is linked, and whether no other pair of its B id is
    linked more often."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("cnt"))
    highest = counts.groupBy("b").agg(F.max("cnt").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "cnt", (F.col("cnt") == F.col("highest")).alias("best"))


def alignment_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_ROWS, **options) -> DataFrame:
    """One row per text: what ``align_tokens`` gives without the pairs, and ``n_best`` (links whose count is the highest of
    their B id) and ``count_sum`` (sum of the counts of all links)."""
    spark = docs.sparkSession
    folder = scratch(spark, "alignment")
    align_tokens(docs, id_col, text_col, **options).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    links = texts.select("row", F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")).select(
        "row", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").cast("long").alias("n")
    )
    counts = checkpointed(pair_counts(links))
    sums = (
        joined_back(links, counts, ["a", "b"], "cnt", most)
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("cnt")).alias("count_sum"))
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return (
        texts.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        .join(sums, "row", "left")
        .select("id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
    )
