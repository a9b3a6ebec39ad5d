"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers.

Normalisation: A-Z lower-cased, words are runs of 0-9, a-z and non-ASCII characters.  Every run of ``window`` words of
an item is a pattern (an item of fewer words, but not none, is one pattern as a whole).  The automaton's symbols are
words, each written as two characters; a word that no item has leads back to its root.  A text is scanned once; matches are
word ranges, which are mapped to character offsets of the original only where there is a match.

Memory.  A window of ten words is twenty nodes at most, whatever the words' length.  Items are cut into slices that keep
every window, and dealt into blocks of about ``max_nodes`` nodes (64 bytes each, and as much again for the patterns, in
each worker).  What is broadcast are the words of one block, a few megabytes; the driver holds one block's at a
time.  One block is the usual case.  With more, each is scanned for in a job of its own, which writes down what it
found by the text's MD5, so that no worker holds two automata; the matches of all blocks are then united.

Odd input: a null or empty text has no words and no hits; items that are null or have no words have no pattern; an
item without an id marks words as hit but is not listed; ids are listed in their own type where that is an integer or a string, ids of
other types as strings; repeated items are listed once per id; repeated documents get the same result each; empty tables give no rows or no hits; additional columns stay as they are, whatever their
names: where ``into`` is taken, the result's name gets underscores until it is free.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ascii_lower, checkpointed, fresh_name, small_batches

#: A word in an original text, where capitals are not lower-cased yet.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: The same in a text that is lower-cased.
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows in a slice of an item; parts into which copies of one text are dealt.
SLICE, SALTS = 4096, 16
_KEEP = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def result_type(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(id_type)),
            T.StructField("word_runs", T.ArrayType(SPAN)),
            T.StructField("spans", T.ArrayType(SPAN)),
        ]
    )


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_KEEP).split()


Id = int | str
Slice = tuple[Id | None, str]  # an item's id and some of its words, with a blank between them


class Scanner:
    """The automaton, built once per worker process."""

    _built: dict[str, Scanner] = {}

    def __init__(self, slices: Iterable[Slice], window: int):
        import ahocorasick

        items = [(item, text.encode("utf-8").split()) for item, text in slices]
        known = dict.fromkeys(w for _, words in items for w in words)
        # Two characters a word, of alphabets apart: a node's children are searched one by one, and the root has one for
        # each first character.
        base = 1 + int(len(known) ** 0.5)
        self.symbol = {w: chr(1 + k // base) + chr(2 + base + k % base) for k, w in enumerate(known)}
        found: dict[str, set] = {}
        for item, words in items:
            line = "".join([self.symbol[w] for w in words])
            for k in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(line[2 * k : 2 * (k + window)], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        self.empty = not found
        self.shortest = min(map(len, found), default=0) // 2
        for key, ids in found.items():
            self.automaton.add_word(key, (len(key) // 2, tuple(sorted(i for i in ids if i is not None))))
        self.automaton.make_automaton()

    @classmethod
    def of(cls, name: str, slices, window: int) -> Scanner:
        if name not in cls._built:
            cls._built.clear()  # one block at a time stays in memory
            cls._built[name] = cls(slices.value, window)
        return cls._built[name]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[Id]]:
        """Words in the text, word ranges that matched (end exclusive), items found."""
        words = _words(text) if text else []
        if len(words) < self.shortest or self.empty or not words:
            return len(words), [], set()
        line = "".join(map(self.symbol.get, words, repeat("\0\0")))  # no item has that word
        runs, items = [], set()
        for end, (length, ids) in self.automaton.iter(line):
            word = (end + 1) // 2
            runs.append((word - length, word))
            items.update(ids)
        return len(words), runs, items


def united(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original of word ranges."""
    starts, ends = {a for a, _ in runs}, {b - 1 for _, b in runs}
    at_start, at_end = {}, {}
    for k, m in enumerate(WORD.finditer(text)):
        if k in starts:
            at_start[k] = m.start()
        if k in ends:
            at_end[k] = m.end()
    return [(at_start[a], at_end[b - 1]) for a, b in runs]


def _result(text: str | None, n: int, runs: Iterable[tuple[int, int]], items: Iterable[Id]) -> dict:
    runs = united(runs)
    return {
        "n_words": n,
        "n_hit": sum(e - s for s, e in runs),
        "items": sorted(items),
        "word_runs": [{"start": s, "end": e} for s, e in runs],
        "spans": [{"start": s, "end": e} for s, e in _offsets(text, runs)] if runs else [],
    }


def _scan_column(slices, name: str, window: int, kind: T.StructType):
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def scan(texts: pa.Array) -> pa.Array:
        scanner = Scanner.of(name, slices, window)
        out = []
        for t in texts:
            text = t.as_py()
            out.append(_result(text, *scanner.scan(text)))
        return pa.array(out, arrow)

    return scan


def _united_column(kind: T.StructType):
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def unite(texts: pa.Array, found: pa.Array) -> pa.Array:
        """The results of several blocks (null where no block found anything) as one."""
        out = []
        for t, own in zip(texts, found, strict=True):
            text, own = t.as_py(), own.as_py() or []
            runs = [(r["start"], r["end"]) for x in own for r in x["word_runs"]]
            out.append(_result(text, len(_words(text or "")), runs, {i for x in own for i in x["items"]}))
        return pa.array(out, arrow)

    return unite


def _id_type(of: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(of, T.IntegralType) else T.StringType()


def _slices(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words, nodes): the items in slices of at most ``SLICE`` windows, so that each window is in one of them."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(LOWER_WORD), F.lit(0))
    item = F.col(item_col).cast(_id_type(benchmark.schema[item_col].dataType))
    items = benchmark.select(item.alias("item"), words.alias("w")).filter(F.size("w") > 0).distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(SLICE))
    each = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(SLICE + window - 1)).alias("w"))
    nodes = F.greatest(F.size("w") - window + 1, F.lit(1)) * F.least(F.size("w"), F.lit(window)) * 2
    return each.select("item", F.array_join("w", " ").alias("words"), nodes.cast("long").alias("nodes"))


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    into: str = "hits",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    max_nodes: int = 2_000_000,
) -> DataFrame:
    """``docs`` with a struct column ``into``: ``n_words``, ``n_hit`` (words inside a match), ``items`` (ids found,
    ascending), ``word_runs`` (matched word ranges, united) and ``spans`` (the same as character offsets of the
    original text, end exclusive)."""
    spark = small_batches(docs).sparkSession
    into = fresh_name(docs.columns, into)
    slices = checkpointed(_slices(benchmark, item_col, item_text_col, window))
    nodes = slices.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-nodes // max_nodes))
    text = F.col(f"`{text_col}`").cast("string")
    kind = result_type(_id_type(benchmark.schema[item_col].dataType))

    def scan(k: int, col: Column) -> Column:
        block = slices.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else slices
        shared = spark.sparkContext.broadcast([(r["item"], r["words"]) for r in block.toLocalIterator()])
        return _scan_column(shared, f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}", window, kind)(col)

    if blocks == 1:
        return docs.select("*", scan(0, text).alias(into))
    found = None
    for k in range(blocks):
        digest = F.md5(F.col("text"))
        own = docs.select(text.alias("text")).select(digest.alias("digest"), scan(k, F.col("text")).alias("own"))
        own = checkpointed(own.filter("own.n_hit > 0").dropDuplicates(["digest"]))
        found = own if found is None else found.unionByName(own)
    merged = found.groupBy("digest").agg(F.collect_list("own").alias("own"))  # a row of each block at most
    names = [fresh_name([*docs.columns, into], n) for n in ("digest_", "salt_", "own_")]
    digest, salt, own = names
    # Copies of one text are dealt over salts, and so is what was found in it.
    salted = docs.select("*", F.md5(text).alias(digest), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias(salt))
    told = merged.select(F.col("digest").alias(digest), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.col("own").alias(own))
    return salted.join(told, [digest, salt], "left").select(*[F.col(f"`{c}`") for c in docs.columns], _united_column(kind)(text, own).alias(into))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without any hit, with their columns as they were."""
    name = fresh_name(docs.columns, "hits")
    return with_hits(docs, benchmark, into=name, **options).filter(F.col(f"{name}.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
