"""Sequence rewrite: fusing pairs, applying ordered rules, undoing them, and what a merge changes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_id, id_char
from .merging import Merger, expansions

Rule = tuple[int, int, int]


def rule_strings(rule: Rule) -> tuple[str, str]:
    a, b, new = rule
    return id_char(a) + id_char(b), id_char(new)


def fuse(seq: Column, rule: Rule) -> Column:
    """One left-to-right, non-overlapping pass."""
    pair, new = rule_strings(rule)
    return F.replace(seq, F.lit(pair), F.lit(new))


def apply_rules(seq: Column, rules: Sequence[Rule], engine: str = "arrow") -> Column:
    """All rules in learned order.

    ``sql`` folds ``replace`` over a literal array inside the JVM, a pass for each rule; ``arrow`` merges Arrow batches by
    rank (``merging``), with work that follows the fusions and not the number of rules.  Both give the same sequence.
    """
    if not rules:
        return seq
    if engine == "sql":
        strings = [rule_strings(r) for r in rules]
        table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in strings])
        return F.aggregate(table, seq, lambda acc, r: F.replace(acc, r["p"], r["n"]))
    if engine != "arrow":
        raise ValueError("engine must be 'sql' or 'arrow'")

    rules = list(rules)

    @F.arrow_udf(T.StringType())
    def merged_seqs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merger = Merger(rules)
        for seqs in batches:
            yield pa.array(merger.apply(seqs.to_pylist()), pa.string())

    return merged_seqs(seq)


def undo_rules(seq: Column, rules: Sequence[Rule]) -> Column:
    """Every learned token back to bytes; reserved tokens stay.  One look-up a token, whatever the number of rules."""
    if not rules:
        return seq
    rules = list(rules)

    @F.arrow_udf(T.StringType())
    def expand(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = expansions(rules)
        for seqs in batches:
            yield pa.array([s and s.translate(table) for s in seqs.to_pylist()], pa.string())

    return expand(seq)


def greedy_any(ids: list[int], rules: Sequence[Rule]) -> list[int]:
    """Passes that fuse any known pair at each position, until nothing changes; not the same as ordered rules."""
    known = {(a, b): new for a, b, new in rules}
    while True:
        out, i = [], 0
        while i < len(ids):
            new = known.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
            out.append(ids[i] if new is None else new)
            i += 1 if new is None else 2
        if len(out) == len(ids):
            return out
        ids = out


def apply_greedy(seq: Column, rules: Sequence[Rule]) -> Column:
    """``greedy_any`` over a sequence column."""

    @F.arrow_udf(T.StringType())
    def passes(seqs: pa.Array) -> pa.Array:
        return pa.array(
            [s and "".join(map(id_char, greedy_any([char_id(c) for c in s], rules))) for s in seqs.to_pylist()], pa.string()
        )

    return passes(seq)


def merged(before: Column, after: Column) -> Column:
    """Occurrences that a pass fused."""
    return (F.char_length(before) - F.char_length(after)).cast("long")


def live_length(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    return seqs.agg(F.coalesce(F.sum(F.char_length(seq)), F.lit(0)).cast("long").alias("length"))


def prefix(seqs: DataFrame, n: int, order: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The first n tokens of the corpus in document order.  Only documents that can hold a part of them are kept: the
    smallest n by order whose sequence is not empty, each cut to n tokens before anything is sorted."""
    cut = seqs.filter(F.char_length(seq) > 0).select(order, F.substring(seq, 1, n).alias(seq))
    first = cut.orderBy(order).limit(n)
    from pyspark.sql import Window

    # One window over at most n short rows.
    ahead = F.coalesce(
        F.sum(F.char_length(seq)).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        first.withColumn("ahead", ahead)
        .filter(F.col("ahead") < n)
        .select(order, F.substring(seq, F.lit(1), (n - F.col("ahead")).cast("int")).alias(seq))
    )
