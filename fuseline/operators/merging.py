"""Ordered rules applied at once: many sequences together, only rules that occur, only where they occur.

Applying rules in learned order is one pass over the text for each rule, so its cost grows with the vocabulary.  Here
the sequences of a portion lie one behind the other as arrays with links to the neighbours, and the places of every pair
that some rule fuses wait under that rule's rank.  The lowest waiting rank comes next: all its places are fused
together, left to right without overlap, and the pairs that this makes wait under their own, higher ranks.  The work
is that of the fusions, plus a few array calls for each rule that occurs in the portion; the result is that of the passes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np

from ..functions.text import id_char

Rule = tuple[int, int, int]
PAD = 0x110000  # no token has it
#: Tokens of a portion, about; its arrays stay in a core's cache.  Cells of the largest table of ranks.
PORTION, GRID = 1 << 19, 1 << 20


def to_ids(seqs: Sequence[str]) -> np.ndarray:
    """Token ids of all sequences, a separator after each."""
    joined = np.frombuffer("\ud800".join([*seqs, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    return np.where(joined == 0xD800, PAD, np.where(joined >= 0xE000, joined - 0x800, joined)).astype(np.int32)


def to_seqs(ids: np.ndarray) -> list[str]:
    """The sequences of ids with a separator after each."""
    codes = np.where(ids == PAD, 0xD800, np.where(ids >= 0xD800, ids + 0x800, ids)).astype("<u4")
    return codes.tobytes().decode("utf-32-le", "surrogatepass").split("\ud800")[:-1]


def in_order(rules: Sequence[Rule]) -> bool:
    """Whether every rule makes a token of its own out of tokens that are there before it, and no pair has two rules; so
    are all rules that were learned."""
    made: dict[int, int] = {new: k for k, (_, _, new) in enumerate(rules)}
    return (
        len(made) == len(rules) == len({r[:2] for r in rules})
        and all(new >= 256 for new in made)
        and all(made.get(t, -1) < k for k, (a, b, _) in enumerate(rules) for t in (a, b))
    )


def by_rank(places: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each rank, in their order; ranks of 16 bits are sorted by their digits."""
    if len(places):
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
        for k, end in zip([0, *cuts], [*cuts, len(ranks)], strict=True):
            yield int(ranks[k]), places[k:end]


class Merger:
    """The rules as tables; rules that are not ``in_order`` are applied as passes."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [tuple(r) for r in rules]
        self.passes = None if in_order(self.rules) else [(id_char(a) + id_char(b), id_char(new)) for a, b, new in self.rules]
        keys = np.array([a << 21 | b for a, b, _ in self.rules], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        # Row of each token that some rule has on its left, column of each on a right; 0 for all others.
        self.top = max((max(a, b) for a, b, _ in self.rules), default=0) + 1
        lefts, rights = (sorted({r[side] for r in self.rules}) for side in (0, 1))
        self.width = len(rights) + 1
        self.rows, self.columns = np.zeros(self.top + 1, np.int32), np.zeros(self.top + 1, np.int32)
        self.rows[lefts] = np.arange(1, len(lefts) + 1) * self.width
        self.columns[rights] = np.arange(1, len(rights) + 1)
        self.grid = None
        if (len(lefts) + 1) * self.width <= GRID:
            self.grid = np.full((len(lefts) + 1) * self.width, -1, np.int16 if len(self.rules) < 1 << 15 else np.int32)
            for k, (a, b, _) in reversed(list(enumerate(self.rules))):  # of two rules of a pair, which guesses can be, the first
                self.grid[self.rows[a] + self.columns[b]] = k

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no rule fuses it."""
        if self.grid is not None:
            return self.grid[self.rows[np.minimum(left, self.top)] + self.columns[np.minimum(right, self.top)]]
        key = left.astype(np.int64) << 21 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def candidates(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pairs that some rule fuses, and their ranks."""
        low = np.minimum(ids, self.top)
        rows, columns = self.rows[low[:-1]], self.columns[low[1:]]
        if self.grid is not None:
            ranks = self.grid[rows + columns]
            at = np.flatnonzero(ranks >= 0)
            return at, ranks[at]
        at = np.flatnonzero((rows > 0) & (columns > 0))
        ranks = self.rank(ids[at], ids[at + 1])
        return at[ranks >= 0], ranks[ranks >= 0]

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Fuses ids with separators."""
        n = len(ids)
        if not n or not self.rules:
            return ids
        token = np.append(ids, PAD).astype(np.int32)  # the last one stands before the first and behind the last
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        waiting: dict[int, list[np.ndarray]] = {}

        def wait(places: np.ndarray, ranks: np.ndarray) -> None:
            for r, own in by_rank(places, ranks):
                if r in waiting:
                    waiting[r].append(own)
                else:
                    waiting[r] = [own]
                    heapq.heappush(heap, r)

        heap: list[int] = []
        wait(*self.candidates(token[:n]))
        while heap:
            r = heapq.heappop(heap)
            parts = waiting.pop(r)
            at = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
            a, b, new = self.rules[r]
            right = after[at]
            here = (token[at] == a) & (token[right] == b)
            if a == b and len(at):  # of a run of places every second one
                at, right = at[here], right[here]
                starts = np.flatnonzero(np.append(True, at[1:] != right[:-1])[: len(at)])
                rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
                here = rank % 2 == 0
            at, right = at[here], right[here]
            if not len(at):
                continue
            behind = after[right]
            token[at], token[right] = new, -1
            after[at], before[behind] = behind, at
            ahead = before[at]
            x, y = token[ahead], token[behind]
            left, follow = x != PAD, y != PAD
            left &= x != new  # that pair is the follower of the one ahead
            places = np.concatenate([ahead[left], at[follow]])
            fresh = np.full(len(places), new, np.int64)
            cut = int(left.sum())
            found = self.rank(np.concatenate([x[left], fresh[cut:]]), np.concatenate([fresh[:cut], y[follow]]))
            known = found > r
            if known.any():
                wait(places[known], found[known])
        return token[:n][token[:n] >= 0]

    def apply(self, seqs: Sequence[str | None]) -> list[str | None]:
        """Sequences with all rules applied; nulls stay."""
        out = list(seqs)
        if self.passes is not None:
            for k, s in enumerate(out):
                if s:
                    for pair, new in self.passes:
                        s = s.replace(pair, new)
                    out[k] = s
            return out
        held: list[int] = []
        room = PORTION
        for k, s in enumerate(out):
            if s:
                held.append(k)
                room -= len(s)
            if held and (room <= 0 or k == len(out) - 1):  # the last row may be empty
                for i, new in zip(held, to_seqs(self.merge(to_ids([out[i] for i in held]))), strict=True):
                    out[i] = new
                held, room = [], PORTION
        return out


def expansions(rules: Sequence[Rule]) -> dict[int, str]:
    """Table for ``str.translate``: the bytes (or tokens that no rule makes) that each fused token stands for, built once
    from the first rule to the last."""
    table: dict[int, str] = {}
    for a, b, new in rules:
        x, y = id_char(a), id_char(b)
        table[ord(id_char(new))] = table.get(ord(x), x) + table.get(ord(y), y)
    return table
