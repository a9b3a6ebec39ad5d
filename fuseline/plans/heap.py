"""The best pair without sorting: a heap whose entries may be out of date.

A score is count x min(1000 count / (length (d + 0.1)), 100), and the length changes with every merge, so that all
scores move.  What does not move is count^2 / (d + 0.1): times 1000 / length it bounds the score from above, and is
the score unless the pair is so frequent that the cap holds, which few pairs can be at a time.  The heap is ordered
by that number; an entry counts while its count is the pair's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np

from ..functions import scores, simplex
from ..operators.merging import PAD
from .blocks import LOW, SHIFT, step_changes
from .model import Point

Pair = tuple[int, int]
_SLACK = 1 + 1e-9  # the bound and the score round differently


class PairTable:
    """Counts and distances of all live pairs, with the heap of those that occur at least ``min_count`` times."""

    def __init__(self, points: dict[int, Point], min_count: int = 1):
        self.points, self.min_count = points, max(min_count, 1)
        self.index: dict[Pair, int] = {}
        self.size = 0
        self.a = np.zeros(1024, np.int64)
        self.b = np.zeros(1024, np.int64)
        self.count = np.zeros(1024)
        self.dist = np.zeros(1024)
        self.heap: list[tuple[float, int, int, float]] = []
        self.roots: dict[int, np.ndarray] = {}
        #: Lower bounds of context entropies, in a training by entropy.
        self.floors: dict[Pair, float] = {}

    def pairs(self, positions: Iterable[int]) -> list[Pair]:
        return [(int(self.a[k]), int(self.b[k])) for k in positions]

    def _distances(self, fresh: list[Pair]) -> np.ndarray:
        """Distances of pairs; 0 where a token has no point, and of a token to itself."""
        out = np.zeros(len(fresh))
        apart = [k for k, (a, b) in enumerate(fresh) if a != b and a in self.points and b in self.points]
        for k in range(0, len(apart), 4096):
            part = apart[k : k + 4096]
            p = np.stack([self.points[fresh[i][0]].vector for i in part])
            q = np.stack([self.points[fresh[i][1]].vector for i in part])
            out[part] = np.arccos(np.clip(np.sqrt(p * q).sum(axis=1), -1.0, 1.0))
        return out

    def push_changed(self, changes: Iterable[tuple[int, int, int]]) -> None:
        """Adds differences to the counts; pairs that are frequent enough enter the heap once more."""
        changes = list(changes)
        fresh = [(a, b) for a, b, _ in dict.fromkeys((a, b, 0) for a, b, _ in changes) if (a, b) not in self.index]
        need = self.size + len(fresh)
        if need > len(self.a):
            room = max(need, 2 * len(self.a))
            self.a, self.b, self.count, self.dist = (np.resize(x, room) for x in (self.a, self.b, self.count, self.dist))
        if fresh:
            own = slice(self.size, need)
            self.a[own], self.b[own] = zip(*fresh, strict=True)
            self.count[own] = 0
            self.dist[own] = self._distances(fresh)
            for k, p in enumerate(fresh, self.size):
                self.index[p] = k
            self.size = need
        touched = []
        for a, b, n in changes:
            k = self.index[a, b]
            self.count[k] += n
            touched.append(k)
        for k in dict.fromkeys(touched):
            c = float(self.count[k])
            if c >= self.min_count:
                heapq.heappush(self.heap, (-c * c / (float(self.dist[k]) + scores.SOFTEN), int(self.a[k]), int(self.b[k]), c))

    def coupling(self, k: int, length: int) -> float:
        return float(min((self.count[k] / max(length, 1)) / (self.dist[k] + scores.SOFTEN) * scores.SCALE, scores.CAP))

    def pop_best(self, length: int) -> tuple[int, float] | None:
        """Position and score of the best pair, ties to the smaller pair; the pair stays."""
        held, best = [], None
        while self.heap:
            bound, a, b, c = self.heap[0]
            k = self.index[a, b]
            if self.count[k] != c or held and held[-1] == self.heap[0]:
                heapq.heappop(self.heap)  # out of date, or there twice
                continue
            if best is not None and -bound / max(length, 1) * scores.SCALE * _SLACK < -best[0]:
                break
            held.append(heapq.heappop(self.heap))
            key = (-float(self.count[k]) * self.coupling(k, length), a, b)
            if best is None or key < best:
                best = key
        for entry in held:
            heapq.heappush(self.heap, entry)
        return None if best is None else (self.index[best[1:]], -best[0])

    def products(self, length: int) -> np.ndarray:
        """Count x coupling of all pairs."""
        c, d = self.count[: self.size], self.dist[: self.size]
        return c * np.minimum((c / max(length, 1)) / (d + scores.SOFTEN) * scores.SCALE, scores.CAP)

    def top(self, n: int, length: int) -> np.ndarray:
        """Positions of the n best, best first; only those and their ties are sorted."""
        product = np.where(self.count[: self.size] >= self.min_count, self.products(length), -1.0)
        live = int((product >= 0).sum())
        if n < live:
            least = np.partition(product, len(product) - n)[len(product) - n]
            chosen = np.flatnonzero(product >= least)
        else:
            chosen = np.flatnonzero(product >= 0)
        order = np.lexsort((self.b[chosen], self.a[chosen], -product[chosen]))
        return chosen[order][:n]

    def guess(self, first: int, length: int, n: int, next_id: int) -> list[Pair]:
        """The next n merges, the first given by position and the others guessed: counts after a merge are estimated from
        the shares of its tokens.  What a guess is worth shows when the true counts are in."""
        a, b, c, d = (x[: self.size].copy() for x in (self.a, self.b, self.count, self.dist))
        live = c >= self.min_count
        a, b, c, d = a[live], b[live], c[live], d[live]
        for t in self.points.keys() - self.roots.keys():
            self.roots[t] = np.sqrt(self.points[t].vector)
        roots = dict(self.roots)
        at = int(np.flatnonzero((a == self.a[first]) & (b == self.b[first]))[0])
        out: list[Pair] = []
        while True:
            x, y, seen = int(a[at]), int(b[at]), float(c[at])
            out.append((x, y))
            if len(out) == n or x not in roots or y not in roots:
                return out
            new = next_id + len(out) - 1
            fused = seen if x != y else seen * 0.6
            before, behind = np.flatnonzero(b == x), np.flatnonzero(a == y)
            share_x = min(1.0, fused / max(c[a == x].sum(), 1.0))
            share_y = min(1.0, fused / max(c[b == y].sum(), 1.0))
            moved = np.concatenate([c[before] * share_x, c[behind] * share_y])
            ends = np.concatenate([a[before], b[behind]])
            np.subtract.at(c, before, c[before] * share_x)
            np.subtract.at(c, behind, c[behind] * share_y)
            c[at] = 0 if x != y else seen * 0.1
            length = max(1, length - int(fused))
            middle = (roots[x] + roots[y]) ** 2
            roots[new] = np.sqrt(middle / middle.sum())
            keep = moved >= max(1.0, 0.5 * self.min_count)
            known = np.array([int(t) in roots for t in ends], bool)
            far = np.zeros(len(ends))
            if known.any():
                other = np.stack([roots[int(t)] for t in ends[known]])
                far[known] = np.arccos(np.clip(other @ roots[new], -1.0, 1.0))
            is_left = np.arange(len(ends)) < len(before)
            a = np.concatenate([a, np.where(is_left, ends, new)[keep]])
            b = np.concatenate([b, np.where(is_left, new, ends)[keep]])
            c, d = np.concatenate([c, moved[keep]]), np.concatenate([d, far[keep]])
            score = c * np.minimum((c / length) / (d + scores.SOFTEN) * scores.SCALE, scores.CAP)
            at = int(score.argmax())
            if c[at] < self.min_count:
                return out


    def guess_by(self, sample: np.ndarray, first: int, length: int, n: int, next_id: int) -> list[Pair]:
        """As ``guess``, with what each merge changes in a sample of the corpus, scaled to the pair's true count."""
        a, b, c, d = (x[: self.size].copy() for x in (self.a, self.b, self.count, self.dist))
        for t in self.points.keys() - self.roots.keys():
            self.roots[t] = np.sqrt(self.points[t].vector)
        roots, fresh, at = dict(self.roots), {}, first
        out: list[Pair] = []
        while True:
            x, y, seen = int(a[at]), int(b[at]), float(c[at])
            out.append((x, y))
            if len(out) == n or x not in roots or y not in roots:
                return out
            new = next_id + len(out) - 1
            middle = (roots[x] + roots[y]) ** 2
            roots[new] = np.sqrt(middle / middle.sum())
            tokens = int((sample != PAD).sum())
            sample, [(keys, diff, fused, _)] = step_changes(sample, [(x, y, new)], 0)
            # A pair that the sample does not hold ends no batch: what it changes is not guessed.
            scale = 0.0 if not fused else seen / fused if x != y else length / max(tokens, 1)
            length = max(1, length - int(fused * scale if fused else seen))
            lefts, rights = (keys >> SHIFT).tolist(), (keys & LOW).tolist()
            added = [p for p in zip(lefts, rights, strict=True) if p not in self.index and p not in fresh]
            if added:
                apart = [0.0 if p == q or p not in roots or q not in roots else float(np.arccos(np.clip(roots[p] @ roots[q], -1.0, 1.0))) for p, q in added]
                fresh.update({p: len(a) + k for k, p in enumerate(added)})
                more = [np.array(z) for z in zip(*added, strict=True)]
                a, b = np.append(a, more[0]), np.append(b, more[1])
                c, d = np.append(c, np.zeros(len(added))), np.append(d, apart)
            where = [self.index[p] if p in self.index else fresh[p] for p in zip(lefts, rights, strict=True)]
            c[where] = np.maximum(0.0, c[where] + diff * scale)
            if x != y or not fused:
                c[at] = 0.0
            score = np.where(c >= self.min_count, c * np.minimum((c / length) / (d + scores.SOFTEN) * scores.SCALE, scores.CAP), -1.0)
            at = int(score.argmax())
            if score[at] < 0:
                return out


def distance(points: dict[int, Point], a: int, b: int) -> float:
    """Distance of two tokens' points, 0 of a token to itself."""
    return 0.0 if a == b else simplex.np_distance(points[a].vector, points[b].vector)
