"""Finding F10: time of a training by entropy."""

import math

import numpy as np

from fuseline.operators import pairs as P
from fuseline.operators.merging import to_ids
from fuseline.plans import blocks
from fuseline.plans import train as training

from .test_merging import corpus


def test_few_contexts_are_read(spark, monkeypatch):
    """the contexts of all pairs that score a hundredth of the best one's count x coupling were shuffled for each merge."""
    seqs = corpus(spark, 400)
    monkeypatch.setattr(training, "SENT", 0)
    read, entropies = [], blocks.Blocks.entropies
    monkeypatch.setattr(blocks.Blocks, "entropies", lambda self, wanted, *a: read.append(len(wanted)) or entropies(self, wanted, *a))
    got = training.train(seqs, 256 + 8, "entropy", 3, 2)
    want = training.train(seqs, 256 + 8, "entropy", 3, 2, local=True)
    assert [s.rule for s in got.steps] == [s.rule for s in want.steps]
    assert all(math.isclose(s.score, t.score, rel_tol=1e-9) for s, t in zip(got.steps, want.steps))
    pairs = len(blocks.Blocks(seqs, 1000).pair_counts())
    assert len(read) <= 3 * 8 and sum(read) < 8 * pairs / 4


def test_classes_bound_entropies(spark):
    """thrown together, contexts have no greater entropy; with classes enough, nearly the same."""
    own = blocks.Blocks(corpus(spark, 300), 1000)
    pairs = [(a, b) for a, b, n in own.pair_counts() if n > 20]
    exact = own.entropies(pairs, 3)
    for classes in (1, 8, 1 << 10, 1 << 20):
        some = {p: classes for p in pairs[::2]}
        found = own.entropies(pairs[1::2], 3, some)
        assert found.keys() == set(pairs)
        assert all(math.isclose(found[p], exact[p], rel_tol=1e-9, abs_tol=1e-9) for p in pairs[1::2])
        assert all(found[p] <= exact[p] + 1e-9 for p in some)
        if classes == 1 << 20:
            assert all(found[p] > exact[p] - 0.1 for p in some)
    assert own.entropies([], 3) == {}


def test_equal_contexts_have_one_class():
    ids = to_ids(["abcabcabxabc", "ab", "xab", "abx", "cabc", "ccabcc"] * 3)
    at = P.pair_places(ids)
    keys = list(zip(*(x.tolist() for x in P.context_keys(ids, at, 2))))
    own = P.context_classes(ids, at, 2).tolist()
    assert len(set(keys)) == len(set(own)) == len(set(zip(keys, own))) < len(at)
    assert P.context_classes(ids, np.zeros(0, np.int64), 2).tolist() == []
