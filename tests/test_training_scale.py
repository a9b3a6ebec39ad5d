"""Findings F5-F7, F15-F18, F22, F23: time of a training at 1 GB, and memory of its workers."""

import numpy as np

from fuseline.operators.merging import PAD, Merger
from fuseline.plans import blocks
from fuseline.plans import train as training

from .test_merging import corpus


def test_rows_of_a_table_stay_small(spark):
    """Rows of half a million ids came to a worker in batches."""
    seqs = corpus(spark, 1000)
    own = blocks.Blocks(seqs, 1000 * 400)
    largest = lambda: max(len(r["ids"]) // 4 for r in own.table.collect())
    assert own.count == 1 and largest() < blocks.ROW + 1000
    before = own.pair_counts()
    own.accept([(ord("e"), ord(" "), 256)])
    own.cut()
    assert largest() < 2 * blocks.ROW
    changes = {(a, b): n for a, b, n in before}
    for a, b, n in blocks.Blocks(seqs, 1000 * 400).changes([(ord("e"), ord(" "), 256)], 0)[0][0]:
        changes[a, b] = changes.get((a, b), 0) + n
    assert {p: n for p, n in changes.items() if n} == {(a, b): n for a, b, n in own.pair_counts()}


def test_changes_of_portions_are_added_up():
    """Each portion of half a million ids sent its own rows."""
    rng = np.random.default_rng(1)
    held = [np.stack([rng.integers(0, 3, 50), rng.integers(-1, 9, 50), rng.integers(-5, 5, 50), rng.integers(0, 2, 50)]) for _ in range(5)]
    want = {}
    for step, key, n, near in np.concatenate(held, axis=1).T.tolist():
        old = want.get((step, key), (0, 0))
        want[step, key] = (old[0] + n, max(old[1], near))
    got = blocks.summed(held).T.tolist()
    assert {(s, k): (n, z) for s, k, n, z in got} == want and len(got) == len(want)


def test_the_first_of_two_rules_of_a_pair_counts():
    """Guesses can name a pair twice."""
    ids = np.array([97, 97, 97, 97, 98, PAD], np.int32)
    out, found = blocks.step_changes(ids, [(97, 97, 256), (97, 98, 257), (97, 97, 258)], 0)
    assert out.tolist() == [256, 256, 98, PAD] and [f[2] for f in found] == [2, 0, 0]
    assert Merger([(97, 97, 256), (97, 97, 258)]).rank(ids[:1], ids[1:2]).tolist() == [0]


def test_earlier_rules_are_not_applied_to_texts(spark, monkeypatch):
    """the texts were fused again each time they were read."""
    seqs = corpus(spark)
    first = training.train(seqs, 300, "frequency", 3, 2, local=True)
    want = training.train(seqs, 340, "frequency", 3, 2, model=first.model, local=True)
    seen = []
    monkeypatch.setattr(training, "apply_rules", lambda seq, rules: seen.append(rules) or seq)
    got = training.train(seqs, 340, "frequency", 3, 2, model=first.model)
    assert not any(seen) and got.steps == want.steps and got.report == want.report
