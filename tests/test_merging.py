"""Rank-ordered merging against passes, blocks of a training against full scans, and trainings that go on."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fuseline.functions.text import id_char
from fuseline.operators import merging, rewrite
from fuseline.operators.merging import PAD, Merger, expansions, to_ids, to_seqs
from fuseline.plans import blocks, train as training
from fuseline.plans.train import train
from fuseline.sources.corpus import to_sequences
from fuseline.sources.shared import read_texts

from .test_training import prose


def passes(s, rules):
    for a, b, new in rules:
        s = s.replace(id_char(a) + id_char(b), id_char(new))
    return s


def unpasses(s, rules):
    for a, b, new in reversed(rules):
        s = s.replace(id_char(new), id_char(a) + id_char(b))
    return s


@st.composite
def rules_and_texts(draw):
    base = [97, 98, 99][: draw(st.integers(1, 3))]
    tokens, rules = list(base), []
    for k in range(draw(st.integers(0, 12))):
        a, b = draw(st.sampled_from(tokens)), draw(st.sampled_from(tokens))
        if (a, b) not in {r[:2] for r in rules}:
            rules.append((a, b, 256 + k))
            tokens.append(256 + k)
    texts = draw(st.lists(st.none() | st.text(alphabet=[chr(b) for b in base], max_size=40), max_size=5))
    return rules, texts


@settings(max_examples=400, deadline=None)
@given(rules_and_texts())
def test_merging_by_rank_is_passes_in_order(case):
    rules, texts = case
    assert merging.in_order(rules)
    merged = Merger(rules).apply(texts)
    assert merged == [t and passes(t, rules) for t in texts]
    table = expansions(rules)
    assert [m and m.translate(table) for m in merged] == [m and unpasses(m, rules) for m in merged] == texts


@pytest.mark.parametrize("rules", [
    [(97, 98, 256), (97, 98, 257)],  # a pair with two rules
    [(256, 97, 257), (97, 98, 256)],  # a token before it is made
    [(97, 97, 97)], [(97, 98, 97), (97, 99, 98)],  # tokens that are there already
    [(97, 98, 256), (98, 99, 256)],
])
def test_rules_out_of_order_are_passes(rules):
    assert not merging.in_order(rules)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(30)) for _ in range(50)]
    assert Merger(rules).apply(texts) == [passes(t, rules) for t in texts]
    made = [passes(t, rules) for t in texts]
    assert [m.translate(expansions(rules)) for m in made] == [unpasses(m, rules) for m in made]


def test_portions_and_high_ids(monkeypatch):
    monkeypatch.setattr(merging, "PORTION", 10)
    rules = [(97, 98, 0xD7FF), (0xD7FF, 97, 0xD800), (0xD800, 98, 0x1F000)]
    texts = ["abab" * 7, None, "", "ab", "b" * 12, None]
    assert Merger(rules).apply(texts) == [t and passes(t, rules) for t in texts]
    assert to_seqs(to_ids(["", "a\U0001f600", "b"])) == ["", "a\U0001f600", "b"]


def test_cost_follows_fusions_not_rules():
    """Rules that do not occur cost nothing that counts."""
    import time

    text = [prose(200_000, 1).decode()] * 4
    few = [(116, 104, 256), (256, 101, 257)]
    many = few + [(1, 258 + k - 1 if k else 2, 258 + k) for k in range(20_000)]

    def seconds(rules):
        merger, began = Merger(rules), time.time()
        merger.apply(text)
        return time.time() - began

    seconds(few)
    assert seconds(many) < 3 * max(seconds(few), 0.05)


def test_columns(spark):
    df = spark.createDataFrame([(1, "abab"), (2, None), (3, "")], "doc_id long, seq string")
    rules = [(97, 98, 256), (256, 256, 257)]
    out = df.select(rewrite.apply_rules(F.col("seq"), rules).alias("a"), rewrite.apply_rules(F.col("seq"), rules, "sql").alias("b"))
    assert [tuple(r) for r in out.collect()] == [(chr(257), chr(257)), (None, None), ("", "")]
    assert [r.x for r in out.select(rewrite.undo_rules(F.col("a"), rules).alias("x")).collect()] == ["abab", None, ""]


# ------------------------------------------------------------------------------------------- blocks


def plain_changes(ids, rules, window):
    """Counts before and after every rule, and pairs whose contexts may have changed."""
    def counts(x):
        keys, n = blocks.distinct_keys(np.array(x))
        return dict(zip(keys.tolist(), n.tolist()))

    text, found = to_seqs(ids), []
    for a, b, new in rules:
        before = counts(to_ids(text))
        fused = [passes(t, [(a, b, new)]) for t in text]
        after = counts(to_ids(fused))
        diff = {k: after.get(k, 0) - before.get(k, 0) for k in before.keys() | after.keys()}
        found.append(({k: d for k, d in diff.items() if d}, sum(map(len, text)) - sum(map(len, fused))))
        text = fused
    return to_ids(text), found


@settings(max_examples=200, deadline=None)
@given(rules_and_texts())
def test_step_changes_are_those_of_recounts(case):
    rules, texts = case
    ids = to_ids([t for t in texts if t])
    out, found = blocks.step_changes(ids, rules, 2)
    want_ids, want = plain_changes(ids, rules, 2)
    assert out.tolist() == want_ids.tolist()
    for (keys, diff, fused, _), (plain, n) in zip(found, want):
        assert {k: d for k, d in zip(keys.tolist(), diff.tolist()) if d} == plain and fused == n


def corpus(spark, n=60, size=400):
    rows = [(k, prose(size, 100 + k).decode()) for k in range(n)]
    rows += [(900, None), (901, ""), (902, "zqzqzqzq xkxk"), (903, "zqzq vjvj")]
    return to_sequences(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("options", [{}, {"cut_every": 7}, {"block_tokens": 500, "cut_every": 30}])
def test_spread_training_is_the_local_one(spark, options):
    seqs = corpus(spark)
    want = train(seqs, 340, "frequency", 3, 2, local=True)
    got = train(seqs, 340, "frequency", 3, 2, **options)
    assert got.steps == want.steps and got.report == want.report
    assert sorted(got.seqs.collect()) == sorted(want.seqs.collect())


def test_scans_of_rare_pairs_open_only_their_blocks(spark):
    seqs = corpus(spark, 200)
    own = blocks.Blocks(seqs, 200 * 400, block_tokens=1_000)
    assert own.count == 80
    z, q, x, k = map(ord, "zqxk")
    full = own.changes([(z, q, 256), (256, 256, 257)], 2)
    few = own.changes([(z, q, 256), (256, 256, 257)], 2, occurrences=6)
    assert few == full and full[0][1] == 6
    assert own.opened - own.count <= 2 and own.there == 2 * own.count
    own.accept([(z, q, 256)])
    opened = own.opened
    assert own.anchor((256, 256)) == (z, q) == own.anchor((256, ord(" ")))
    rare = own.changes([(256, 256, 257), (x, k, 258)], 0, occurrences=4)
    assert rare == own.changes([(256, 256, 257), (x, k, 258)], 0) and rare[0][1] == 3 and rare[1][1] == 2
    assert own.opened - opened - own.count <= 2
    own.cut()
    assert own.changes([(256, 256, 257)], 0, occurrences=3) == own.changes([(256, 256, 257)], 0)


def test_first_tokens_are_those_of_the_documents_in_order(spark):
    seqs = corpus(spark, 12, 60)
    own = blocks.Blocks(seqs, 12 * 60)
    rules = [(ord("e"), ord(" "), 256), (ord("r"), 256, 257)]
    whole = [c for r in seqs.filter("char_length(seq) > 0").orderBy("doc_id").collect() for c in r.seq]
    assert own.first(5) == list(map(ord, whole[:5]))
    own.accept(rules)
    merged = [ord(c) for r in seqs.filter("char_length(seq) > 0").orderBy("doc_id").collect() for c in passes(r.seq, rules)]
    for n in (5, 40, 300, 5_000):
        assert own.first(n) == merged[:n]
    assert PAD not in own.first(5_000)


class Killed(Exception):
    pass


@pytest.mark.parametrize("mode, at", [("frequency", 1), ("frequency", 9), ("frequency", 23), ("entropy", 5)])
def test_a_killed_training_goes_on(spark, tmp_path, mode, at):
    seqs, target = corpus(spark, 20), 256 + (34 if mode == "frequency" else 8)
    options = dict(mode=mode, window=2, min_count=2, cut_every=6)
    want = train(seqs, target, **options)
    folder, seen = str(tmp_path / "state"), []

    def die(step):
        seen.append(step)
        if len(seen) == at:
            raise Killed

    with pytest.raises(Killed):
        train(seqs, target, state_to=folder, on_step=die, **options)
    assert len(read_texts(spark, folder, ".manifest")) == 1
    counted = []
    own = blocks.Blocks.pair_counts
    blocks.Blocks.pair_counts = lambda self: counted.append(1) or own(self)
    try:
        got = train(seqs, target, state_to=folder, **options)
    finally:
        blocks.Blocks.pair_counts = own
    assert not counted  # nothing was counted again
    assert [s.rule for s in got.steps] == [s.rule for s in want.steps] and [s.count for s in got.steps] == [s.count for s in want.steps]
    assert got.report == want.report
    assert train(seqs, target, state_to=folder, **options).steps == got.steps  # there is nothing left to do


def test_half_a_snapshot_is_never_read(spark, tmp_path, monkeypatch):
    seqs, folder = corpus(spark, 20), str(tmp_path / "state")
    want = train(seqs, 256 + 30, "frequency", 2, 2, cut_every=6)
    own, calls = training.write_text, []

    def failing(session, path, text):
        if path.endswith(".manifest"):
            calls.append(path)
            if len(calls) == 3:
                raise Killed
        own(session, path, text)

    monkeypatch.setattr(training, "write_text", failing)
    with pytest.raises(Killed):  # the tables of the third snapshot are there, its manifest is not
        train(seqs, 256 + 30, "frequency", 2, 2, cut_every=6, state_to=folder)
    got = train(seqs, 256 + 30, "frequency", 2, 2, cut_every=6, state_to=folder)
    assert [s.rule for s in got.steps] == [s.rule for s in want.steps]


def test_candidates_are_measured_by_workers_as_by_the_driver(spark):
    seqs = corpus(spark, 20)
    want = train(seqs, 262, "phi", 3, 2, local=True)
    got = train(seqs, 262, "phi", 3, 2)
    assert got.steps == want.steps and all(s.gain is not None for s in got.steps)
    sample, points = [97, 98, 97, 98, 98], training.Model().points
    pairs = [None, (97, 98), (98, 98)]
    assert training.phis(sample, points, pairs, training.simplex.np_phi_kappa, spark) == training.phis(sample, points, pairs, training.simplex.np_phi_kappa)
    assert training.phis([], points, pairs, training.simplex.np_phi_kappa, spark) == [0.5] * 3


def test_a_failing_kernel_leaves_the_other_candidates(spark):
    def fails(x):
        if len(x) == 3:  # only with (97, 98) fused twice
            raise RuntimeError("no model here")
        return float(len(x)), 1.0

    sample, points = [97, 98, 97, 98, 98], training.Model().points
    assert training.phis(sample, points, [None, (97, 98), (98, 98)], fails, spark) == [5.0, None, 4.0]

    def never(x):
        raise RuntimeError("no model at all")

    seqs = corpus(spark, 20)
    plain = train(seqs, 260, "frequency", 3, 2, local=True)
    with pytest.raises(RuntimeError):  # the report's own measurement is the caller's to mend
        train(seqs, 260, "phi", 3, 2, kernel=never)
    calls = []

    def once(x):  # in the driver it works for the report, in workers never
        import os

        if os.getpid() != driver:
            raise RuntimeError("no model in workers")
        calls.append(1)
        return 0.5, 1.0

    driver = __import__("os").getpid()
    out = train(seqs, 260, "phi", 3, 2, kernel=once)
    assert [s.rule for s in out.steps] == [s.rule for s in plain.steps] and {s.gain for s in out.steps} == {0.0}
