"""One test for each mended finding of the round."""

import random
from collections import Counter

import numpy as np
import pytest

from fuseline.operators import pairs

WORDS = "river rain stone boat cloud field path light moss reed heron wind slow bright under over along between every".split()


def texts(n, seed):
    rng = random.Random(seed)
    return ["", "a", "ab", *("".join(rng.choice(WORDS) + " " for _ in range(rng.randint(1, 60))) for _ in range(n)), "aaaa" * 30, None]


def plain_kinds(seqs, window):
    each = Counter()
    for s in seqs:
        for i in range(len(s or "") - 1):
            each[s[i], s[i + 1], (*s[max(0, i - window) : i], *s[i + 2 : i + 2 + window])] += 1
    kinds = Counter((a, b, c) for (a, b, _), c in each.items())
    return {(ord(a), ord(b), c): m for (a, b, c), m in kinds.items()}


@pytest.mark.parametrize("window", [1, 3, 5])
def test_contexts_travel_as_runs(spark, window, monkeypatch):
    """F1, F2, F3"""
    seqs = texts(60, window)
    df = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "doc_id long, seq string").repartition(3)
    found = Counter()
    for r in pairs.context_kinds(df, window).collect():
        found[r["a"], r["b"], r["c"]] += r["m"]
    assert dict(found) == plain_kinds(seqs, window)


def test_windows_cost_few_bytes():
    """an occurrence was a row of five numbers."""
    ids = pairs._codes([s for s in texts(2000, 9) if s])
    assert sum(len(x[3]) for x in pairs.packed_runs(ids, 12)) < 4 * len(ids)


def test_large_buckets_are_sorted_in_shares(monkeypatch):
    ids = pairs._codes([s for s in texts(40, 4) if s])
    bodies = {}
    for bucket, *body in pairs.packed_runs(ids, 12):
        bodies.setdefault(bucket, []).append(body)
    every = lambda: [tuple(x.tolist() for x in pairs._summed(*(np.concatenate(x) for x in zip(*pairs._window_kinds(b, 12))))) for b in bodies.values()]
    whole = every()
    monkeypatch.setattr(pairs, "SORTED", 50)
    assert every() == whole


def test_streams_read_folders_of_files(spark, tmp_path):
    """a table that is a folder gave the streams no file."""
    from fuseline.plans import queries

    docs = spark.createDataFrame([(k, s, "en", "web", len(s or "")) for k, s in enumerate(texts(20, 2))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    by = lambda df: sorted(map(tuple, df.collect()))
    assert by(queries.stream_pair_counts(spark, d)) == by(queries.byte_pair_counts(spark, d))
    rows = queries.stream_encode(spark, d)
    assert rows.count() == docs.count()


def test_trials_change_places():
    """A guess out of order ended the batch, and so cost a scan of the corpus."""
    from fuseline.plans.blocks import LOW, SHIFT, step_changes
    from fuseline.plans.train import _Trial, swapped

    rng, moved = np.random.default_rng(3), 0
    for _ in range(300):
        ids = rng.integers(97, 101, 400).astype(np.int32)
        ids[rng.integers(0, 400, 6)] = pairs._PAD
        v, u = (tuple(int(t) for t in rng.integers(97, 101, 2)) for _ in range(2))
        if u == v:
            continue
        changes = lambda rules: [
            _Trial(r, {(int(k) >> SHIFT, int(k) & LOW): int(n) for k, n in zip(keys, diff) if n}, fused, set())
            for r, (keys, diff, fused, _) in zip(rules, step_changes(ids, rules, 0)[1])
        ]
        first, second = changes([(*v, 300), (*u, 301)])
        if swapped(first, second):
            moved += 1
            want = changes([(*u, 301), (*v, 300)])
            got = [_Trial(t.rule, {p: n for p, n in t.changes.items() if n}, t.merged, set()) for t in (second, first)]
            assert got == want
    assert moved > 50


def test_few_scans(spark, monkeypatch):
    from fuseline.plans import blocks, train

    scans, scan = [], blocks.Blocks.changes
    monkeypatch.setattr(blocks.Blocks, "changes", lambda self, rules, *a: scans.append(len(rules)) or scan(self, rules, *a))
    df = spark.createDataFrame([(k, s) for k, s in enumerate(texts(300, 8))], "doc_id long, seq string")
    own = train.train(df, 256 + 60, "frequency")
    assert [s.rule for s in own.steps] == [s.rule for s in train.train(df, 256 + 60, "frequency", local=True).steps]
    assert len(scans) <= 8


def test_resumed_training_has_all_its_merges():
    """256 merges, of which the second half is returned, had become 200."""
    from fuseline.plans import queries

    assert queries.RESUMED_MERGES == 256 and "step >= 128" in queries.oracle()["train_resumed"]


def test_scales_need_no_shuffle_of_tokens(spark):
    """F20"""
    from fuseline.operators import codec
    from fuseline.plans.queries import demo_model

    seqs = [(k, s) for k, s in enumerate(texts(30, 6))]
    df = spark.createDataFrame(seqs, "doc_id long, text string").withColumn("seq", codec.encode(pairs.F.col("text"), demo_model()))
    once = {r["doc_id"]: r["scales"] for r in codec.scale_hierarchy(df, demo_model()).collect()}
    assert len(once) == sum(bool(s) for _, s in seqs)
    ids = {r["doc_id"]: r["ids"] for r in df.filter("seq <> ''").select("doc_id", codec.seq_ids(pairs.F.col("seq")).alias("ids")).collect()}
    scale = {k: p.scale for k, p in demo_model().points.items()}
    for k, want in ids.items():
        assert {s: [t for t in want if scale[t] == s] for s in {scale[t] for t in want}} == once[k]
    plan = codec.scale_hierarchy(df, demo_model())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    again = df.union(df.filter("doc_id = 4").selectExpr("doc_id", "text", "seq"))
    several = {r["doc_id"]: r["scales"] for r in codec.scale_hierarchy(again, demo_model()).collect()}
    assert several.keys() == once.keys()
    assert {k: len(v) for k, v in several[4].items()} == {k: 2 * len(v) for k, v in once[4].items()}


def test_cells_of_distances_are_small(spark, monkeypatch):
    """a task's result held a block of queries times 50,000 points."""
    from fuseline.operators import vectors

    rng = np.random.default_rng(5)
    rows = [(k, (v / v.sum()).tolist()) for k, v in enumerate(rng.random((300, 4)))]
    p = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    by = lambda df: sorted((r["query_id"], r["vec_id"], round(r["d"], 9)) for r in df.collect())
    want = by(vectors.distances(p, p.filter("vec_id % 5 = 0")))
    monkeypatch.setattr(vectors, "CELL", 600)
    sizes = vectors.distances(p, p.filter("vec_id % 5 = 0"), block=20)
    assert by(sizes) == want
    assert vectors.CELL // 20 < 50_000


def test_texts_come_in_small_batches(spark, tmp_path):
    """Arrow batches of texts held ten thousand rows."""
    from fuseline.plans import queries

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.createDataFrame([(1, "ab")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    queries.apply_rules(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
