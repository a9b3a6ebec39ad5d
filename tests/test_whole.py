"""Queries over all pairs and rows, against plain Python."""

from collections import Counter

import numpy as np
import pytest

from fuseline.functions import simplex
from fuseline.operators import vectors
from fuseline.plans import queries as engine

TEXTS = ["eeee see the tree, the bees and the seed", "aa bb aa bb: a cab, a tab", "the eel ate the bee " * 4, "The quick brown fox jumps over a lazy dog; Pack my box with five dozen liquor jugs, vexed nymph! " * 6]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    at = tmp_path_factory.mktemp("whole")
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{at}/documents.parquet")
    turns = [(k, 0, "user", t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    rng = np.random.RandomState(3)
    vectors = [(k, k % 3, rng.rand(64).tolist()) for k in range(120)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def distance(a, b):
    p = simplex.base_points()
    return 0.0 if a == b else float(np.arccos(min(1.0, np.sqrt(np.array(p[a]) * np.array(p[b])).sum())))


def brute_stats():
    n = Counter((t[i], t[i + 1]) for t in map(str.encode, TEXTS) for i in range(len(t) - 1))
    size = sum(map(len, TEXTS))
    return {p: (c, distance(*p), min(c / size / (distance(*p) + 0.1) * 1000, 100)) for p, c in n.items() if c >= 5}


def test_pairs_of_one_byte_with_itself_are_scored(spark, folder):
    want = brute_stats()
    got = {(r.a, r.b): r for r in engine.QUERIES["pair_coupling"](spark, folder).collect()}
    fast = {(r.a, r.b): r.score for r in engine.QUERIES["pair_score_fast"](spark, folder).collect()}
    assert got.keys() == fast.keys() == want.keys() and (101, 101) in got and got[101, 101].d == 0
    for p, (cnt, d, coupling) in want.items():
        assert got[p].cnt == cnt and abs(got[p].d - d) < 1e-5 and abs(fast[p] - cnt * coupling) < 0.01
    top = [(r.a, r.b) for r in engine.QUERIES["top_k_pairs"](spark, folder).collect()]
    assert (101, 101) in top
    mean = engine.QUERIES["vocab_stats"](spark, folder).first().avg_coupling
    assert abs(mean - np.mean([c for _, _, c in want.values()])) < 1e-3


def test_entropies_of_the_documents(spark, folder):
    want = {}
    for t in map(str.encode, TEXTS):
        for i in range(len(t) - 1):
            want.setdefault((t[i], t[i + 1]), Counter())[t[max(0, i - 5) : i] + t[i + 2 : i + 7]] += 1
    got = {(r.a, r.b): r for r in engine.QUERIES["doc_context_entropy"](spark, folder).collect()}
    assert got.keys() == {p for p, c in want.items() if c.total() >= 5}
    for p, r in got.items():
        share = np.array(list(want[p].values())) / want[p].total()
        assert r.cnt == want[p].total() and abs(r.entropy + (share * np.log(share + 1e-10)).sum()) < 2e-5


def test_every_pair_has_a_cluster_score(spark, folder):
    stats = brute_stats()
    got = {(r.a, r.b): r.cluster for r in engine.QUERIES["cluster_score"](spark, folder).collect()}
    assert got.keys() == stats.keys() and len(got) > 64
    for a, b in stats:
        w = 0
        for (x, y), (cnt, _, _) in stats.items():
            for end, other in ((x, y), (y, x)):
                if end in (a, b) and other not in (a, b) and distance(other, a) < 1 and distance(other, b) < 1:
                    w += cnt
        assert abs(got[a, b] - (1 / (distance(a, b) + 0.1) + min(w * 0.1, 1))) < 1e-4


def test_queries_meet_all_other_vectors(spark, folder):
    got = {(r.query_id, r.vec_id): r.d for r in engine.QUERIES["fr_distance_pairs"](spark, folder).collect()}
    assert got.keys() == {(q, v) for q in (0, 50, 100) for v in range(120) if v != q}
    assert got[50, 0] == got[0, 50]


def test_many_queries_go_in_blocks(spark, folder):
    points = engine._points(spark, folder)
    queries = points.filter("vec_id % 2 = 0")
    rows = lambda **o: {(r.query_id, r.vec_id): round(r.d, 9) for r in vectors.distances(points, queries, **o).collect()}
    assert rows() == rows(block=7, share=25) and len(rows()) == 60 * 119
    near = lambda **o: sorted(map(tuple, vectors.nearest(points, queries, 3, **o).select("query_id", "rank", "vec_id").collect()))
    assert len(near()) == 180
    assert vectors.distances(points, queries.limit(0)).count() == 0
