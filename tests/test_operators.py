import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuseline.functions import simplex
from fuseline.functions.text import char_id, id_char
from fuseline.operators import codec, pairs, rewrite, vectors
from fuseline.plans.model import Model
from fuseline.sources.corpus import from_bytes, read_corpus, to_sequences

TEXTS = ["", "a", "aaaa", "abcabcabd the that", "baaab" * 7, "é²漢 ab", "a" * 50 + " " + "a" * 31]


def seqs(spark, texts=TEXTS, parts=None):
    df = to_sequences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return df.repartition(parts) if parts else df


def found(df, value="cnt"):
    return {(r.a, r.b): r[value] for r in df.collect()}


def brute_counts(texts):
    return Counter((x, y) for t in texts for x, y in zip(t.encode(), t.encode()[1:], strict=False))


def brute_contexts(texts, window):
    out = {}
    for t in texts:
        b = list(t.encode())
        for i in range(len(b) - 1):
            out.setdefault((b[i], b[i + 1]), []).append(tuple(b[max(0, i - window) : i] + b[i + 2 : i + 2 + window]))
    return out


def brute_entropy(contexts):
    n = len(contexts)
    return -sum(c / n * math.log(c / n + 1e-10) for c in Counter(contexts).values())


@pytest.mark.parametrize("parts", [1, 5])
def test_pair_counts(spark, parts):
    assert found(pairs.pair_counts(seqs(spark, parts=parts))) == brute_counts(TEXTS)
    often = {p: n for p, n in brute_counts(TEXTS).items() if n >= 5}
    assert found(pairs.pair_counts(seqs(spark), min_count=5)) == often


def test_pair_counts_of_learned_and_of_no_tokens(spark):
    df = spark.createDataFrame([(1, id_char(300) + id_char(5000) + id_char(300)), (2, None), (3, "")], "doc_id long, seq string")
    assert found(pairs.pair_counts(df)) == {(300, 5000): 1, (5000, 300): 1}
    assert pairs.pair_counts(df.limit(0)).count() == 0


def test_pair_counts_by_group(spark):
    df = seqs(spark).withColumn("g", F.col("doc_id") % 2)
    out = {(r.g, r.a, r.b): r.cnt for r in pairs.pair_counts(df, by=["g"]).collect()}
    for g in (0, 1):
        assert {k[1:]: n for k, n in out.items() if k[0] == g} == brute_counts(TEXTS[g::2])


@pytest.mark.parametrize("window", [1, 5])
def test_context_entropy(spark, window):
    want = {p: brute_entropy(c) for p, c in brute_contexts(TEXTS, window).items()}
    got = found(pairs.context_entropy(seqs(spark), window), "entropy")
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)
    some = list(want)[:3]
    assert found(pairs.context_entropy(seqs(spark), window, wanted=some), "entropy") == {p: got[p] for p in some}


def test_entropy_of_one_context(spark):
    got = found(pairs.context_entropy(seqs(spark, ["ab"]), 5), "entropy")
    assert got[97, 98] == pytest.approx(-1.00000008e-10, rel=1e-6)


@pytest.mark.parametrize("parts", [1, 3])
def test_capped_entropy(spark, parts):
    want = {p: (len(c), brute_entropy(c[:4])) for p, c in brute_contexts(TEXTS, 3).items()}
    out = pairs.capped_context_entropy(seqs(spark, parts=parts), window=3, cap=4).collect()
    assert {(r.a, r.b): r.cnt for r in out} == {p: n for p, (n, _) in want.items()}
    assert all(r.entropy == pytest.approx(want[r.a, r.b][1], abs=1e-9) for r in out)


def test_selection_order(spark):
    rows = [(5, 3, 10, 50.0, 0.0), (3, 5, 10, 50.0, 0.0), (9, 1, 10, 50.0, 0.0), (2, 2, 10, 50.0, 0.0)]
    stats = spark.createDataFrame(rows, "a int, b int, cnt long, coupling double, entropy double")
    score = F.col("cnt") * F.col("coupling") / (F.col("entropy") + 0.1)
    assert pairs.best_pair(stats, score) == (2, 2)
    assert [(r.a, r.b) for r in pairs.top_pairs(stats, score, 3).collect()] == [(2, 2), (3, 5), (5, 3)]
    assert pairs.best_pair(stats.limit(0), score) is None
    clear = spark.createDataFrame([(1, 1, 5, 10.0), (9, 9, 10, 50.0)], "a int, b int, cnt long, coupling double")
    assert pairs.best_pair(clear, F.col("cnt") * F.col("coupling")) == (9, 9)


def test_coupling_and_unknown_points(spark):
    rows = spark.createDataFrame([(97, 98, 3), (97, 9999, 3)], "a int, b int, cnt long")
    out = {(r.a, r.b): r for r in pairs.with_coupling(rows, Model().vocab(spark), 100).collect()}
    p = simplex.base_points()
    assert out[97, 98].d == pytest.approx(simplex.np_distance(p[97], p[98]))
    assert out[97, 9999].d == 0.0 and out[97, 9999].coupling == 100.0


def test_cluster_scores(spark):
    stats = pairs.pair_counts(seqs(spark))
    counts, p = brute_counts(TEXTS), simplex.base_points()
    targets = stats.filter("a <> b").orderBy(F.desc("cnt"), "a", "b").limit(5)
    d = lambda x, y: simplex.np_distance(p[x], p[y])
    for r in pairs.cluster_scores(targets, stats, Model().vocab(spark), near=0.7).collect():
        bonus = 0.0
        for (x, y), n in counts.items():
            if {x, y} & {r.a, r.b}:
                other = y if x in (r.a, r.b) else x
                if other not in (r.a, r.b) and d(other, r.a) < 0.7 and d(other, r.b) < 0.7:
                    bonus += 0.1 * n
        assert r.cluster == pytest.approx(1 / (d(r.a, r.b) + 0.1) + min(bonus, 1.0))


def brute_fuse(ids, a, b, new):
    out, i = [], 0
    while i < len(ids):
        hit = i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b
        out.append(new if hit else ids[i])
        i += 2 if hit else 1
    return out


def ids(seq):
    return [char_id(c) for c in seq]


@pytest.mark.parametrize("engine", ["sql", "arrow"])
def test_rules_in_order(spark, engine):
    rng = random.Random(1)
    rules, live = [], list(b"ab c")
    for k in range(30):
        rules.append((rng.choice(live), rng.choice(live), 256 + k))
        live.append(256 + k)
    texts = ["".join(rng.choice("ab c") for _ in range(200)) for _ in range(20)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = to_sequences(df).withColumn("seq", rewrite.apply_rules(F.col("seq"), rules, engine)).collect()
    for r in out:
        t = texts[r.doc_id]
        if t is None:
            assert r.seq is None
            continue
        want = list(t.encode())
        for a, b, new in rules:
            want = brute_fuse(want, a, b, new)
        assert ids(r.seq) == want
    with pytest.raises(ValueError):
        rewrite.apply_rules(F.col("seq"), rules, "c")


def test_known_rewrites(spark):
    df = seqs(spark, ["aaa", "abc"])
    fused = df.select("doc_id", rewrite.fuse(F.col("seq"), (97, 97, 256)).alias("s")).orderBy("doc_id").collect()
    assert ids(fused[0].s) == [256, 97]
    rules = [(98, 99, 256), (97, 98, 257)]
    ordered = df.select("doc_id", rewrite.apply_rules(F.col("seq"), rules).alias("s")).orderBy("doc_id").collect()
    greedy = df.select("doc_id", rewrite.apply_greedy(F.col("seq"), rules).alias("s")).orderBy("doc_id").collect()
    assert ids(ordered[1].s) == [97, 256] and ids(greedy[1].s) == [257, 99]


def test_changes_equal_a_recount(spark):
    before = seqs(spark)
    after = before.withColumn("seq", rewrite.fuse(F.col("seq"), (97, 97, 256)))
    x, y = found(pairs.pair_counts(before)), found(pairs.pair_counts(after))
    want = {p: y.get(p, 0) for p in x.keys() | y.keys() if x.get(p, 0) != y.get(p, 0)}
    assert found(pairs.count_changes(pairs.pair_counts(before), pairs.pair_counts(after))) == want


def test_length_and_prefix(spark):
    df = seqs(spark)
    total = sum(len(t.encode()) for t in TEXTS)
    assert rewrite.live_length(df).first().length == total
    assert rewrite.live_length(df.limit(0)).first().length == 0
    flat = [b for t in TEXTS for b in t.encode()]
    for n in (0, 1, 7, 40, 10_000):
        got = [i for r in rewrite.prefix(df, n).orderBy("doc_id").collect() for i in ids(r.seq)]
        assert got == flat[:n]


# ------------------------------------------------------------------------------------------------- codec

RULES = [(116, 104, 256), (256, 101, 257), (97, 97, 258), (258, 97, 259)]
MODEL = Model.from_rules(RULES).with_reserved(["<|u|>", "<|user|>", "a.b"])
HARD = ["", "the <|user|>the<|u|><|user|>", "th<|u|>e", "a.b aXb a.ba.b", "aaaaaaa", "e<|u|>́ é", "x\x00\U0001f600²", "<|user|>", None]


@pytest.mark.parametrize("engine", ["sql", "arrow"])
def test_round_trip(spark, engine):
    import re
    import unicodedata

    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    out = df.withColumn("seq", codec.encode(F.col("text"), MODEL, engine)).withColumn("back", codec.decode(F.col("seq"), MODEL))
    split = re.compile("|".join(map(re.escape, sorted(MODEL.reserved, key=len, reverse=True))))
    for r in out.withColumn("ids", codec.encode_ids(F.col("text"), MODEL)).collect():
        if r.text is None:
            assert r.back is None and r.ids is None
            continue
        pieces, hits = split.split(r.text), split.findall(r.text)
        want, text = [], ""
        for k, p in enumerate(pieces):
            own = list(unicodedata.normalize("NFC", p).encode())
            for rule in RULES:
                own = brute_fuse(own, *rule)
            want += own + ([MODEL.reserved[hits[k]]] if k < len(hits) else [])
            text += unicodedata.normalize("NFC", p) + (hits[k] if k < len(hits) else "")
        assert r.ids == want and r.back == text


def test_decoding_invalid_bytes_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, "\xc3"), (2, id_char(9000)), (3, "a" + id_char(256))], "k long, seq string")
    out = [r[0] for r in df.orderBy("k").select(codec.decode(F.col("seq"), MODEL)).collect()]
    assert out == ["�", "�", "ath"]
    with pytest.raises(Exception, match="unknown token id 9000"):
        df.select(codec.decode(F.col("seq"), MODEL, strict=True)).collect()
    assert df.orderBy("k").select(codec.expand_ids(F.col("seq"), MODEL).alias("x")).collect()[2].x == [97, 116, 104]


def test_velocity(spark):
    df = spark.createDataFrame(list(enumerate(["the th", "a", "", "abab"])), "doc_id long, text string")
    own = df.withColumn("seq", codec.encode(F.col("text"), MODEL))
    out = {r.doc_id: (r.n_tokens, r.velocity) for r in codec.velocity(own, MODEL.vocab(spark)).collect()}
    p = {k: v.vector for k, v in MODEL.points.items()}
    d = lambda x, y: simplex.np_distance(p[x], p[y])
    assert out[0] == (3, pytest.approx((d(257, 32) + d(32, 256)) / 2))
    assert out[1] == (1, 0.0) and out[2] == (0, 0.0)
    assert out[3] == (4, pytest.approx((2 * d(97, 98) + d(98, 97)) / 3))


def test_vocabulary_numbers(spark):
    df = spark.createDataFrame([(1, "the aaa x")], "doc_id long, text string")
    own = df.withColumn("seq", codec.encode(F.col("text"), MODEL))
    assert {r.coord_id: r.cnt for r in codec.token_frequency(own).collect()} == {257: 1, 32: 2, 259: 1, 120: 1}
    row = codec.compression(own).first()
    assert (row.n_bytes, row.n_tokens) == (9, 5) and codec.compression(own.limit(0)).first().ratio == 1.0
    cover = codec.coverage(own, MODEL).first()
    assert MODEL.points[257].scale == "subword" and cover.fallback == pytest.approx(3 / 9) and cover.coverage == 0.0
    scales = codec.scale_hierarchy(own, MODEL).first().scales
    assert scales == {"byte": [32, 32, 120], "subword": [257, 259]}
    assert {r.scale: r.n for r in codec.scale_distribution(MODEL.vocab(spark)).collect()} == {"byte": 256, "char": 2, "subword": 2, "special": 3}
    stats = pairs.with_coupling(pairs.pair_counts(own), MODEL.vocab(spark), 5)
    assert codec.vocab_stats(own, MODEL, stats).first().total == MODEL.size


# ------------------------------------------------------------------------------------------------- vectors


def test_vectors_in_blocks(spark):
    rng = np.random.RandomState(3)
    raw = rng.randn(60, 64)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(raw)], "vec_id long, embedding array<double>")
    p = vectors.projected(df, "embedding")
    got = {r.vec_id: np.array(r.vector) for r in p.collect()}
    for k, v in enumerate(raw):
        np.testing.assert_allclose(got[k], simplex.np_project(v), atol=1e-12)
    q = p.filter("vec_id % 20 = 0")
    for block in (1, 2, 100):
        d = {(r.query_id, r.vec_id): r.d for r in vectors.distances(p, q, block=block).collect()}
        assert len(d) == 3 * 59
        assert all(x == pytest.approx(simplex.np_distance(got[a], got[b]), abs=1e-9) for (a, b), x in d.items())
    near = vectors.nearest(p, q, 3).collect()
    for k in (0, 20, 40):
        want = sorted((round(x, 9), b) for (a, b), x in d.items() if a == k)[:3]
        assert [b for _, b in want] == [r.vec_id for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == k]
    assert vectors.distances(p, p.limit(0)).count() == 0


def test_frechet_means(spark):
    x = np.random.RandomState(4).dirichlet(np.ones(64), 40)
    df = spark.createDataFrame([(k % 2, v.tolist()) for k, v in enumerate(x)], "g long, vector array<double>").repartition(3)
    for r in vectors.frechet_means(df, "g", rounds=12).collect():
        np.testing.assert_allclose(r.center, simplex.np_mean(x[r.g :: 2]), atol=1e-9)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    df.write.json(str(tmp_path / "j"))
    df.write.parquet(str(tmp_path / "p"))
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert {r.doc_id for r in read_corpus(spark, str(tmp_path / "j"), "json").collect()} == {1, 2}
    assert read_corpus(spark, str(tmp_path / "p")).count() == 2
    assert {r.text for r in read_corpus(spark, str(tmp_path / "t.txt"), "text").collect()} == {"one", "two"}
    assert ids(from_bytes(spark, b"\xff\x00a").first().seq) == [255, 0, 97]


def test_frechet_means_of_many_groups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CENTERS", 0)
    rng = np.random.default_rng(3)
    rows = [(None if k % 7 == 0 else k % 40, rng.dirichlet(np.ones(6)).tolist()) for k in range(900)] + [(999, [1.0] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "g int, vector array<double>").repartition(5)
    found = {r.g: r.center for r in vectors.frechet_means(df, "g", rounds=25).collect()}
    assert len(found) == 42 and found[999] == pytest.approx([1, 0, 0, 0, 0, 0])
    for g, center in found.items():
        x, m = np.sqrt([v for k, v in rows if k == g]), np.sqrt(center)
        c = np.clip(x @ m, -1, 1)
        theta = np.arccos(c)
        tangent = ((x - c[:, None] * m) * np.where(theta < 1e-12, 1, theta / np.maximum(np.sin(theta), 1e-300))[:, None]).mean(axis=0)
        assert np.linalg.norm(tangent) < 1e-6 and sum(center) == pytest.approx(1)


def test_capped_entropy_of_one_pair_in_many_tasks(spark):
    """Every place of the corpus is the same pair, in many tasks: the first ones by document and place are taken."""
    rows = [(k, "a" * 30) for k in range(400)] + [(-1, "aaab"), (-2, None), (-3, "")]
    df = spark.createDataFrame(rows, "doc_id long, seq string").repartition(40)
    out = {(r.a, r.b): (r.cnt, r.entropy) for r in pairs.capped_context_entropy(df, 3, 64).collect()}
    seen = [(s[max(0, i - 3) : i] + s[i + 2 : i + 5]) for _, s in sorted((k, t) for k, t in rows if t) for i in range(len(s) - 1) if s[i : i + 2] == "aa"]
    n = Counter(seen[:64])
    want = -sum(c / 64 * np.log(c / 64 + 1e-10) for c in n.values())
    assert out[97, 97][0] == len(seen) and out[97, 97][1] == pytest.approx(want)
    assert out[97, 98] == (1, pytest.approx(-np.log(1 + 1e-10)))
