import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuseline.functions import scores, simplex, text

CASES = ["", "plain", "é café", "漢 x² Ａ ﬁ", "a  b, c.\n\n d", "\x00\x1c", "\U0001f600!"]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")


def values(df):
    return [r[1] for r in sorted(df.collect())]


@pytest.mark.parametrize("form", text.FORMS)
def test_normal_forms(spark, form):
    out = values(column(spark, [*CASES, None]).select("k", text.normalize_text(F.col("v"), form)))
    assert out == [unicodedata.normalize(form, c) for c in CASES] + [None]
    again = values(column(spark, out).select("k", text.normalize_text(F.col("v"), form)))
    assert again == out


def test_unknown_form_is_refused():
    with pytest.raises(ValueError):
        text.Normalizer("NFX")
    with pytest.raises(ValueError):
        text.normalize_text(F.lit("a"), "nfc")


def test_composed_and_decomposed_give_the_same_bytes(spark):
    out = values(column(spark, ["é", "é", "漢"]).select("k", text.Normalizer().bytes(F.col("v"))))
    assert [bytes(x) for x in out] == [b"\xc3\xa9", b"\xc3\xa9", "漢".encode()]


def test_invalid_bytes_stay(spark):
    rows = [bytearray(b"\xff\xfe\x00A"), bytearray("é".encode()), bytearray(b""), None]
    out = values(column(spark, rows, "binary").select("k", text.normalize_bytes(F.col("v"))))
    assert [x and bytes(x) for x in out] == [b"\xff\xfe\x00A", b"\xc3\xa9", b"", None]


def test_base_sequence_is_the_bytes(spark):
    out = values(column(spark, [*CASES, None]).select("k", text.seq_ids(text.base_seq(F.col("v")))))
    assert out == [list(unicodedata.normalize("NFC", c).encode()) for c in CASES] + [None]


def test_segments_are_lossless(spark):
    out = values(column(spark, CASES).select("k", text.segments(F.col("v"))))
    assert ["".join(s) for s in out] == CASES
    assert out[4] == ["a", "  b", ",", " c", ".", "\n\n d"]


def test_byte_segments(spark):
    flat, cut = (values(column(spark, CASES).select("k", text.Normalizer(pretokenize=p).segments(F.col("v")))) for p in (False, True))
    assert all(len(f) == 1 for f in flat)
    assert ["".join(c) for c in cut] == ["".join(f) for f in flat]


def test_id_characters():
    for k in (0, 255, 256, 0xD7FF, 0xD800, 0xFFFF, 0x10F7FF):
        assert text.char_id(text.id_char(k)) == k
    with pytest.raises(ValueError):
        text.id_char(-1)


def points(seed, n):
    return np.random.RandomState(seed).dirichlet(np.ones(64), n)


def test_geometry_columns_match_numpy(spark):
    rng = np.random.RandomState(0)
    rows = [(k, rng.randn(64).tolist(), p.tolist(), q.tolist()) for k, (p, q) in enumerate(zip(points(1, 20), points(2, 20), strict=True))]
    df = spark.createDataFrame(rows, "k int, v array<double>, p array<double>, q array<double>")
    out = df.select(
        "k",
        simplex.project(F.col("v")).alias("proj"),
        simplex.distance(F.col("p"), F.col("q")).alias("d"),
        simplex.distance(F.col("q"), F.col("p")).alias("back"),
        simplex.midpoint(F.col("p"), F.col("q")).alias("mid"),
        simplex.slerp(F.col("p"), F.col("q"), 0.5).alias("half"),
        simplex.slerp(F.col("p"), F.col("p"), 0.3).alias("same"),
    ).collect()
    for r, (_, v, p, q) in zip(sorted(out), rows, strict=True):
        p, q = np.array(p), np.array(q)
        np.testing.assert_allclose(r.proj, simplex.np_project(np.array(v)), atol=1e-12)
        assert abs(sum(r.proj) - 1) < 1e-9 and min(r.proj) >= 0
        assert r.d == pytest.approx(simplex.np_distance(p, q)) and r.d == pytest.approx(r.back) and 0 <= r.d <= np.pi / 2
        np.testing.assert_allclose(r.mid, simplex.np_midpoint(p, q), atol=1e-12)
        np.testing.assert_allclose(r.half, r.mid, atol=1e-9)
        np.testing.assert_allclose(r.same, p, atol=1e-9)
        assert simplex.np_distance(p, np.array(r.mid)) == pytest.approx(r.d / 2)


def test_seeded_points_leave_the_global_generator_alone():
    np.random.seed(1)
    want = np.random.rand()
    np.random.seed(1)
    p = simplex.base_points()
    assert np.random.rand() == want
    np.testing.assert_allclose(p[0][:3], [0.00787824, 0.05053499, 0.022106], atol=1e-7)
    assert simplex.np_distance(p[0], p[1]) == pytest.approx(0.67263186, abs=1e-7)
    assert simplex.np_distance(p[ord("t")], p[ord("h")]) == pytest.approx(0.64554163, abs=1e-7)


def test_phi_kappa(spark):
    rows = [(g, p.tolist()) for g in (0, 1) for p in points(g, 30)] + [(2, points(5, 1)[0].tolist())]
    df = spark.createDataFrame(rows, "g int, vector array<double>")
    out = {r.g: r for r in simplex.phi_kappa(df, ["g"]).collect()}
    assert (out[2].phi, out[2].kappa) == (0.5, 1.0)
    for g in (0, 1):
        x = np.sqrt(points(g, 30)).mean(axis=0) ** 2
        d = np.array([simplex.np_distance(p, x / x.sum()) for p in points(g, 30)])
        assert out[g].phi == pytest.approx(np.clip(1 - d.mean() / (np.pi / 2), 0.3, 0.95))
        assert out[g].kappa == pytest.approx(np.clip(10 / (d.std() + 0.1), 0.1, 100))
    assert simplex.np_phi_kappa(points(0, 1)) == (0.5, 1.0)
    whole = simplex.phi_kappa(df, []).first()
    assert whole.n == 61


def test_scores(spark):
    row = spark.range(1).select(
        scores.coupling(F.lit(10.0), F.lit(100.0), F.lit(0.4)).alias("capped"),
        scores.coupling(F.lit(1.0), F.lit(1000.0), F.lit(0.4)).alias("link"),
        scores.by_entropy(F.lit(4), F.lit(2.0), F.lit(0.3)).alias("e"),
        scores.by_phi(F.lit(4), F.lit(2.0), F.lit(-0.5)).alias("none"),
        scores.candidate(F.lit(4), F.lit(2.0), F.lit(0.5), F.lit(0.5)).alias("c"),
        scores.attention(F.lit(np.pi / 2)).alias("far"),
        simplex.granularity(F.lit(50.0)).alias("g"),
        simplex.granularity(F.lit(30.0)).alias("f"),
        simplex.granularity(F.lit(40.0)).alias("n"),
    ).first()
    assert row.capped == 100.0 and row.link == pytest.approx(2.0) and row.e == pytest.approx(20.0)
    assert row.none == 0.0 and row.c == pytest.approx(6.0) and row.far == pytest.approx(0.0)
    assert (row.g, row.f, row.n) == ("coarse", "fine", "normal")
