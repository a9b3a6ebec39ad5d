"""Vector codes, token alignment and piece encoding against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fuseline.llm import alignment, codebooks, common, pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
OWN = pieces.PieceModel.of(pieces.path_of(pieces.MODEL))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BYTES.encode_special_tokens = True
ODD = [
    None, "", " ", "   ", "a", " a", "the thing", "a  b ", "▁x", "x▁", "<s>hi</s>", "<|endoftext|> x", "<0x0A>", "\r\n", " ", "\x00a", "é",
    "中国的", "\U0001f600 \U0001f468‍\U0001f469", "a" * 5_000, " " * 3_001, "thing" * 2_000, "\t\t\tx", "naïve café", "﻿q", "1234567890" * 9,
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------------------------------- pieces

some_text = st.text(alphabet=st.sampled_from("abetho  ▁\n\rüé中国的😀́\x00.,'12") | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=600, deadline=None)
@given(some_text)
def test_pieces_are_the_librarys(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(sorted(OWN.ids)), min_size=1, max_size=9), st.sampled_from(["", " ", "▁"]))
def test_joined_pieces_are_encoded_as_the_library_does(parts, space):
    text = "".join(parts).replace("▁", space)
    assert OWN.encode(text) == LIBRARY.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 258) | st.integers(0, 31_999) | st.sampled_from([1, 2, 259, 29871]), max_size=8))
def test_any_ids_decode_as_in_the_library(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_neighbours_of_every_encoding_fit_and_only_those():
    text = "▁therethingandtheotheringthing"
    parts = OWN.split(text)
    assert "".join(parts) == text and parts == OWN.merge(text)
    assert all(OWN.fits(x, y) for x, y in zip(parts, parts[1:]))
    assert not OWN.fits("t", "h")


def test_long_segments_and_small_memories(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 16)
    own = pieces.PieceModel(pieces.path_of(pieces.MODEL))
    for text in ("the cat sat on the mat and thing " * 40, "a" * 20_000, "中国的" * 3_000, "ab" * 9_000 + " x"):
        assert own.encode(text) == LIBRARY.encode(text)
        assert all(len(x) <= 16 for m in (own.known, own.following) for x in (m, m.older))


def test_other_models_and_ids_are_refused(tmp_path):
    with pytest.raises(ValueError, match="range"):
        OWN.decode([32_000])
    plain = tmp_path / "unigram.model"
    plain.write_bytes(b"\x0a\x05\x0a\x01a\x18\x01\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="merges"):
        pieces.PieceModel(str(plain))


def test_piece_columns(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "twice"), (None, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids_", F.lit("clash"))
    out = df.select("text", pieces.encode_pieces(F.col("text"), end_id=True).alias("ids")).withColumn("back", pieces.decode_pieces(F.col("ids")))
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        want = LIBRARY.encode(r.text or "") + [2]
        assert r.ids == want and r.back == LIBRARY.decode(want)
    assert spark.createDataFrame([], "t string").select(pieces.encode_pieces(F.col("t"))).count() == 0
    assert spark.sql("select cast(null as array<int>) as ids").select(pieces.decode_pieces(F.col("ids")).alias("t")).first().t is None


# ------------------------------------------------------------------------------------------- alignment


def plain_links(text):
    """Two pointers, one step at a time: A ids, B ids, links, groups."""
    if not text:
        return [], [], [], []
    line = f" {text}".encode()
    a, b = BYTES.encode(f" {text}", add_special_tokens=False).ids, LIBRARY.encode(text)
    raw_a = [alignment.PlainTokens.of(pieces.path_of("byte_bpe_50k.json"), None).raw[k] for k in a]
    raw_b = [bytes([int(p[3:5], 16)]) if LIBRARY.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [LIBRARY.id_to_piece(k)]]
    if b"".join(raw_a) != line or b"".join(raw_b) != line:
        return [], [], [], []
    i = j = 0
    end_a, end_b, links, groups, own = len(raw_a[0]), len(raw_b[0]), [], [], ([], [])
    while True:
        links.append((a[i], b[j]))
        if end_a <= end_b:
            own[0].append(a[i])
        if end_b <= end_a:
            own[1].append(b[j])
        if end_a == end_b:
            groups.append(own)
            own = ([], [])
        step_a, step_b = end_a <= end_b, end_b <= end_a
        i, j = i + step_a, j + step_b
        if i == len(a) or j == len(b):
            assert i == len(a) and j == len(b)
            return a, b, links, groups
        end_a += len(raw_a[i]) if step_a else 0
        end_b += len(raw_b[j]) if step_b else 0


def plain_report(rows):
    each = [(k, *plain_links(t)) for k, t in rows]
    counts = Counter(x for e in each for x in e[3])
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for k, a, b, links, groups in each:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[x] == highest[x[1]] for x in links)
        out.append((k, len(a), len(b), len(groups), len(links), best, sum(counts[x] for x in links), sha(line) if groups else ""))
    return sorted(out, key=str)


COLUMNS = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most, portion", [(500_000, 1 << 19), (3, 40), (0, 1 << 19)])
def test_alignment_is_the_plain_one(spark, monkeypatch, most, portion):
    monkeypatch.setattr(alignment, "PORTION", portion)
    rows = list(enumerate(ODD)) + [(None, "the thing"), (None, "the thing"), (7, "the other"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("id", F.lit(1)).repartition(3)
    out = sorted((tuple(r) for r in alignment.alignment_report(df, most=most).select(*COLUMNS).collect()), key=str)
    assert out == plain_report(rows)


def test_special_strings_are_plain_and_odd_bytes_leave_no_tokens(spark):
    df = spark.createDataFrame([(1, "<|endoftext|>"), (2, "a▁b"), (3, "")], "doc_id long, text string")
    out = {r.id: r for r in alignment.align_tokens(df).collect()}
    assert out[1].n_a == len(BYTES.encode(" <|endoftext|>", add_special_tokens=False).ids) > 1
    assert (out[2].n_a, out[2].n_b, out[2].n_links, out[2].groups_sha256, out[2].pair_a) == (0, 0, 0, "", [])
    assert alignment.alignment_report(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_merging_ends_meets_every_overlap_once(x, y):
    gap = sum(x) - sum(y)
    x, y = (x, y + [gap]) if gap > 0 else (x + [-gap], y) if gap < 0 else (x, y)
    ends_a, ends_b = np.cumsum(x), np.cumsum(y)
    ends, a, b, stop_a, stop_b = alignment.merge_ends(ends_a, ends_b)
    assert ends[stop_a].tolist() == ends_a.tolist() and ends[stop_b].tolist() == ends_b.tolist()
    over = [(i, j) for i in range(len(x)) for j in range(len(y)) if max(ends_a[i] - x[i], ends_b[j] - y[j]) < min(ends_a[i], ends_b[j])]
    assert list(zip(a.tolist(), b.tolist())) == over
    assert ends[stop_a & stop_b].tolist() == sorted(set(ends_a.tolist()) & set(ends_b.tolist()))


def test_joined_back_is_whole_beyond_the_bound(spark):
    rows = spark.range(2_000).select(F.expr("cast(sqrt(id) as int)").alias("k"), "id")
    totals = common.checkpointed(rows.groupBy("k").agg(F.count(F.lit(1)).alias("times")))
    want = sorted(map(tuple, rows.join(totals, "k").select("k", "id", "times").collect()))
    for most in (0, 1, 10, 30, 1_000):
        assert sorted(map(tuple, common.joined_back(rows, totals, ["k"], "times", most).select("k", "id", "times").collect())) == want


# ------------------------------------------------------------------------------------------- codebooks


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Full recounts with Python integers."""
    kept = [(k, [math.floor(4096 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    at = [k * len(first[0][1]) // parts for k in range(parts + 1)]
    books = [[r[1][at[p] : at[p + 1]] for r in first] for p in range(parts)]
    far = lambda x, y: sum((i - j) ** 2 for i, j in zip(x, y))

    def assign(v):
        return [min((far(v[at[p] : at[p + 1]], e), k) for k, e in enumerate(books[p])) for p in range(parts)]

    for _ in range(rounds):
        chosen = [[a[1] for a in assign(v)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[at[p] : at[p + 1]] for (_, v, _), c in zip(kept, chosen) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    total = Counter()
    found = []
    for k, v, label in kept:
        best = assign(v)
        error = sum(d for d, _ in best)
        total[label] += error
        found.append((k, "".join(f"{e:02x}" for _, e in best), error, label))
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted(((k, c, e, total[label]) for k, c, e, label in found), key=str), digest


SCHEMA = "vec_id long, embedding array<float>, label int"


def random_vectors(n, size, seed, spread=1.0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, size))
    return [(k, (spread * (centres[k % 5] + 0.4 * rnd.normal(size=size))).astype(np.float32).tolist(), int(k % 3) if k % 4 else None) for k in range(n)]


@pytest.mark.parametrize("n, size, seed", [(400, 16, 1), (60, 8, 2), (9, 8, 3), (1, 24, 4), (300, 64, 5)])
def test_codes_are_those_of_full_recounts(spark, monkeypatch, n, size, seed):
    monkeypatch.setattr(codebooks, "PORTION", 37)
    rows = random_vectors(n, size, seed)
    coded, books = codebooks.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want, digest = plain_codes(rows)
    assert sorted((tuple(r) for r in coded.select("id", "code", "error", "label_error").collect()), key=str) == want
    assert books.sha256 == digest
    assert books.moved[0] == 8 * n and sum(books.moved[1:]) <= 5 * 8 * n


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_vectors(40, 8, 7)
    rows += [(100, None, 1), (101, [0.0] * 7 + [None], 1), (102, [nan] * 8, 1), (103, [0.0] * 7 + [-inf], None), (None, [0.5] * 8, None), (3, rows[3][1], 2), (3, rows[3][1], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit("clash")).withColumn("code", F.lit("clash")).withColumn("id", F.lit(0))
    coded, books = codebooks.compress(df)
    want, digest = plain_codes(rows)
    assert sorted((tuple(r) for r in coded.select("id", "code", "error", "label_error").collect()), key=str) == want and books.sha256 == digest
    # Ties everywhere, an empty vector, vectors of another length, an empty table.
    same = [(k, [0.25] * 8, 1) for k in range(30)]
    coded, books = codebooks.compress(spark.createDataFrame([*same, (99, [0.5] * 5, 1)], SCHEMA))
    assert [(r.code, r.error) for r in coded.collect()] == [("00" * 8, 0)] * 30 and books.moved == (240, 0)
    assert codebooks.compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA))[0].count() == 2
    coded, books = codebooks.compress(spark.createDataFrame([], SCHEMA))
    assert coded.count() == 0 and books.sha256 == sha("")


def test_uneven_parts_and_bounds(spark):
    rows = random_vectors(50, 13, 8)
    coded, books = codebooks.compress(spark.createDataFrame(rows, SCHEMA), parts=4, entries=3, rounds=4)
    want, digest = plain_codes(rows, 4, 3, 4)
    assert sorted((tuple(r) for r in coded.select("id", "code", "error", "label_error").collect()), key=str) == want and books.sha256 == digest
    with pytest.raises(ValueError):
        codebooks.compress(spark.createDataFrame(rows, SCHEMA), entries=257)
    with pytest.raises(Exception, match="a component times"):
        codebooks.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA))[0].count()


def test_only_changes_are_counted(spark):
    """The running sums after each round are those of a recount."""
    rows = random_vectors(300, 16, 9)
    whole = codebooks.integer_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", 4096)
    state, books = codebooks.learn(whole, 8, 16, 6)
    assert books.moved[1] < books.moved[0] and books.moved[-1] < books.moved[1]
    again, _ = codebooks.learn(whole.repartition(5), 8, 16, 6)
    assert sorted(state.select("id", "code").collect()) == sorted(again.select("id", "code").collect())
