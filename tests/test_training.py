import functools
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fuseline.functions import simplex
from fuseline.operators import pairs
from fuseline.plans.model import Model, Point, ReservedIds, promoted
from fuseline.plans import train as training
from fuseline.plans.heap import PairTable
from fuseline.plans.model import fused_point
from fuseline.plans.train import settled
from fuseline.sources.corpus import from_bytes, to_sequences
from fuseline.streaming.encode import encode_stream, token_rate

#: Small corpora in the driver, where a test does not ask for workers.
train = functools.partial(training.train, local=True)
WORDS = "river rain stone boat cloud field path light moss reed heron wind slow bright under over along between every".split()


def prose(size, seed):
    """Lower-case sentences of some common words and many rare ones."""
    rng = random.Random(seed)
    rare = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(150)]
    out = ""
    while len(out) < size:
        out += " ".join(rng.choice(WORDS if rng.random() < 0.6 else rare) for _ in range(rng.randint(4, 12))) + ". "
    return out[:size].encode()


def naive_train(corpus, target, mode="frequency", window=5, min_count=2):
    """The specification in plain Python: a full scan for every merge over one byte sequence."""
    ids, points, rules, known = list(corpus), dict(Model().points), [], {}

    def distance(a, b):
        if (a, b) not in known:
            known[a, b] = 0.0 if a == b else simplex.np_distance(points[a].vector, points[b].vector)
        return known[a, b]

    while 256 + len(rules) < target:
        if mode == "entropy":
            contexts = {}
            for i in range(len(ids) - 1):
                contexts.setdefault((ids[i], ids[i + 1]), []).append((*ids[max(0, i - window) : i], *ids[i + 2 : i + 2 + window]))
            counts = {p: len(c) for p, c in contexts.items()}
        else:
            counts = Counter(zip(ids, ids[1:]))
        best = None
        for (a, b), n in counts.items():
            if n < min_count:
                continue
            score = n * min((n / len(ids)) / (distance(a, b) + 0.1) * 1000.0, 100.0)
            if mode == "entropy":
                by_count = Counter(Counter(contexts[a, b]).values())
                h = 0.0
                for c in sorted(by_count):
                    h -= (c / n) * np.log(c / n + 1e-10) * by_count[c]
                score *= 1.0 / (h + 0.1)
            if best is None or (-score, a, b) < best:
                best = (-score, a, b)
        if best is None:
            break
        _, a, b = best
        new = 256 + len(rules)
        points[new] = fused_point(points, a, b)
        rules.append((a, b, new))
        out, i = [], 0
        while i < len(ids):
            hit = i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b
            out.append(new if hit else ids[i])
            i += 2 if hit else 1
        ids = out
    return rules


TRUTH = b"the geometry is the truth trust the phi. " * 20
RUNS = b"aaaa b " * 10
ASCII = (b"a quick sentence about rivers and rain; the river rose, and the rain went on. " * 110)[:8000]
UNICODE = ("café naïve “quoted” αβγ x² 漢字 — résumé. " * 200).encode()[:8000]
#: Pairs of the same bytes both ways round, equally often.
MIRRORED = (bytes([9, 4, 7, 7, 4, 9]) + b"-" + bytes([4, 9, 9, 4]) + b"-") * 500


@pytest.mark.parametrize(
    ("corpus", "mode", "window", "rules", "score", "length"),
    [
        (TRUTH, "entropy", 5, [(111, 109), (101, 256), (257, 101), (104, 32), (116, 259), (260, 116)], 6795.2792, 800),
        (TRUTH, "frequency", 3, [(32, 116), (104, 101), (256, 257), (258, 32), (256, 114), (260, 117)], 9900.0, 721),
        (RUNS, "entropy", 5, [(32, 97), (98, 256), (97, 32), (257, 97), (258, 259), (97, 260)], 9000.0, 61),
        (RUNS, "frequency", 3, [(97, 97), (32, 98), (256, 256), (257, 32), (258, 259), (260, 260)], 3000.0, 50),
    ],
)
def test_golden_rules(spark, corpus, mode, window, rules, score, length):
    out = train(from_bytes(spark, corpus), 262, mode, window, 2)
    assert [s.rule[:2] for s in out.steps] == rules
    assert [s.rule[2] for s in out.steps] == list(range(256, 262))
    assert out.steps[0].score == pytest.approx(score, abs=1e-4) and out.steps[0].length == length


@pytest.mark.parametrize("corpus", [ASCII, UNICODE, MIRRORED])
def test_frequency_mode_equals_the_specification(spark, corpus):
    out = train(from_bytes(spark, corpus), 272, "frequency", 3, 2, cut_every=5)
    text = corpus.decode("utf-8", "ignore") if corpus is UNICODE else None
    assert text is None or corpus.decode("utf-8", "replace")
    assert [s.rule for s in out.steps] == naive_train(corpus, 272, "frequency", 3, 2)


@pytest.mark.parametrize(("target", "seed"), [(300, 1), (512, 2), (1024, 3), (4096, 4)])
def test_larger_vocabularies_equal_the_specification(spark, target, seed):
    corpus = prose(8000, seed)
    out = train(from_bytes(spark, corpus), target, "frequency", 3, 2)
    assert [s.rule for s in out.steps] == naive_train(corpus, target, "frequency", 3, 2)


@pytest.mark.parametrize("size", [2000, 6000])
def test_guessed_merges_change_nothing(spark, size):
    """Spread over rows and scanned in batches, the corpus gives the rules of one merge at a time."""
    rows = [(k, t) for k, t in enumerate(prose(size, 7).decode().split(". "))]
    seqs = to_sequences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    one = train(seqs, 330, "frequency", 3, 2)
    many = train(seqs, 330, "frequency", 3, 2, local=False, cut_every=20)
    assert [s.rule for s in one.steps] == [s.rule for s in many.steps] and len(one.steps) == 74
    assert one.report == many.report
    tokens = lambda out: sorted(map(tuple, out.seqs.collect()))
    assert tokens(one) == tokens(many)


def test_entropy_mode_equals_the_specification(spark):
    corpus = prose(3000, 5)
    want = naive_train(corpus, 300, "entropy", 5, 2)
    assert [s.rule for s in train(from_bytes(spark, corpus), 300, "entropy", 5, 2).steps] == want
    spread = train(from_bytes(spark, corpus), 262, "entropy", 5, 2, local=False)
    assert [s.rule for s in spread.steps] == want[:6]


def test_known_entropies_are_those_of_a_full_count(spark, monkeypatch):
    """What a merge leaves known is what counting all contexts again gives."""
    seen = []

    def checked(table, corpus, length, window, known, own=training._by_entropy):
        out = own(table, corpus, length, window, known)
        again = corpus.entropies(list(known), window)
        assert all(abs(known[p] - again[p]) < 1e-9 for p in again)
        seen.append(len(known))
        return out

    monkeypatch.setattr(training, "_by_entropy", checked)
    train(from_bytes(spark, prose(2500, 6)), 300, "entropy", 5, 2)
    assert len(seen) >= 44 and max(seen) > 64


def test_the_heap_gives_the_best_pair():
    rng = random.Random(3)
    table = PairTable(dict(Model().points), min_count=3)
    for length in range(3000, 200, -40):
        changes = [(rng.randrange(97, 110), rng.randrange(97, 110), rng.randint(-6, 9)) for _ in range(40)]
        total = Counter()
        for a, b, n in changes:
            total[a, b] += n
        low = {p: -int(table.count[table.index[p]]) if p in table.index else 0 for p in total}
        table.push_changed([(*p, max(n, low[p])) for p, n in total.items()])
        live = [k for k in range(table.size) if table.count[k] >= 3]
        want = min(((-float(table.count[k]) * table.coupling(k, length), *table.pairs([k])[0]) for k in live), default=None)
        got = table.pop_best(length)
        assert (got is None) == (want is None)
        if got is not None:
            assert table.pairs([got[0]])[0] == want[1:] and got[1] == -want[0] and table.pop_best(length) == got
            top = table.top(7, length).tolist()
            assert top == sorted(live, key=lambda k: (-table.products(length)[k], *table.pairs([k])[0]))[:7]


def test_counts_equal_a_recount_after_every_merge(spark):
    corpus = b"z" * 41 + b"-" + b"z" * 26 + b"yzzzzy" * 9
    out = train(from_bytes(spark, corpus), 262, "frequency", min_count=1)
    assert out.steps[0].rule[:2] == (122, 122) and [s.rule for s in out.steps] == naive_train(corpus, 262, "frequency", min_count=1)
    spread = train(from_bytes(spark, corpus), 262, "frequency", min_count=1, local=False)
    assert [(s.rule, s.merged, s.length) for s in spread.steps] == [(s.rule, s.merged, s.length) for s in out.steps]
    length = len(corpus)
    for s in out.steps:
        length -= s.merged
        assert s.length == length
    tokens = out.seqs.agg(F.sum(F.char_length("seq"))).first()[0]
    assert tokens == out.report["n_tokens"] == length
    assert pairs.pair_counts(out.seqs).agg(F.sum("cnt")).first()[0] == length - 1


def test_pairs_do_not_span_rows_and_partitions_do_not_matter(spark):
    texts = [("the cat sat. " * (k % 4 + 1),) for k in range(40)]
    df = spark.createDataFrame(texts, "text string").withColumn("doc_id", F.xxhash64("text"))
    logs = [train(to_sequences(df.repartition(n)), 262, "frequency").steps for n in (1, 8)]
    assert [s.rule for s in logs[0]] == [s.rule for s in logs[1]]


def test_training_stops(spark):
    assert train(from_bytes(spark, b""), 300).steps == ()
    assert train(from_bytes(spark, b"abcdef"), 300).steps == ()
    seen = []
    out = train(from_bytes(spark, RUNS), 300, should_stop=lambda: len(seen) >= 2, on_step=seen.append)
    assert len(out.steps) == 2
    with pytest.raises(ValueError):
        train(from_bytes(spark, RUNS), 300, mode="other")


def test_resume_equals_one_run(spark):
    whole = train(from_bytes(spark, TRUTH), 262, "frequency", 3, 2)
    first = train(from_bytes(spark, TRUTH), 259, "frequency", 3, 2)
    rest = train(from_bytes(spark, TRUTH), 262, "frequency", 3, 2, model=first.model)
    assert rest.model.rules == whole.model.rules
    for k, p in whole.model.points.items():
        np.testing.assert_array_equal(p.vector, rest.model.points[k].vector)


def test_phi_mode_and_report(spark):
    out = train(from_bytes(spark, TRUTH), 259, "phi", 3, 2)
    assert len(out.steps) == len(out.model.phi_history) == 3 and all(s.gain is not None for s in out.steps)
    assert 0 < out.report["ratio"] < 1
    flat = train(from_bytes(spark, TRUTH), 270, "phi", 3, 2, kernel=lambda x: (0.5, 1.0), batch_accept=3)
    assert [s.rule for s in flat.steps] == naive_train(TRUTH, 270, "frequency", 3, 2)
    log = out.log(spark)
    assert log.count() == 3 and log.columns[0] == "step"


def test_settled():
    assert not settled([1.0] * 7) and settled([5.0, 3.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0]) and not settled([1.0, 2.0] * 6)


def test_checkpoints_keep_the_newest(spark, tmp_path):
    train(from_bytes(spark, TRUTH), 262, "frequency", 3, 2, save_every=1, save_to=str(tmp_path / "m"), keep=2)
    names = sorted(p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith("."))
    assert names == ["model-00000261", "model-00000262"]
    assert len(Model.load(spark, str(tmp_path / "m" / names[-1])).rules) == 6


# -------------------------------------------------------------------------------------------------- model


def test_model_files(spark, tmp_path):
    model = Model.from_rules([(97, 98, 256), (256, 99, 257)]).with_reserved(["<a>", "<b>"])
    assert all(p["coord_id"] == int(k) and len(p["vector"]) == 64 for k, p in json.loads(model.to_json())["vocab"].items())
    again = Model.from_json(model.to_json())
    assert again.rules == model.rules and again.reserved == model.reserved and again.size == model.size
    for k, p in model.points.items():
        np.testing.assert_allclose(p.vector, again.points[k].vector, atol=1e-15)
        assert (p.name, p.scale) == (again.points[k].name, again.points[k].scale)
    model.save(spark, str(tmp_path / "m"))
    assert Model.load(spark, str(tmp_path / "m")).rules == model.rules
    model.save_tables(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/vocab")).count() == model.size
    assert [r.new_id for r in spark.read.parquet(str(tmp_path / "t/rules")).orderBy("rank").collect()] == [256, 257]


def test_older_model_files():
    bare = Model.from_json(json.dumps({"merge_rules": [[97, 98, 256]], "vocab_size": 300}))
    assert bare.target == 300 and bare.dim == 64 and 256 in bare.points
    np.testing.assert_allclose(bare.points[256].vector, Model.from_rules([(97, 98, 256)]).points[256].vector)
    signed = {"256": {"vector": np.random.RandomState(0).randn(64).tolist()}}
    old = Model.from_json(json.dumps({"merge_rules": [[97, 98, 256]], "vocab": signed}))
    v = old.points[256].vector
    assert v.min() >= 0 and v.sum() == pytest.approx(1.0)


def test_reserved_ids():
    model = Model.from_rules([(97, 98, 256)]).with_reserved(["x", "y"])
    assert model.reserved == {"x": 257, "y": 258} and model.points[257].scale == "special"
    assert model.with_reserved(["x", "z"]).reserved["z"] == 260  # a known name still counts as a step
    np.testing.assert_allclose(model.points[257].vector, simplex.seeded_point(257 + 7919))
    assert ReservedIds(300).ids == {"<pad>": 300, "<bos>": 301, "<eos>": 302, "<unk>": 303} and ReservedIds(300).count == 4
    with pytest.raises(ValueError):
        ReservedIds(10)


def test_points_and_scales():
    model = Model.from_rules([(97, 98, 256), (256, 99, 257), (257, 257, 258), (258, 258, 259), (259, 259, 260), (260, 260, 261)])
    assert [model.points[k].scale for k in range(256, 262)] == ["char", "subword", "word", "phrase", "concept", "concept"]
    assert model.points[256].name == "<byte_61>+<byte_62>"
    assert Model.from_rules([(97, 98, 256)], decode_bytes=True).points[256].name == "ab"
    assert promoted("special", "byte") == "subword" and promoted("special", "byte", 0) == "char"
    with pytest.raises(ValueError):
        Model(points={0: Point(np.ones(3) / 3, "x", "byte")})
    assert Model().with_mode("code").mode == "code"


# ------------------------------------------------------------------------------------------------ streaming


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from fuseline.operators.codec import encode

    model = Model.from_rules([(116, 104, 256), (256, 101, 257)])
    rows = [(k, f"2024-01-01 00:{k:02d}:00", "the then that" * k) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, stream, mode in (("enc", encode_stream(source(), model), "append"), ("rate", token_rate(source(), model), "complete")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    want = {r.doc_id: r.s for r in df.select("doc_id", encode(F.col("text"), model).alias("s")).collect()}
    assert {r.doc_id: r.seq for r in spark.table("enc").collect()} == want
    per = spark.table("rate").groupBy("coord_id").agg(F.sum("cnt").alias("n")).collect()
    assert {r.coord_id: r.n for r in per}[257] == sum(s.count(chr(257)) for s in want.values())


@pytest.mark.parametrize("files", [1, 3, 7])
def test_streamed_pair_counts_are_those_of_the_batch(spark, tmp_path, files):
    """Any split into micro-batches, with a restart between them, ends with the batch's counts and the same best pair."""
    from fuseline.streaming.counts import follow, into_table, latest, pair_count_stream

    rows = [(k, prose(300, k).decode() if k % 5 else None) for k in range(21)]
    schema = "doc_id long, text string"
    table = PairTable(dict(Model().points), 2)
    for part in range(files):
        spark.createDataFrame(rows[part::files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # A new query on the same log in each turn is a restart: it knows the counts so far.
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = follow(pair_count_stream(source), str(tmp_path / "rows"), str(tmp_path / "log"), into_table(table))
        query.awaitTermination()
        assert query.exception() is None
    seqs = to_sequences(spark.createDataFrame(rows, schema))
    want = {(r.a, r.b): r.cnt for r in pairs.pair_counts(seqs).collect()}
    assert {(r.a, r.b): r.cnt for r in latest(spark, str(tmp_path / "rows")).collect()} == want
    assert {p: int(table.count[k]) for p, k in table.index.items()} == want
    whole = PairTable(dict(Model().points), 2)
    whole.push_changed([(*p, n) for p, n in want.items()])
    best, other = table.pop_best(6_000), whole.pop_best(6_000)
    assert table.pairs([best[0]]) == whole.pairs([other[0]]) and best[1] == other[1]


def test_sql_functions(spark):
    from fuseline.plans.sql import register

    register(spark, Model.from_rules([(116, 104, 256), (256, 101, 257)]).with_reserved(["<u>"]), "t_")
    row = spark.sql("SELECT t_encode_text('the<u>the') AS ids, t_decode_ids(t_encode_text('the<u>e')) AS back, t_nfc(NULL) AS none").first()
    assert row.ids == [257, 258, 257] and row.back == "the<u>e" and row.none is None
