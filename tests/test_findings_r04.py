"""One test for each mended finding of round 4."""

import duckdb


def by_sql(name, path):
    from fuseline.plans import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return sorted(con.sql(queries.oracle()[name]).fetchall())


def test_segment_bytes_of_odd_texts(spark, tmp_path):
    """an empty text had 0 bytes, where SQL has null, and letters newer than the JVM's Unicode were punctuation."""
    from fuseline.plans import queries

    odd = ["", None, " ", "\n\n", "a b", "a\U00011740 b", "xꟖ.ࡰ y", "\U00031350\U0002b739!", "éa  b", "aṍ0b", "\U0001e4f0 1"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("segment_bytes", "pretoken_count"):
        got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == by_sql(name, tmp_path), name


def test_contexts_travel_in_packed_rows():
    """each distinct context of a portion was a row of five numbers."""
    import numpy as np

    from fuseline.plans import blocks

    rng = np.random.default_rng(2)
    n = 20_000
    held = [(rng.integers(0, 3, n, np.int32), rng.integers(0, 60, n), rng.integers(0, 40, n)) for _ in range(2)]
    rows = blocks.context_rows(held, 5).to_pylist()
    assert len(rows) <= 15 and sum(len(r["body"]) for r in rows) == 16 * 2 * n
    pair, one, two = (np.concatenate(x) for x in zip(*held))
    for k in range(3):
        got = sorted(c for b in range(5) for c in blocks.context_counts([r["body"] for r in rows if (r["pair"], r["bucket"]) == (k, b)]).tolist())
        own = pair == k
        assert got == sorted(np.unique(one[own] * 1000 + two[own], return_counts=True)[1].tolist())


def test_few_exact_contexts_of_large_corpora(monkeypatch):
    """the contexts of every pair with half of the best one's count x coupling were shuffled."""
    import math

    from fuseline.plans import train
    from fuseline.plans.heap import PairTable
    from fuseline.plans.model import Model

    table = PairTable(dict(Model().points), 5)
    counts = {(97, 98): 40_000_000, **{(97, k): 24_000_000 + k for k in range(99, 105)}}
    table.push_changed([(*p, n) for p, n in counts.items()])
    monkeypatch.setattr(PairTable, "products", lambda self, length: self.count[: self.size] / 4)
    monkeypatch.setattr(PairTable, "coupling", lambda self, k, length: 0.25)
    read = []

    class Corpus:
        def entropies(self, wanted, window, classes=None):
            read.extend(wanted)
            assert sum((classes or {}).values()) <= 1 << 22
            return {**{p: math.log(counts[p]) for p in wanted}, **{p: math.log(n) - 0.01 for p, n in (classes or {}).items()}}

    at, score, *_ = train._by_entropy(table, Corpus(), 10**9, 5, {})
    assert table.pairs([at]) == [(97, 98)] and math.isclose(score, 1e7 / (math.log(4e7) + 0.1))
    assert read == [(97, 98)]


def test_one_scan_tells_exact_entropies_and_bounds(spark, monkeypatch):
    """groups and slices of any size give the entropies of one array."""
    import math

    from fuseline.plans import blocks, train
    from .test_merging import corpus

    seqs = corpus(spark, 200)
    own = blocks.Blocks(seqs, 20_000)
    pairs = [(a, b) for a, b, n in own.pair_counts() if n > 10]
    rows = seqs.filter("char_length(seq) > 0").orderBy("doc_id").collect()
    want = train._Local([(r["doc_id"], r["seq"]) for r in rows], seqs).entropies(pairs, 3)
    monkeypatch.setattr(blocks, "GROUP", 500)
    monkeypatch.setattr(blocks, "SLICE", 1000)
    found = own.entropies(pairs[::2], 3, {p: 1 << (k % 12) for k, p in enumerate(pairs[1::2])})
    assert found.keys() == want.keys()
    assert all(math.isclose(found[p], want[p], rel_tol=1e-12, abs_tol=1e-12) for p in pairs[::2])
    assert all(found[p] <= want[p] + 1e-9 for p in pairs)


def test_rows_of_a_table_are_narrow(spark):
    """an id took four bytes of each reading and writing of the table."""
    import numpy as np

    from fuseline.operators.merging import PAD
    from fuseline.plans import blocks
    from .test_merging import corpus

    for top, width in ((0xFFFF, 2), (0x10000, 4), (0x10001, 4)):
        ids = np.array([5, PAD, 0, top - 1, PAD], np.int32)
        assert len(blocks.packed(ids)) // len(ids) == width and blocks.unpacked(blocks.packed(ids)).tolist() == ids.tolist()
    assert blocks.unpacked(blocks.packed(np.zeros(0, np.int32))).tolist() == []
    assert blocks.unpacked(np.array([7, PAD], "<i4").tobytes()).tolist() == [7, PAD]  # tables of an older state
    own = blocks.Blocks(corpus(spark, 300), 10_000, block_tokens=1000)
    rows = own.table.collect()
    assert len({r["block"] for r in rows}) > 5 and all(len(r["ids"]) % 2 for r in rows)
    before = sum(n for *_, n in own.pair_counts())
    own.accept([(ord("e"), ord(" "), 0x10005)])
    own.cut()
    assert before - sum(n for *_, n in own.pair_counts()) > 0 and any(len(r["ids"]) % 2 == 0 for r in own.table.collect())


def test_first_tokens_read_few_documents(spark):
    """the sequences of all documents were computed for the first hundred tokens."""
    from pyspark.sql import functions as F

    from fuseline.plans import blocks
    from .test_merging import corpus

    docs = spark.createDataFrame([(k, None if k == 0 else "" if k == 1 else "abc" * k) for k in range(200)], "doc_id long, seq string").repartition(3)
    own = blocks.Blocks(docs, 1000)
    own.docs = docs.withColumn("seq", F.when(F.col("doc_id") < 100, F.col("seq")).otherwise(F.raise_error(F.lit("read"))))
    assert own.first(100) == list(map(ord, ("abc" * 100)[:100]))
    own.docs, own.sample = docs.filter("doc_id < 3"), None
    assert own.first(100) == list(map(ord, "abcabc"))


def test_a_pair_out_of_the_sample_ends_no_batch():
    """guesses ended, and so a scan of the corpus had few, at a pair that the sample did not hold."""
    from fuseline.operators.merging import to_ids
    from fuseline.plans.heap import PairTable
    from fuseline.plans.model import Model

    table = PairTable(dict(Model().points), 5)
    table.push_changed([(33, 33, 5000), (97, 98, 400), (98, 32, 300), (32, 97, 300), (99, 100, 200)])
    sample = to_ids(["ab ab cd ab", "ab cd ab ab"])
    planned = table.guess_by(sample, table.index[33, 33], 20_000, 4, 256)
    assert planned[0] == (33, 33) and len(planned) == 4


def test_the_table_is_written_anew_seldom(spark, monkeypatch):
    """a writing costs several scans, and came with each fifth of the tokens."""
    from fuseline.plans import blocks
    from .test_merging import corpus

    own = blocks.Blocks(corpus(spark, 50), 1000)
    monkeypatch.setattr(blocks.Blocks, "cut", lambda self: None)
    assert not own.accept([(ord("e"), ord(" "), 256)], 700)
    assert own.accept([(ord("t"), ord(" "), 257)], 590)
