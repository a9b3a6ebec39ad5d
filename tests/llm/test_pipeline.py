"""The corpus pipeline against a brute-force version, and the SQL oracles of the training-data queries."""

import importlib.util
import random

import duckdb
import pytest

from tests.llm.test_operators import SCHEMA, brute_groups, brute_hits, brute_print, lower


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = random.Random(8)
    words = {"en": [f"en{k}word" for k in range(300)], "de": [f"wort{k}de" for k in range(300)]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    items = [(k, text("en", 20)) for k in range(3)]
    rows = []
    for k in range(60):
        lang = ("en", "de")[k % 2]
        rows.append([k, text(lang, rng.choice((5, 60, 1500))), lang])
    long = next(r for r in rows if len(r[1].split()) == 1500)
    rows += [[100, rows[4][1].upper(), "en"], [101, long[1] + " tail", long[2]], [102, None, "en"], [103, "", None], [104, "12 34 !!", "de"]]
    rows += [[105, "intro " + items[1][1] + " outro", "en"], [106, rows[4][1], "en"]]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def test_pipeline_matches_brute_force(spark, folder):
    import corpus_pipeline

    at, rows, items = folder
    left = [(k, t) for k, t, _ in rows if any(c.isalpha() for c in t or "")]
    left = [(k, t) for k, t in left if k == max(i for i, u in left if lower(u) == lower(t))]
    groups = brute_groups([brute_print(t) for _, t in left])
    left = [(k, t) for (k, t), g in zip(left, groups, strict=True) if k == min(i for (i, _), h in zip(left, groups, strict=True) if h == g)]
    left = [(k, t) for k, t in left if not brute_hits(items, t)[1]]
    out = corpus_pipeline.run(spark, at).collect()
    assert {r.doc_id for r in out} == {k for k, _ in left}
    assert sorted((r.doc_id, r.piece) for r in out) == sorted({(r.doc_id, r.piece) for r in out})
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_stages_keep_the_columns(spark, folder):
    import corpus_pipeline

    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op10_decontaminate"])
def test_sql_oracles(spark, folder, name):
    from fuseline.llm import queries

    at, _, _ = folder
    got = queries.QUERIES[name](spark, at)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{at}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))


def test_each_operator_has_one_query():
    import __spark_entry__ as entry

    if importlib.util.find_spec("corpus_pipeline"):
        assert "pipeline" in entry.queries()
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 14))
