"""Queries of the training-data operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(common.table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(common.table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import with_hits

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = with_hits(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")
    listed = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out())
    return langid.with_language(docs, model).select(
        "doc_id",
        langid.held_out().alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(common.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import with_main_text

    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import with_verdict

    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return with_verdict(pages).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(common.table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import train, with_toxicity

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    models = train(docs, common.table(spark, sf_dir, "labels"), categories)
    return with_toxicity(docs, models, list(categories)).select(
        "doc_id",
        F.col("toxicity.low_quality").alias("p_low_quality"),
        F.col("toxicity.toxic").alias("p_toxic"),
        (F.col("toxicity.toxic") >= 0.5).alias("toxic"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(common.table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codebooks import compress

    coded, books = compress(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignment_report

    return alignment_report(common.table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_and_decode

    docs = common.table(spark, sf_dir, "documents").select("doc_id", encode_and_decode(F.col("text"), end_id=True).alias("both"))
    docs = docs.select("doc_id", "both.ids", "both.decoded")
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_toxicity": op4_toxicity, "op6_chat_format": op6_chat_format, "op9_secrets": op9_secrets, "op3_html_text": op3_html_text, "op8_url_filter": op8_url_filter, "op1_best_fit_packing": op1_best_fit_packing, "op5_language_id": op5_language_id, "op2_exact_dedup": op2_exact_dedup, "op7_simhash": op7_simhash, "op10_decontaminate": op10_decontaminate, "op11_vector_codes": op11_vector_codes, "op12_token_alignment": op12_token_alignment, "op13_pieces": op13_pieces}
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_W = _WORDS.format(_NORM)

OP10_SQL = f"""
WITH item AS (SELECT item_id, {_W} AS w FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM pattern),
doc AS (SELECT doc_id, {_W} AS w FROM documents),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)
),
hit AS (SELECT doc_id, item_id, i, n FROM place JOIN pattern USING (n, p)),
word AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def _op11_sql(rounds: int = 6) -> str:
    """Lloyd rounds with a full recount in each, as a chain of tables: parts, then assignment and codebook of every round."""

    def assigned(k: int) -> str:
        far = "list_sum(list_transform(list_zip(t.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""
a{k} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT r, p, e, {far} AS d FROM part AS t JOIN b{k} AS b USING (p)) GROUP BY r, p)"""

    def moved(k: int) -> str:
        return f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} AS b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x
    FROM (SELECT p, best.e AS e, i, sum(t.x[i])::BIGINT AS s, count(*) AS n FROM part AS t JOIN a{k} USING (r, p), unnest(range(1, len(t.x) + 1)) AS u(i) GROUP BY ALL)
    GROUP BY p, e) AS m USING (p, e))"""

    chain = ",".join(assigned(k) + "," + moved(k) for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS q(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM part WHERE r <= 16),{chain},{assigned(rounds)},
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


ORACLE = {"op11_vector_codes": _op11_sql(), "op10_decontaminate": OP10_SQL, "op2_exact_dedup": OP2_SQL}
