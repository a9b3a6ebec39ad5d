"""Encoding and decoding with a model, and what encoded text says about the vocabulary.

Encoding is a narrow map over rows; it runs unchanged on a stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import simplex
from ..functions.text import char_id, id_char, normalize_text, seq_ids
from ..plans.model import SCALES, Model
from ..sources.shared import small_batches
from .merging import Merger, expansions
from .rewrite import apply_rules


def base_with_reserved(text: Column, model: Model) -> Column:
    """Base sequence of a text in which every reserved surface is its one token.

    The raw text is split at the reserved surfaces first; the pieces are normalised on their own, so that neither
    normalisation nor a rule crosses a reserved token (no rule contains one)."""
    rx = model.reserved_pattern()
    latin = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    if rx is None:
        return latin(normalize_text(text, model.form))
    table = F.create_map(*[F.lit(x) for s, token in model.reserved.items() for x in (s, id_char(token))])
    pieces = F.split(text, rx, -1)
    hits = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    # One Python crossing for the whole row: pieces travel joined by a mark that no valid text holds twice in a row.
    normal = _normalize_pieces(pieces, model.form)
    woven = F.zip_with(normal, hits, lambda p, h: F.concat(latin(p), F.coalesce(F.element_at(table, h), F.lit(""))))
    return F.array_join(woven, "")


def _normalize_pieces(pieces: Column, form: str) -> Column:
    import unicodedata

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def normal(rows: pa.Array) -> pa.Array:
        return pa.array(
            [r and [p if p.isascii() else unicodedata.normalize(form, p) for p in r] for r in rows.to_pylist()],
            pa.list_(pa.string()),
        )

    return normal(pieces)


def encode(text: Column, model: Model, engine: str = "arrow") -> Column:
    """Encoded sequence of a text, reserved tokens included.

    ``arrow`` splits, normalises and fuses in one function of Arrow batches; ``sql`` leaves all but the normalisation to
    the JVM.  Both give the same sequence."""
    if engine != "arrow":
        return apply_rules(base_with_reserved(text, model), model.rules, engine)

    @F.arrow_udf(T.StringType())
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        many = encoder(model)
        for texts in batches:
            yield pa.array(many(texts.to_pylist()), pa.string())

    return encoded(text)


def encode_ids(text: Column, model: Model, engine: str = "arrow") -> Column:
    """Token ids of a text."""
    return seq_ids(encode(text, model, engine))


def expand_ids(seq: Column, model: Model) -> Column:
    """Ids of a sequence with every learned token expanded to bytes; reserved ids stay."""
    from .rewrite import undo_rules

    return seq_ids(undo_rules(seq, model.rules))


def encoder(model: Model):
    """Encoding of a list of texts as a plain function; nulls stay."""
    import unicodedata

    merger = Merger(model.rules)
    surfaces = sorted(model.reserved, key=len, reverse=True)
    split = re.compile("(" + "|".join(map(re.escape, surfaces)) + ")").split if surfaces else lambda t: [t]

    def base(text: str) -> str:
        out = []
        for k, piece in enumerate(split(text)):
            if k % 2:
                out.append(id_char(model.reserved[piece]))
            else:
                out.append((piece if piece.isascii() else unicodedata.normalize(model.form, piece)).encode().decode("latin-1"))
        return "".join(out)

    # No rule has a reserved token, so none is fused.
    return lambda texts: merger.apply([t and base(t) for t in texts])


def decoder(model: Model, strict: bool = False):
    """Decoding of one sequence as a plain function."""
    table = expansions(model.rules)
    surfaces = {id_char(token): name for name, token in model.reserved.items()}

    def decode_one(seq: str) -> str:
        parts = re.split("([^\x00-\xff])", seq.translate(table))
        for k, p in enumerate(parts):
            if k % 2 == 0:
                parts[k] = p.encode("latin-1").decode("utf-8", "replace")
            elif p in surfaces:
                parts[k] = surfaces[p]
            elif strict:
                raise ValueError(f"unknown token id {char_id(p)}")
            else:
                parts[k] = "\ufffd"
        return "".join(parts)

    return decode_one


def decode(seq: Column, model: Model, strict: bool = False) -> Column:
    """Text of an encoded sequence.  Runs of bytes between reserved tokens are decoded each on its own, with
    replacement where they are not valid UTF-8.  Ids the model does not know become U+FFFD, or fail when ``strict``."""

    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = decoder(model, strict)
        for seqs in batches:
            yield pa.array([s and one(s) for s in seqs.to_pylist()], pa.string())

    return text(seq)


# ------------------------------------------------------------------------------------------- analytics


def tokens(encoded: DataFrame, id_col: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(id, pos, coord_id), one row per token."""
    return encoded.select(id_col, F.posexplode(seq_ids(F.col(seq))).alias("pos", "coord_id"))


def attach_points(token_rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens with their point, name and scale."""
    return token_rows.join(vocab, "coord_id")


def token_frequency(encoded: DataFrame, seq: str = "seq") -> DataFrame:
    """(coord_id, cnt), counted inside each batch first."""
    import numpy as np

    from .pairs import _PAD, _codes, portions

    def partial(batches):
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            for live in portions(seqs):
                ids = _codes([seqs[k] for k in live])
                n = np.bincount(ids[ids != _PAD])  # ids are dense from 0
                found = np.flatnonzero(n)
                yield pa.record_batch(
                    [pa.array(found.astype(np.int32)), pa.array(n[found].astype(np.int64))], names=["coord_id", "cnt"]
                )

    return encoded.select(seq).mapInArrow(partial, "coord_id int, cnt long").groupBy("coord_id").agg(F.sum("cnt").alias("cnt"))


def velocity(encoded: DataFrame, vocab: DataFrame, id_col: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(id, n_tokens, velocity): mean distance between consecutive tokens, 0 with fewer than two.

    Pairs are counted inside each document first; a distance is computed once for each distinct pair of the corpus.
    """
    from .pairs import pair_counts, with_distance

    docs = encoded.select(id_col, F.char_length(seq).cast("long").alias("n_tokens"))
    pairs = pair_counts(encoded, by=[id_col], seq=seq)
    d = with_distance(pairs.select("a", "b").distinct(), vocab)
    mean = pairs.join(d, ["a", "b"]).groupBy(id_col).agg((F.sum(F.col("cnt") * F.col("d")) / F.sum("cnt")).alias("v"))
    return docs.join(mean, id_col, "left").select(id_col, "n_tokens", F.coalesce("v", F.lit(0.0)).alias("velocity"))


def compression(docs: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """(n_bytes, n_tokens, ratio) of a corpus; an empty corpus has ratio 1."""
    n, size = F.coalesce(F.sum(F.char_length(seq)), F.lit(0)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
    return docs.agg(size.cast("long").alias("n_bytes"), n.cast("long").alias("n_tokens")).select(
        "n_bytes", "n_tokens", F.when(F.col("n_bytes") > 0, F.col("n_tokens") / F.col("n_bytes")).otherwise(1.0).alias("ratio")
    )


def byte_lengths(model: Model) -> dict[int, int]:
    """Bytes that each token stands for; a reserved token counts its surface's bytes."""
    out = dict.fromkeys(range(256), 1)
    for a, b, new in model.rules:
        out[new] = out[a] + out[b]
    out.update({token: len(name.encode()) for name, token in model.reserved.items()})
    return out


def coverage(encoded: DataFrame, model: Model, seq: str = "seq") -> DataFrame:
    """One row: ``coverage`` (share of the text in tokens of scale word or coarser) and ``fallback`` (share at char or byte)."""
    spark = encoded.sparkSession
    sizes = byte_lengths(model)
    rows = [(k, p.scale, sizes.get(k, 0)) for k, p in model.points.items()]
    table = spark.createDataFrame(rows, "coord_id int, scale string, n_bytes int")
    weight = F.col("cnt") * F.col("n_bytes")
    share = lambda names: (
        F.coalesce(F.sum(F.when(F.col("scale").isin(*names), weight)), F.lit(0)) / F.greatest(F.sum(weight), F.lit(1))
    )
    return (
        token_frequency(encoded, seq)
        .join(table, "coord_id")
        .agg(
            share(SCALES[SCALES.index("word") :]).alias("coverage"),
            share(("byte", "char")).alias("fallback"),
        )
        .select(F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("fallback", F.lit(0.0)).alias("fallback"))
    )


def scale_distribution(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("scale").agg(F.count(F.lit(1)).alias("n"))


def average_coupling(stats: DataFrame) -> DataFrame:
    return stats.agg(F.avg("coupling").alias("avg_coupling"))


def scale_hierarchy(encoded: DataFrame, model: Model, id_col: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(id, scales): for each document the ids of its tokens by scale, in order of position.  One row holds one document's tokens, as its
    sequence does, so rows stay where they are; only rows that share their id (found by a count of ids) meet in a shuffle."""
    counted = encoded.groupBy(id_col).agg(F.count(F.lit(1)).alias("times"))
    twice = counted.filter("times > 1").select(id_col)
    if twice.isEmpty():
        return _scales_of_rows(encoded, model, id_col, seq)
    same = F.col(f"e.`{id_col}`").eqNullSafe(F.col(f"t.`{id_col}`"))
    once, several = (encoded.alias("e").join(twice.alias("t"), same, how) for how in ("left_anti", "left_semi"))
    table = encoded.sparkSession.createDataFrame([(k, p.scale) for k, p in model.points.items()], "coord_id int, scale string")
    rows = tokens(several, id_col, seq).join(table, "coord_id")
    lists = rows.groupBy(id_col, "scale").agg(F.sort_array(F.collect_list(F.struct("pos", "coord_id"))).alias("t"))
    grouped = lists.groupBy(id_col).agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("scale", F.transform("t", lambda x: x["coord_id"]).alias("ids"))))
        ).alias("scales")
    )
    return _scales_of_rows(once, model, id_col, seq).unionByName(grouped)


def _scales_of_rows(encoded: DataFrame, model: Model, id_col: str, seq: str) -> DataFrame:
    import numpy as np

    from .pairs import _PAD, _codes

    names = sorted({p.scale for p in model.points.values()})
    number = np.full(max(model.points) + 2, -1)
    for k, p in model.points.items():
        number[k] = names.index(p.scale)

    @F.arrow_udf("array<struct<scale: string, ids: array<int>>>")
    def split(column: pa.Array) -> pa.Array:
        texts = [s or "" for s in column.to_pylist()]
        ids = _codes(texts)
        doc = np.repeat(np.arange(len(texts)), [len(s) + 1 for s in texts])
        scale = number[np.minimum(ids, len(number) - 1)]
        known = (ids != _PAD) & (scale >= 0)
        ids, key = ids[known], doc[known] * len(names) + scale[known]
        order = np.argsort(key, kind="stable")
        ids, key = ids[order], key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
        entries = pa.StructArray.from_arrays([pa.array(names).take(pa.array(key[first] % len(names))), lists], ["scale", "ids"])
        ends = np.searchsorted(key[first] // len(names), np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)

    rows = small_batches(encoded).select(id_col, split(F.col(seq)).alias("entries_"))
    return rows.filter(F.size("entries_") > 0).select(id_col, F.map_from_entries("entries_").alias("scales"))


def vocab_stats(encoded: DataFrame, model: Model, stats: DataFrame) -> DataFrame:
    """One row: vocabulary size, average coupling, coverage and fallback rates."""
    return (
        coverage(encoded, model)
        .crossJoin(average_coupling(stats))  # one row each
        .select(F.lit(model.size).cast("long").alias("total"), "avg_coupling", "coverage", "fallback")
    )


