"""The codec as SQL functions of a session."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import char_id, id_char
from ..operators.codec import decoder, encoder
from .model import Model


def register(spark: SparkSession, model: Model, prefix: str = "") -> None:
    """Registers ``{prefix}encode_text`` (text to ids), ``{prefix}decode_ids`` (ids to text) and ``{prefix}nfc``."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to_seqs = encoder(model)
        for texts in batches:
            seqs = to_seqs(texts.to_pylist())
            yield pa.array([None if s is None else [char_id(c) for c in s] for s in seqs], pa.list_(pa.int32()))

    @F.arrow_udf(T.StringType())
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to_text = decoder(model)
        for ids in batches:
            yield pa.array([None if x is None else to_text("".join(map(id_char, x))) for x in ids.to_pylist()], pa.string())

    @F.arrow_udf(T.StringType())
    def nfc(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    for name, function in (("encode_text", encode_text), ("decode_ids", decode_ids), ("nfc", nfc)):
        spark.udf.register(prefix + name, function)
