"""Encoding on streams: the same narrow columns as in batch, and a windowed count of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import seq_ids
from ..operators.codec import encode
from ..plans.model import Model


def encode_stream(stream: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The stream with ``seq`` and ``n_tokens``; stateless, for any output mode."""
    encoded = stream.withColumn("seq", encode(F.col(text_col), model))
    return encoded.withColumn("n_tokens", F.char_length("seq").cast("long"))


def token_rate(stream: DataFrame, model: Model, ts_col: str = "ts", text_col: str = "text", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, coord_id, cnt) per tumbling window; rows later than the watermark are left out, as usual."""
    rows = stream.withWatermark(ts_col, late).withColumn("seq", encode(F.col(text_col), model))
    each = rows.select(ts_col, F.explode(seq_ids(F.col("seq"))).alias("coord_id"))
    counted = each.groupBy(F.window(ts_col, width).alias("w"), "coord_id").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(F.col("w.start").alias("start"), "coord_id", "cnt")
