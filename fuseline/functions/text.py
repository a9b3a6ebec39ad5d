"""Text front-end: Unicode normalisation, bytes, base sequences, pre-token segments.

A token sequence is a string with one code point per token id (ids from 0xD800 on skip the surrogates).  Ids 0-255 are
bytes, so a text's base sequence is its UTF-8 bytes read as Latin-1, and the greedy left-to-right fusion of a pair is
the SQL function ``replace``.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMS = ("NFC", "NFD", "NFKC", "NFKD")

#: Letters and numbers of Unicode 14 and 15, which Java 17 does not know.
_RECENT = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a "
    "1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 "
    "11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 "
    "16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d "
    "1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 31350-323af"
)
_WORD = r"\p{L}\p{N}_[" + "".join("-".join(rf"\x{{{c}}}" for c in r.split("-")) for r in _RECENT.split()) + "]"

#: A word run or a punctuation run, each with the white space before it, or white space alone.  The classes spell out
#: what the reference semantics mean by word and white space, since the JVM's own shorthands differ.
SEGMENT = rf"(?U)[\s\x1c-\x1f]*[{_WORD}]+|[\s\x1c-\x1f]*[^{_WORD}\s\x1c-\x1f]+|[\s\x1c-\x1f]+"

_SURROGATES = 0xD800
MAX_ID = 0x10FFFF - 0x800


def id_char(token: int) -> str:
    """The character that stands for a token id."""
    if not 0 <= token <= MAX_ID:
        raise ValueError(f"token id out of range: {token}")
    return chr(token if token < _SURROGATES else token + 0x800)


def char_id(char: str) -> int:
    code = ord(char)
    return code if code < _SURROGATES else code - 0x800


def _form(form: str) -> str:
    if form not in FORMS:
        raise ValueError(f"unknown normalisation form {form!r}; known: {', '.join(FORMS)}")
    return form


def normalize_text(col: Column, form: str = "NFC") -> Column:
    """Unicode normal form of a string column; Spark has no such function, so this is one Arrow batch function,
    which hands ASCII strings through."""
    form = _form(form)

    @F.arrow_udf(T.StringType())
    def normal(texts: pa.Array) -> pa.Array:
        found = texts.to_pylist()
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in found], pa.string())

    return normal(col)


def to_bytes(col: Column, form: str = "NFC") -> Column:
    return F.encode(normalize_text(col, form), "UTF-8")


def normalize_bytes(col: Column, form: str = "NFC") -> Column:
    """Valid UTF-8 is normalised; anything else stays as it is."""
    as_text = col.cast("string")
    return F.when(F.is_valid_utf8(as_text), F.encode(normalize_text(F.make_valid_utf8(as_text), form), "UTF-8")).otherwise(col)


def bytes_to_seq(col: Column) -> Column:
    return F.decode(col, "ISO-8859-1")


def base_seq(col: Column, form: str | None = "NFC") -> Column:
    """Base sequence of a text: one character per byte.  ``form=None`` takes the text as it is."""
    return bytes_to_seq(F.encode(col if form is None else normalize_text(col, form), "UTF-8"))


def segments(col: Column) -> Column:
    """Pre-token segments of a text; they concatenate to the text."""
    return F.regexp_extract_all(col, F.lit(SEGMENT), F.lit(0))


def byte_segments(col: Column, pretokenize: bool = False, form: str = "NFC") -> Column:
    """Base sequences of the segments: one for the whole text, or one for each pre-token."""
    text = normalize_text(col, form)
    parts = segments(text) if pretokenize else F.array(text)
    return F.transform(parts, lambda s: F.decode(F.encode(s, "UTF-8"), "ISO-8859-1"))


def seq_ids(col: Column) -> Column:
    """Token ids of a sequence."""

    def of(char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < _SURROGATES, code).otherwise(code - 0x800)

    return F.when(F.char_length(col) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(col, ""), of))


class Normalizer:
    """Normalisation settings of a model."""

    def __init__(self, form: str = "NFC", pretokenize: bool = False):
        self.form, self.pretokenize = _form(form), pretokenize

    def text(self, col: Column) -> Column:
        return normalize_text(col, self.form)

    def bytes(self, col: Column) -> Column:
        return to_bytes(col, self.form)

    def raw_bytes(self, col: Column) -> Column:
        return normalize_bytes(col, self.form)

    def seq(self, col: Column) -> Column:
        return base_seq(col, self.form)

    def segments(self, col: Column) -> Column:
        return byte_segments(col, self.pretokenize, self.form)
