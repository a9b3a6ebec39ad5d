"""Encoding with a SentencePiece model of merges, exactly as its library does, and decoding.

Such a model merges the neighbours whose concatenation is the best-scored piece, the leftmost first on a tie, until no
two neighbours make a piece.  The encoder here gets the same pieces without a queue of merges:

* one Aho-Corasick scan over all pieces tells the longest piece that begins at each place;
* a piece may follow another if merging their joined text again gives these two; a sequence whose neighbours are all
  compatible is the one that merging gives;
* from the left, the longest piece that is compatible is taken, then shorter ones; where none is, the last piece is
  given up for a shorter one, and the place is marked in a bit field, so that no place fails twice.

What fits behind a piece is remembered, as are short segments: a border that no piece crosses (before a space behind
another character, and beside characters that no piece holds) is never merged over, so the segments between such borders
encode on their own.  Memories are bounded: a full one becomes the older of two generations, from which what is
used again moves on.  A segment of any length is read whole, with work that follows its length.

Characters that are no piece become byte pieces.  Supported are models of merges with byte fallback, identity
normalisation and no user-defined pieces; any other raises ``ValueError``.

Odd input: null and empty texts have no pieces (with ``end_id`` only that id); ids that the model does not have decode as an
error; null ids decode to null; control ids decode to nothing, the unknown id to its surface.  Rows, ties and extra columns do not
matter: both directions are column expressions.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Entries of a generation of a worker's memories, and characters of the longest segment that is remembered.
MEMORY, SHORT = 3 << 16, 48

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the file format
_MERGES = 2


def path_of(model: str) -> str:
    """A file of the public tokenizers by its name, or a path as it is."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


class Memory(dict):
    """Values of a function, two generations of at most ``MEMORY`` each."""

    def __init__(self, function, longest: int | None = None):
        super().__init__()
        self.function, self.longest, self.older = function, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.function(key)
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.function(key)
        self[key] = found
        return found


class PieceModel:
    """Pieces, ids and settings of a model file, with the encoder's memories; one for each worker and file."""

    _loaded: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        pieces: list[tuple[str, float, int]] = []
        trainer, normal = {}, {}
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != _MERGES or not trainer.get(35, 0):
            raise ValueError("only models of merges with byte fallback are supported")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalisation that keeps white space is supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix_space = bool(normal.get(3, 1))
        self.end_id = trainer.get(42, 2)
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        surface = trainer.get(44, " ⁇ ".encode())
        self.kinds = [kind for _, _, kind in pieces]
        self.controls = {k for k, kind in enumerate(self.kinds) if kind == CONTROL}
        #: What each id stands for: bytes with spaces as spaces.
        self.raw = [
            {BYTE: lambda: bytes([int(p[3:5], 16)]), CONTROL: lambda: b"", UNKNOWN: lambda: surface}.get(
                kind, lambda: p.replace(SPACE, " ").encode()
            )()
            for p, _, kind in pieces
        ]
        self.known = Memory(self._segment_ids, SHORT)
        self.following = Memory(lambda key: self._first_fit(*key))
        self.shorter: dict[str, str] = {}

    @cached_property
    def automaton(self):
        """All pieces, for encoding only: a worker that decodes does not build it."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:  # every place has a match of one character
                found.add_word(p, (len(p) - 1, p))
        found.make_automaton()
        return found

    @cached_property
    def segments(self):
        """Finds the segments of a line."""
        crossed = any(x != SPACE and y == SPACE for p in self.ids for x, y in zip(p, p[1:], strict=False))
        held = "".join(map(re.escape, sorted({c for p in self.ids for c in p} - {SPACE})))
        spaced = f"[{held}{SPACE}]+" if crossed else f"{SPACE}*[{held}]+|{SPACE}+"
        return re.compile(f"{spaced}|[^{held}{SPACE}]+").findall

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    # ------------------------------------------------------------------------------------------ encoding

    def merge(self, text: str) -> list[str]:
        """Pieces by merging itself; for the short texts of two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, last: str, piece: str) -> bool:
        """Whether merging the joined text again gives these two pieces (``last`` is empty at the beginning)."""
        return self.merge(last + piece) == ([last, piece] if last else [piece])

    def shortened(self, piece: str) -> str:
        """The longest piece that is a proper prefix, at least one character; empty for one character."""
        found = self.shorter.get(piece)
        if found is None:
            found = next((piece[:k] for k in range(len(piece) - 1, 1, -1) if piece[:k] in self.ids), piece[:1] if len(piece) > 1 else "")
            if piece in self.ids:
                self.shorter[piece] = found
        return found

    def _first_fit(self, last: str, piece: str) -> str:
        """Of a piece and its shorter ones the first that fits behind ``last``; empty if none does."""
        while piece and not self.fits(last, piece):
            piece = self.shortened(piece)
        return piece

    def split(self, segment: str) -> list[str]:
        """The pieces of a segment; a character that is no piece stands for itself."""
        n = len(segment)
        longest = list(segment)
        for end, (back, piece) in self.automaton.iter(segment):  # ends ascend, so the last match at a place is its longest
            longest[end - back] = piece
        failed = bytearray((n >> 3) + 1)  # a bit for each place from which no compatible rest was found
        out: list[str] = []
        at, last, wish, following = 0, "", longest[0], self.following
        while True:
            piece = following[last, wish]
            while piece and failed[(end := at + len(piece)) >> 3] >> (end & 7) & 1:
                piece = (wish := self.shortened(piece)) and following[last, wish]
            if piece:
                out.append(piece)
                at += len(piece)
                if at == n:
                    return out
                last, wish = piece, longest[at]
                continue
            while True:  # no piece is left here: give up the one before for a shorter one
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                if wish := self.shortened(piece):
                    break
            last = out[-1] if out else ""

    def _segment_ids(self, segment: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.split(segment):
            k = self.ids.get(piece)
            if k is None:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(k)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text, without an end id."""
        if not text:
            return []
        line = text.replace(" ", SPACE)
        if self.prefix_space:
            line = SPACE + line
        return list(chain.from_iterable(map(self.known.__getitem__, self.segments(line))))

    # ------------------------------------------------------------------------------------------ decoding

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: runs of byte pieces are read as UTF-8, every byte that is none becomes U+FFFD; the space that
        encoding put in front is taken away again."""
        raw, kinds = self.raw, self.kinds
        if ids and not 0 <= min(ids) <= max(ids) < len(raw):
            raise ValueError("id out of range")
        # The first piece that leaves a text or a space behind loses the space in front; bytes do so too.
        first = 0
        while first < len(ids) and kinds[ids[first]] == CONTROL:
            first += 1
        joined = b"".join(map(raw.__getitem__, ids))
        if self.prefix_space and first < len(ids) and kinds[ids[first]] == NORMAL and joined[:1] == b" ":
            joined = joined[1:]
        if self.controls.isdisjoint(ids[first:-1]):  # else a control id parts two runs of bytes
            try:
                return joined.decode()
            except UnicodeDecodeError:
                pass
        out, run = [], bytearray()
        for n, k in enumerate(ids):
            if kinds[k] == BYTE:
                run += raw[k]
                continue
            if run:
                out.append(_loose(run))
                run = bytearray()
            piece = raw[k].decode()
            out.append(piece[1:] if n == first and self.prefix_space and kinds[k] == NORMAL and piece[:1] == " " else piece)
        return "".join(out) + _loose(run)


def _loose(data: bytes) -> str:
    """UTF-8, with one U+FFFD for each byte that is not part of a valid character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(data[at : at + size]).decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _encoded(pieces: PieceModel, texts: pa.Array, end_id: bool) -> pa.ListArray:
    flat, offsets = array("i"), array("i", [0])
    for t in texts:
        flat.extend(pieces.encode(t.as_py()))
        if end_id:
            flat.append(pieces.end_id)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))


def _decoded(pieces: PieceModel, rows: pa.ListArray) -> pa.Array:
    return pa.array((None if not r.is_valid else pieces.decode(r.values.to_numpy().tolist()) for r in rows), pa.string())


def encode_pieces(text: Column, model: str = MODEL, end_id: bool = False) -> Column:
    """Ids of a text as an array of integers; with ``end_id`` the model's end id comes last."""

    # Iterators are not chained, so that what decodes these ids does not encode the text again.
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = PieceModel.of(path_of(model))
        for texts in batches:
            yield _encoded(pieces, texts, end_id)

    return encoded(text)


def decode_pieces(ids: Column, model: str = MODEL) -> Column:
    """Text of an array of ids; null for null, and an error for an array that holds a null."""

    @F.arrow_udf(T.StringType())
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = PieceModel.of(path_of(model))
        for rows in batches:
            yield _decoded(pieces, rows)

    return decoded(ids)


def encode_and_decode(text: Column, model: str = MODEL, end_id: bool = False) -> Column:
    """``encode_pieces`` as ``ids`` and ``decode_pieces`` of them as ``decoded``, by one worker a task instead of two."""

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = PieceModel.of(path_of(model))
        for texts in batches:
            ids = _encoded(pieces, texts, end_id)
            yield pa.StructArray.from_arrays([ids, _decoded(pieces, ids)], ["ids", "decoded"])

    return both(text)
