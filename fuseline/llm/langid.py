"""Language identification with language-bitmask n-gram filters.

Training.  From labelled rows (a hash sample of about ``per_language`` documents of each language, the documented
bound; the choice depends on the id alone) the 2- to 4-grams of letters are counted, word borders included.  An
n-gram belongs to each language in which it is at least ``min_count`` times present and whose relative frequency
reaches ``share`` of the highest one.  The n-grams (at most ``max_ngrams`` of each language, the most frequent) go into one bit-sliced
Bloom filter: a slot holds a bit for each language (as many words of 64 as the languages need), k slots and-ed give the
bitmask of all languages that contain the n-gram.

Prediction.  The whole text's n-grams look up their bitmasks; the popcount of each language's bit plane over the
text, h of n n-grams, is corrected for the share f of false positives of that language's plane:
(h/n - f) / (1 - f), at least 0.  The largest wins (ties: the first language in order); the score is the winner's
share of the languages' sum, 0 where nothing is known.

Memory.  Texts are taken in portions of ``PORTION`` characters, and a longer text is cut where a word ends (inside a word
that is itself so long, with the letters that n-grams across the cut need), so that its pieces have the n-grams of the
whole; their counts add up.

Odd input: a null text and one without a letter give ``und`` with score 0; rows without a language or an id are not
learned from; with nothing to learn from every text is ``und``; repeated rows count and are judged each by itself; an
empty table gives no rows; additional columns stay as they are (one that has the result's name is replaced).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh_name, small_batches

UNKNOWN = "und"
RESULT = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("share", T.DoubleType())]
)
PORTION = 1 << 17
_ORDERS = (2, 3, 4)
_BORDER = 1

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)
        _letters.append(table)
    return _letters[0]


def pieces(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """A text in lower case in pieces of about ``size`` characters; the flag marks one whose last letters belong to the next
    piece, where they are once more."""
    text = text.lower()
    overlap = max(_ORDERS) - 1
    at = 0
    while len(text) - at > 2 * size:
        cut = at + size
        gap = next((k for k in range(cut, min(len(text), cut + size)) if not text[k].isalpha() and text[k - 1].isalpha()), None)
        if gap is not None:
            yield text[at:gap], False
            at = gap
        elif text[cut : cut + overlap].isalpha() and text[cut - 1].isalpha():
            yield text[at : cut + overlap], True
            at = cut
        else:  # no word ends far and wide; what comes first in the next piece must be the border before its word
            cut -= text[cut].isalpha()
            yield text[at:cut], False
            at = cut
    yield text[at:], False


def portions(texts: Iterable[str | None], size: int = 0) -> Iterator[tuple[list[str], list[bool], list[int]]]:
    """Pieces, their flags and the position of the text that each comes from, in lists of bounded length."""
    size = size or PORTION
    held, flags, owner, room = [], [], [], size
    for k, t in enumerate(texts):
        for piece, flag in pieces(t or "", size):
            held.append(piece)
            flags.append(flag)
            owner.append(k)
            room -= len(piece)
            if room <= 0:
                yield held, flags, owner
                held, flags, owner, room = [], [], [], size
    if held:
        yield held, flags, owner


def grams(texts: list[str], open_: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of texts in lower case, the text each comes from, and whether each has a letter.  No n-gram
    begins in the last letters of a text that is ``open_``."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    open_ = open_ or [False] * len(texts)
    sizes = np.array([len(p) for p in parts], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(len(texts), bool)
    flat = np.full(int(sizes.sum()) + len(texts), ord(" "), np.uint32)
    late = np.zeros(len(flat), bool)  # letters that the next piece has too
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    at = 0
    for p, more in zip(parts, open_, strict=True):
        flat[at : at + len(p)] = p
        at += len(p) + 1
        if more:
            late[at - max(_ORDERS) : at] = True  # with the border behind them
    letter = _letter_table()[flat]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    # Runs of anything else become one border.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.cumsum([0, *(sizes[:-1] + 1)])] = True  # the first character of each text
    code = np.where(letter, flat, np.uint32(_BORDER))[keep].astype(np.uint64)
    owner, late = owner[keep], late[keep]
    border = code == _BORDER
    hashes, owners = [], []
    for n in _ORDERS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        inner = np.zeros(m, bool)
        for k in range(1, n - 1):
            inner |= border[k : k + m]
        # A border may open or close an n-gram, not both at length two.
        bad = inner | (owner[:m] != owner[n - 1 :]) | late[:m]
        if n == 2:
            bad |= border[:m] & border[1:]
        h = np.full(m, 0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(n):
            h = (h ^ code[k : k + m]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        good = ~bad
        hashes.append(h[good])
        owners.append(owner[:m][good])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), has
    return np.concatenate(hashes), np.concatenate(owners), has


@dataclass
class Model:
    languages: list[str]
    slots: list[np.ndarray]  # a bitmask of languages in each slot: one array for every 64 languages
    hashes: int

    def plane(self, words: Sequence[np.ndarray], language: int) -> np.ndarray:
        """A language's bit of each bitmask."""
        word = words[language // 64]
        return word >> word.dtype.type(language % 64) & word.dtype.type(1)

    @property
    def false_positive(self) -> np.ndarray:
        fill = np.array([float(self.plane(self.slots, b).mean()) for b in range(len(self.languages))])
        return fill**self.hashes

    def slots_of(self, grams_: np.ndarray) -> list[np.ndarray]:
        step = (grams_ >> np.uint64(32)) | np.uint64(1)
        size = np.uint64(len(self.slots[0]) - 1)
        return [((grams_ + np.uint64(k) * step) & size).astype(np.int64) for k in range(self.hashes)]

    def masks(self, grams_: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the bitmask of the languages that contain it."""
        places = self.slots_of(grams_)
        out = []
        for word in self.slots:
            mask = word[places[0]]
            for p in places[1:]:
                mask = mask & word[p]
            out.append(mask)
        return out

    def counts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text how many n-grams it has, how many of them each language has, and whether it has a letter."""
        n, letters = np.zeros(len(texts)), np.zeros(len(texts), bool)
        hits = np.zeros((len(texts), len(self.languages)))
        for part, open_, of in portions(texts):
            found, owner, has = grams(part, open_)
            own = np.array(of)
            np.add.at(n, own, np.bincount(owner, minlength=len(part)))
            letters[own[has]] = True
            words = self.masks(found)
            for b in range(len(self.languages)):
                np.add.at(hits[:, b], own, np.bincount(owner, weights=self.plane(words, b), minlength=len(part)))
        return n, hits, letters

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and the corrected share of its n-grams, for each text."""
        n, hits, has = self.counts(texts)
        false = self.false_positive
        share = np.clip((hits / np.maximum(n, 1)[:, None] - false) / np.maximum(1 - false, 1e-9), 0, 1)
        best = share.argmax(axis=1)
        top, total = share[np.arange(len(texts)), best], share.sum(axis=1)
        score = np.where(has & (total > 0), top / np.maximum(total, 1e-12), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score.tolist(), np.where(has, top, 0.0).tolist()


def _filter(languages: list[str], table: dict[str, np.ndarray], bits: int, hashes: int) -> Model:
    few = next((k for k in (np.uint8, np.uint16, np.uint32) if np.iinfo(k).bits >= len(languages)), np.uint64)
    model = Model(languages, [np.zeros(1 << bits, few) for _ in range(-(-len(languages) // 64))], hashes)
    for b, lang in enumerate(languages):
        word = model.slots[b // 64]
        for place in model.slots_of(table[lang]):
            word[place] |= few(1 << b % 64)
    return model


def train(
    docs: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 1500,
    min_count: int = 3,
    share: float = 0.02,
    max_ngrams: int = 200_000,
    bits: int = 21,
    hashes: int = 3,
) -> Model | None:
    """A model from the rows of ``docs`` for which ``learn_from`` holds; None if there are none.

    Bounds: ``per_language`` documents expected of each language, ``max_ngrams`` n-grams of each.  What reaches the driver and
    the workers are the languages' names, those n-grams of one language after the other, and 2 ** ``bits`` slots.
    """
    labelled = small_batches(docs).filter(learn_from & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    # The sample goes by the id alone, the same in every run and at every partitioning.
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(place < part[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part, open_, of in portions(t.as_py() for t in batch.column(1)):
                found, owner, _ = grams(part, open_)
                for lang in sorted({langs[k] for k in of}):
                    mine = np.array([langs[k] == lang for k in of])
                    gram, n = np.unique(found[mine[owner]], return_counts=True)
                    yield pa.record_batch(
                        [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    per_gram = checkpointed(
        counted.join(F.broadcast(totals), "lang")  # a row for each language
        .withColumn("freq", F.col("n") / F.col("total"))
        .groupBy("gram")
        .agg(F.max("freq").alias("top"), F.collect_list(F.struct("lang", "n", "freq")).alias("of"))
        .select("gram", "top", F.explode("of").alias("o"))
        .filter((F.col("o.n") >= min_count) & (F.col("o.freq") >= share * F.col("top")))
        .select(F.col("o.lang").alias("lang"), "gram", F.col("o.n").alias("n"))
    )
    languages, table = sorted(counts), {}
    for lang in languages:
        rows = per_gram.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(max_ngrams).select("gram")
        table[lang] = rows.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    return _filter(languages, table, bits, hashes)


def with_language(docs: DataFrame, model: Model | None, into: str = "language", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``into``: ``lang``, ``score`` and ``share`` (of the text's n-grams, those that the language
    has)."""
    if model is None:
        return docs.withColumn(into, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("share")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[], [], []]
        held: list[str | None] = []
        room = PORTION

        def flush():
            for c, own in zip(columns, shared.value.predict(held), strict=True):
                c.extend(own)

        for t in texts:
            held.append(t.as_py())
            room -= len(held[-1] or "")
            if room <= 0:
                flush()
                held, room = [], PORTION
        if held:
            flush()
        kinds = (pa.string(), pa.float64(), pa.float64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RESULT.names)

    return small_batches(docs).withColumn(into, predict(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_unidentified(docs: DataFrame, text_col: str = "text", least_share: float = 0.1, **options) -> DataFrame:
    """The rows whose text has a language, with their columns as they were.  Rejected are texts without a letter and those
    of whose n-grams no language has a share of ``least_share`` (letters, but no words of a known language); where there is
    nothing to learn from, all."""
    model = train(docs, ~held_out(options.get("id_col", "doc_id")), text_col=text_col, **options)
    name = fresh_name(docs.columns, "language")
    known = (F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.share") >= least_share)
    return with_language(docs, model, name, text_col).filter(known).select(*[F.col(f"`{c}`") for c in docs.columns])
