"""Toxicity by a classifier chain of linear models on hashed n-grams of words.

Categories are predicted one after the other; each model sees the n-grams of the text and the probabilities of the
categories before it.  For training those probabilities are out-of-fold: each fold's come from a model that has
not seen it, as they would look on new texts.

Features are the 5-, 7- and 9-grams of the words' bytes, borders included, hashed to ``2 ** BITS`` numbers; presence, not
frequency, counts, so a long text does not dilute what it says.  A feature enters a model when its presence differs
between the category's values by more than ``least_z`` standard errors.

Training takes at most about ``per_class`` labelled documents of either value of the last category (the documented
bound; the choice goes by the id alone), which are found by joining the documents with that bounded list.  Feature
counts are added up by the executors; the driver gets at most ``4 * MOST`` candidate features and which of them each
sampled document has.  Prediction covers every document and the whole text.

Odd input: a null or empty text has no words and gets the models' base probabilities; labels that are null, repeated
(the largest counts) or without a document are handled, and with none to learn from all probabilities are 0; of
documents that share an id, one text is learned from (the smallest) and each row is judged; features of equal weight
go to the smaller number; an empty table gives no rows; additional columns stay as they are (one that has the
result's name is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, small_batches

BITS = 20
MOST = 1024
_ORDERS = (5, 7, 9)
_BORDER = 32
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else _BORDER for b in range(256))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, borders included, and the text each comes from."""
    parts = [b" " + (t or "").encode("utf-8").translate(_LETTERS) + b" " for t in texts]
    code = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    # Two borders stand between texts, so no n-gram without a border inside spans two of them.
    border = np.concatenate([[0], np.cumsum(code == _BORDER)])
    hashes, owners, h = [], [], np.full(len(code), 2166136261, np.uint32)
    for k in range(max(_ORDERS)):
        m = len(code) - k
        if m <= 0:
            break
        h = (h[:m] ^ code[k:]) * np.uint32(16777619)
        if k + 1 in _ORDERS:
            good = border[k : k + m] == border[1 : 1 + m]  # no border among the inner letters
            own = h[good]
            own = (own ^ own >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            hashes.append((own ^ own >> np.uint32(12)) & np.uint32((1 << BITS) - 1))
            owners.append(owner[:m][good])
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes).astype(np.int64), np.concatenate(owners).astype(np.int64)


def portions(texts: pa.Array, size: int = 1 << 19) -> Iterator[list[str | None]]:
    """The texts in lists of bounded length, since single ones may be very long."""
    held: list[str | None] = []
    room = size
    for t in texts:
        held.append(t.as_py())
        room -= len(held[-1] or "")
        if room <= 0:
            yield held
            held, room = [], size
    if held:
        yield held


def features(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, ascending; ``wanted`` marks the features that count."""
    found, owner = grams(texts)
    if wanted is not None:
        keep = wanted[found]
        found, owner = found[keep], owner[keep]
    return np.divmod(np.unique(owner << BITS | found), 1 << BITS)


@dataclass
class Linear:
    """Logistic regression: sparse weights by feature, weights of the earlier probabilities, bias."""

    index: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float
    dense: np.ndarray | None = field(default=None, repr=False)

    def scores(self, owner: np.ndarray, index: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(1 << BITS)
            self.dense[self.index] = self.weights
        z = np.bincount(owner, weights=self.dense[index], minlength=len(earlier)) + self.bias
        if len(self.chain):
            z = z + earlier @ self.chain
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(owner: np.ndarray, index: np.ndarray, earlier: np.ndarray, y: np.ndarray, least_z: float = 4.5, most: int = MOST, l2: float = 1.0, rounds: int = 200, step: float = 2.0, momentum: float = 0.95) -> Linear:
    """Full-batch gradient descent with momentum on the selected features."""
    n, pos = len(y), y.sum()
    if pos == 0 or pos == n:
        rate = np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6)
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    with_ = np.bincount(index, minlength=1 << BITS)
    in_pos = np.bincount(index, weights=y[owner], minlength=1 << BITS)
    p = with_ / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / pos + 1 / (n - pos)))
    z = np.where(with_ >= 4, np.abs(in_pos / pos - (with_ - in_pos) / (n - pos)) / spread, 0.0)
    chosen = np.sort(np.argsort(-z, kind="stable")[:most])
    chosen = chosen[z[chosen] > least_z]
    slot = np.full(1 << BITS, -1)
    slot[chosen] = np.arange(len(chosen))
    keep = slot[index] >= 0
    rows, cols = owner[keep], slot[index[keep]]
    w, c, b = np.zeros(len(chosen)), np.zeros(earlier.shape[1]), float(np.log(pos / (n - pos)))
    vw, vc, vb = np.zeros_like(w), np.zeros_like(c), 0.0
    scale = 1 / np.sqrt(np.maximum(with_[chosen] / n, 1e-3))  # rare features learn as fast as common ones
    for _ in range(rounds):
        score = np.bincount(rows, weights=(w * scale)[cols], minlength=n) + b + (earlier @ c if len(c) else 0.0)
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y
        vw = momentum * vw - step * (np.bincount(cols, weights=error[rows], minlength=len(w)) * scale / n + l2 * w / n)
        vc = momentum * vc - step * ((error @ earlier) / n + l2 * c / n)
        vb = momentum * vb - step * error.mean()
        w, c, b = w + vw, c + vc, b + vb
    return Linear(chosen, w * scale, c, float(b))


def fit_chain(texts: Sequence[np.ndarray], labels: np.ndarray, folds: int = 3, **options) -> list[Linear]:
    """A model for each column of ``labels``; earlier columns' probabilities feed later ones, out of fold."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    index = np.concatenate(texts) if len(texts) else np.zeros(0, np.int64)
    fold = np.arange(len(texts)) % folds
    earlier, models = np.zeros((len(texts), 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(fit(owner, index, earlier, y, **options))
        if k + 1 == labels.shape[1]:
            break
        out = np.zeros(len(texts))
        for f in range(folds):
            seen = fold != f
            place = np.cumsum(seen) - 1
            use = seen[owner]
            model = fit(place[owner[use]], index[use], earlier[seen], y[seen], **options)
            out[~seen] = model.scores(owner, index, earlier)[~seen]
        earlier = np.column_stack([earlier, out])
    return models


def _marks(index: np.ndarray) -> np.ndarray:
    """Which of all feature numbers are in ``index``."""
    marks = np.zeros(1 << BITS, bool)
    marks[index.astype(np.int64)] = True
    return marks


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 2000,
    **options,
) -> list[Linear]:
    """Models of the chain; ``categories`` maps names, in chain order, to 0/1 expressions over ``labels``."""
    names = list(categories)
    rows = (
        labels.select(F.col(id_col).alias("id"), *[c.cast("int").alias(n) for n, c in categories.items()])
        .dropna()
        .groupBy("id")
        .agg(*[F.max(n).alias(n) for n in names])
    )
    counts = {r[0]: r[1] for r in rows.groupBy(names[-1]).count().filter(F.col(names[-1]).isin(0, 1)).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.col("id"), F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    part = F.lit(0.0)
    for value, n in counts.items():
        part = F.when(F.col(names[-1]) == value, min(1.0, per_class / n)).otherwise(part)
    # Twice what is expected: a bound, not a cut; if it ever cuts, the smallest hashes stay.
    chosen = rows.filter(place < part).orderBy(place, "id").limit(4 * per_class)

    d = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # An id that repeats counts once, with the smallest of its texts.
    sample = checkpointed(d.join(F.broadcast(chosen), "id").groupBy("id", *names).agg(F.min("text").alias("text")))
    sums = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    if not sums["n"]:
        return []

    ys = [f"y{k}" for k in range(len(names))]

    def count(batches):
        for batch in batches:
            y = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(names))], axis=1)
            n, at = np.zeros((1 + len(names), 1 << BITS), np.int64), 0
            for texts in portions(batch.column(0)):
                own, found = features(texts)
                n[0] += np.bincount(found, minlength=1 << BITS)
                for k in range(len(names)):
                    n[k + 1] += np.bincount(found, weights=y[at + own, k], minlength=1 << BITS).astype(np.int64)
                at += len(texts)
            seen = np.flatnonzero(n[0])
            yield pa.record_batch([pa.array(seen), *(pa.array(c[seen]) for c in n)], names=["f", "n", *ys])

    counted = (
        sample.select("text", *names)
        .mapInArrow(count, ", ".join(f"{c} long" for c in ("f", "n", *ys)))
        .groupBy("f")
        .agg(*[F.sum(c).alias(c) for c in ("n", *ys)])
    )
    total, z = sums["n"], F.lit(0.0)
    for name, y in zip(names, ys, strict=True):
        pos = sums[name]
        if 0 < pos < total:
            p = F.col("n") / total
            spread = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / pos + 1 / (total - pos)))
            z = F.greatest(z, F.abs(F.col(y) / pos - (F.col("n") - F.col(y)) / (total - pos)) / spread)
    likely = counted.filter("n >= 4").select("f", z.alias("z")).filter("z > 3").orderBy(F.desc("z"), "f").limit(4 * MOST)
    wanted = _marks(likely.toArrow().column(0).to_numpy())

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def present(texts: pa.Array) -> pa.Array:
        out = []
        for part in portions(texts):
            own, found = features(part, wanted)
            out += np.split(found, np.searchsorted(own, np.arange(1, len(part))))
        return pa.array(out, pa.list_(pa.int64()))

    table = sample.select("id", present("text").alias("w"), *names).orderBy("id", *names).toArrow()
    y = np.stack([table.column(n).to_numpy().astype(np.int64) for n in names], axis=1)
    return fit_chain([np.array(w, np.int64) for w in table.column("w").to_pylist()], y, **options)


def with_toxicity(docs: DataFrame, models: list[Linear], names: Sequence[str], into: str = "toxicity", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``into`` that holds the probability of each category."""
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    if not models:
        return docs.withColumn(into, F.struct(*[F.lit(0.0).alias(n) for n in names]))
    shared = docs.sparkSession.sparkContext.broadcast(models)  # at most MOST weights each
    wanted = _marks(np.concatenate([m.index for m in models]))

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        out = [np.zeros((0, len(names)))]
        for part in portions(texts):
            owner, index = features(part, wanted)
            p = np.zeros((len(part), 0))
            for model in shared.value:
                p = np.column_stack([p, model.scores(owner, index, p)])
            out.append(p)
        p = np.concatenate(out)
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(len(names))], list(names))

    return small_batches(docs).withColumn(into, predict(F.col(text_col).cast("string")))
