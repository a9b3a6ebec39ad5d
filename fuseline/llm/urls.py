"""URL filter: allow and block rules, and a logistic regression on hashed character n-grams for the rest.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: what follows up to
``?``, ``#`` or the end.  A rule (host and path) fits its host and all subdomains when the path starts with the
rule's; the longest one that fits wins.  Rules and parts are SQL expressions; the rules become a map from
host suffix to paths, so a URL looks up as many suffixes as its host has labels, however many rules there are.

The model is trained on the driver from ``labelled()``, a small table of URLs made of general words by a rule (or one that the caller gives):
n-grams of host and path are hashed to ``2 ** bits`` weights.  It judges every URL that no rule decides.

Odd input: a null URL or one without ``://`` has an empty host and an empty path and gets the model's verdict on
those; a URL of any length is judged whole (of its host only as many suffixes are formed as rules have labels);
hosts with empty labels keep them; of rules of the same length the larger text wins; repeated rows are judged each by
itself; empty tables give no rows; additional columns stay as they are (one that has the result's name is replaced).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, fresh_name

#: (verdict, host and path), in no particular order.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

# Words of the labelled table: topics that URL block lists name, words that such hosts put beside them, and everyday words.
BLOCK_WORDS = (
    "pills pharmacy viagra cialis casino poker slots roulette bets betting gambling lottery jackpot loans payday porn xxx adult cams "
    "escorts hookup spam backlinks seo adserver ads adclick banners tracker tracking popups malware phishing warez keygen cracked "
    "replica bitcoin giveaway prizes"
).split()
BLOCK_BESIDE = "cheap free win buy online best fast farm money now bonus deals".split()
ALLOW_WORDS = (
    "library news weather university museum science garden history recipes health travel sports music films books school city "
    "council theatre nature wiki docs code research animals bridge camera children church climate coffee cooking culture "
    "dance desert design doctor energy family farming fashion festival fishing forest furniture gallery geography harbour "
    "hospital island journal kitchen language law lessons letters market mathematics meteo mountain network notes ocean "
    "painting parents people philosophy photo physics planet poetry police politics radio railway river road shipping "
    "society stars stories street students summer teachers tennis things thought together tradition trees valley village "
    "voices water winter women world writers youth"
).split()
ALLOW_BESIDE = "my the open local north daily old first our national other green".split()
#: Harmless hosts of words that block lists also use.
ALLOW_MIXED = (
    "online-library track-and-field adult-education credit-union free-museum farm-shop best-recipes music-video win-win "
    "money-lessons trackside better-health alphabet bettina adsorption spillway pillar casing trading address adstock loaned"
).split()
_PREFIXES = ("", "www.", "m.", "blog.")
_PATHS = ("/en/12", "/de/345/", "/fr/67.html", "/es/890")


def labelled_hosts() -> list[tuple[str, frozenset[str], int]]:
    """(host, its words, 1 for block): each word alone and before, behind and beside four others of its list."""
    rows = []
    for label, words, beside in ((1, BLOCK_WORDS, BLOCK_BESIDE), (0, ALLOW_WORDS, ALLOW_BESIDE)):
        for k, w in enumerate(words):
            one, two = beside[k % len(beside)], beside[(k * 5 + 3) % len(beside)]
            for name in (w, f"{one}-{w}", f"{w}-{two}", f"{w}-{words[(k + 7) % len(words)]}"):
                rows.append((name, frozenset(name.split("-")), label))
    rows += [(name, frozenset(name.split("-")), 0) for name in ALLOW_MIXED]
    return [(f"{name}.example.{('org', 'net')[k % 2]}", own, label) for k, (name, own, label) in enumerate(rows)]


def labelled() -> list[tuple[str, str, int]]:
    """The small labelled table: (host, path, 1 for block)."""
    rows = []
    for k, (host, _, label) in enumerate(labelled_hosts()):
        rows += [(p + host, _PATHS[(k + n) % len(_PATHS)], label) for n, p in enumerate(_PREFIXES)]
    return [*rows, ("", "", 0)]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        index, owner, value = features(hosts, paths, self.bits)
        z = np.bincount(owner, weights=self.weights[index] * value, minlength=len(hosts)) + self.bias
        return 1 / (1 + np.exp(-z))


def features(hosts: Sequence[str], paths: Sequence[str], bits: int, orders=(3, 4, 5)):
    """Hashed n-grams of each URL: index, URL number, value (each URL's values have length one)."""
    import xxhash

    mask, index, owner, value = (1 << bits) - 1, [], [], []
    for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        seen = set()
        for kind, part in (("h", f"^{host}$"), ("p", f"{path}$")):
            for n in orders:
                for i in range(len(part) - n + 1):
                    seen.add(xxhash.xxh32_intdigest(kind + part[i : i + n]) & mask)
        index += sorted(seen)
        owner += [k] * len(seen)
        value += [1 / np.sqrt(len(seen))] * len(seen) if seen else []
    return np.array(index, np.int64), np.array(owner, np.int64), np.array(value)


def train(rows: Sequence[tuple[str, str, int]] | None = None, bits: int = 16, rounds: int = 600, l2: float = 1e-3) -> Model:
    """Full-batch gradient descent with momentum; the same rows give the same model."""
    rows = labelled() if rows is None else rows
    hosts, paths, y = zip(*rows, strict=True)
    index, owner, value = features(hosts, paths, bits)
    y = np.array(y, float)
    w, b, vw, vb = np.zeros(1 << bits), 0.0, np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        z = np.bincount(owner, weights=w[index] * value, minlength=len(y)) + b
        error = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(index, weights=error[owner] * value, minlength=1 << bits) / len(y) + l2 * w / len(y)
        vw, vb = 0.9 * vw - 4.0 * grad, 0.9 * vb - 0.5 * error.mean()
        w, b = w + vw, b + vb
    return Model(w, float(b), bits)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct ``verdict``, ``rule`` of the longest rule that fits; null if none does."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        suffix, slash, rest = rule.partition("/")
        by_host.setdefault(suffix, []).append((slash + rest, verdict, rule))
    if not by_host:
        return F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
    table = F.create_map(
        *[
            x
            for suffix, own in by_host.items()
            for x in (
                F.lit(suffix),
                F.array(
                    *[
                        F.struct(F.lit(p).alias("path"), F.lit(v).alias("verdict"), F.lit(r).alias("rule"))
                        for p, v, r in own
                    ]
                ),
            )
        ]
    )
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    most = max(suffix.count(".") + 1 for suffix in by_host)
    suffixes = F.transform(F.sequence(F.greatest(n - most + 1, F.lit(1)), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    own = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.element_at(table, s), F.array())))
    fits = F.filter(own, lambda r: F.startswith(path, r["path"]))
    # The longest first; the text itself settles ties.
    best = F.array_max(
        F.transform(
            fits, lambda r: F.struct(F.char_length(r["rule"]).alias("size"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))
        )
    )
    return best


def with_verdict(
    pages: DataFrame,
    into: str = "judged",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    model: Model | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """``pages`` with a struct column ``into``: ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` (the
    rule's, else the model's) and ``score`` (the model's probability of block)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())  # 2 ** bits weights

    @F.arrow_udf(T.DoubleType())
    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(hosts.to_pylist(), paths.to_pylist()), pa.float64())

    parts, scored = fresh_name(pages.columns, "parts_"), fresh_name(pages.columns, "score_")
    host, path = host_and_path(F.col(url_col).cast("string"))
    split = pages.withColumn(parts, F.struct(host.alias("host"), path.alias("path")))
    own = split.withColumn(scored, score(f"{parts}.host", f"{parts}.path"))
    rule = rule_for(F.col(f"{parts}.host"), F.col(f"{parts}.path"), rules)
    by_model = F.when(F.col(scored) >= threshold, "block").otherwise("allow")
    return own.withColumn(
        into,
        F.struct(
            F.col(f"{parts}.host").alias("host"),
            F.col(f"{parts}.path").alias("path"),
            rule["rule"].alias("rule"),
            F.coalesce(rule["verdict"], by_model).alias("verdict"),
            F.col(scored).alias("score"),
        ),
    ).drop(parts, scored)
