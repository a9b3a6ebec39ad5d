"""Learning merge rules: greedily the best pair, one after the other.

The driver holds the pair counts (at most one number for each distinct pair: 65,536 to begin with, and few new ones per
merge), the points, and a heap that gives the best pair without sorting.  What a merge does to the counts is told by
the corpus, which is scanned for several merges at a time: the first is the best pair, the next ones are guessed, and
each scan returns the differences of the pair counts for every one of them.  A guessed merge is taken only if, with the
true counts of those before it, it is the best pair indeed.  Where a later guess is the best pair, it comes first if its places
cannot overlap those of the guesses between, whose differences are then corrected; else the batch ends and what is left is
dropped.  So the rules are those of one merge at a time, whatever the guesses are worth, and the batch grows and
shrinks with their luck.

The corpus is a ``Blocks``: a table of token ids which workers scan, opening only blocks that hold the pairs of a scan where
these are rare, and which is rewritten every ``cut_every`` merges.  ``local=True``, for a caller whose corpus fits the driver, trains
there on one array instead; nothing chooses that by itself.

With ``state_to`` the training can be killed at any time: every table's pair counts and known entropies are written beside it, a
manifest, there whole or not at all, names them, and the merges of each scan since then are logged.  A call
with the same folder goes on from the last manifest: one scan over the logged rules brings the counts up to date, and the
rules are those of a training that was never stopped.

Modes.  ``frequency``: count x coupling.  ``entropy``: count x coupling / (context entropy + 0.1).  No entropy is below
-1e-10, so count x coupling / (0.1 - 1e-10) bounds a pair's score; contexts thrown together in classes give a closer bound.  Contexts are
shuffled only for pairs whose bound reaches the best score found and whose entropy is not known; a merge makes unknown entropies
and bounds of the pairs that occur within reach of a fused place.  ``phi``: the best ten of the slate by count x coupling are fused in a sample, and the
gain in phi weighs in.

Pairs never span two rows.  A corpus of one row reproduces training on one byte stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import astuple, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, simplex
from ..operators import pairs as P
from ..operators.merging import PAD, in_order, to_ids
from ..operators.rewrite import apply_rules, live_length
from ..sources.shared import read_texts, remove, shared_folder, write_text
from .blocks import BLOCK_TOKENS, Blocks, distinct_keys, step_changes
from .heap import Pair, PairTable
from .model import Model, Rule, fused_point

Kernel = Callable[[np.ndarray], tuple[float, float]]
MODES = ("entropy", "frequency", "phi")
#: Logarithms: by what the entropy of evenly filled classes is above the one that rules a pair out, and the most for which classes are counted.
#: Contexts of pairs with fewer occurrences than so many a class are read at once: the tasks' counts of classes would be as many bytes.
#: And the classes of a scan, at most: a worker holds a count for each.
SPARE, MOST_CLASSES, SENT = 2.0, 12.2, 4
ALL_CLASSES = 1 << 22


@dataclass(frozen=True)
class Step:
    """One merge of the log."""

    rule: Rule
    count: int
    coupling: float
    score: float
    merged: int
    length: int
    entropy: float | None = None
    gain: float | None = None


@dataclass(frozen=True)
class Result:
    model: Model
    steps: tuple[Step, ...]
    seqs: DataFrame
    report: dict[str, float]

    def log(self, spark: SparkSession) -> DataFrame:
        rows = [
            (k, *s.rule, s.count, s.coupling, s.entropy, s.gain, s.score, s.merged, s.length) for k, s in enumerate(self.steps)
        ]
        return spark.createDataFrame(
            rows,
            "step int, a int, b int, new_id int, cnt long, coupling double, entropy double, gain double, score double, "
            "merged long, length long",
        )


# ------------------------------------------------------------------------------------------------- corpora


Change = tuple[list[tuple[int, int, int]], int, set[Pair]]  # count differences, fused places, pairs with new contexts


def _entropies(a, b, h1, h2, n) -> dict[Pair, float]:
    """Context entropy of each pair from its contexts' counts."""
    order = np.lexsort((h2, h1, b, a))
    a, b, h1, h2, n = a[order], b[order], h1[order], h2[order], n[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)
    counts = np.add.reduceat(n, first) if len(first) else n
    a, b = a[first], b[first]
    own = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else first
    out = {}
    for k, end in zip(own, np.append(own[1:], len(a)), strict=True):
        kinds, times = np.unique(counts[k:end], return_counts=True)
        total, h = float(counts[k:end].sum()), 0.0
        for c, m in zip(kinds.tolist(), times.tolist(), strict=True):
            h -= (c / total) * float(np.log(c / total + 1e-10)) * m
        out[int(a[k]), int(b[k])] = h
    return out


class _Local:
    """A small corpus as one array."""

    batch = 1

    def __init__(self, rows: list[tuple], seqs: DataFrame):
        self.ids, self.base, self.rules = to_ids([s for _, s in rows]), seqs, []

    def pair_counts(self) -> list[tuple[int, int, int]]:
        keys, n = distinct_keys(self.ids)
        return list(zip((keys >> 21).tolist(), (keys & (1 << 21) - 1).tolist(), n.tolist(), strict=True))

    def changes(self, rules: Sequence[Rule], window: int, occurrences: int | None = None) -> list[Change]:
        self.after, found = step_changes(self.ids, rules, window)
        return [
            (list(zip((k >> 21).tolist(), (k & (1 << 21) - 1).tolist(), n.tolist(), strict=True)), fused, {(x >> 21, x & (1 << 21) - 1) for x in dirty.tolist()})
            for k, n, fused, dirty in found
        ]

    def accept(self, rules: Sequence[Rule], length: int | None = None) -> bool:
        self.ids = self.after  # one rule at a time
        self.rules += rules
        return False

    def entropies(self, wanted: Sequence[Pair], window: int, classes: dict[Pair, int] | None = None) -> dict[Pair, float]:
        ids = self.ids.astype(np.int64)
        return _entropies(*P.count_contexts(ids, P.pair_places(ids, [*wanted, *(classes or ())]), window))

    def first(self, n: int) -> list[int]:
        return self.ids[self.ids != PAD][:n].tolist()

    def seqs(self) -> DataFrame:
        return self.base.filter(F.col("seq").isNotNull()).withColumn("seq", apply_rules(F.col("seq"), self.rules))


# ------------------------------------------------------------------------------------------------- selection


def _by_entropy(table: PairTable, corpus, length: int, window: int, known: dict[Pair, float]):
    """The best pair by entropy score, exactly: bounds decide which contexts must be read.

    An entropy is at most the logarithm of the count, and at least that of the contexts thrown together in classes.  One scan reads the
    contexts of the leading pairs and, of all others that could be best, classes in such a number that they will hardly be; if
    one still could, the next scan reads its contexts."""
    product, floors = np.where(table.count[: table.size] >= table.min_count, table.products(length), -1.0), table.floors
    if not (product >= 0).any():
        return None
    ceiling = np.log(np.maximum(table.count[: table.size], 1.0))
    least = float((product / (ceiling + scores.SOFTEN)).max()) * (1 - 1e-9)  # some pair scores so much
    order = np.flatnonzero((product >= 0) & (product / (scores.SOFTEN - 1.1e-10) >= least))
    rivals = list(zip(order.tolist(), table.pairs(order), strict=True))
    while True:
        best, at = None, None
        for k, pair in rivals:
            if pair in known:
                score = float(table.count[k]) * table.coupling(k, length) * (1.0 / (known[pair] + scores.SOFTEN))
                if best is None or (-score, *pair) < best:
                    best, at = (-score, *pair), k
        if best is not None:
            least = max(least, -best[0] * (1 - 1e-9))
        # A term p ln(p + 1e-10) is less than p ln p by 1e-10 at most, and there are as many as distinct contexts.
        rest = [(k, p) for k, p in rivals if p not in known and product[k] / (max(floors.get(p, 0.0) - 1e-10 * table.count[k], -1.1e-10) + scores.SOFTEN) >= least]
        if not rest:
            return at, -best[0], known[best[1:]], None
        wanted, classes, left = [], {}, ALL_CLASSES
        for k, pair in rest:
            power = 0.0 if least <= 0 else float(product[k]) / least  # an entropy above this, less SOFTEN, rules the pair out
            n = 1 << int(np.ceil((min(power, MOST_CLASSES) + SPARE) / np.log(2)))
            if pair in floors or power > MOST_CLASSES or table.count[k] <= SENT * n or n > left:
                wanted.append(pair)
            else:
                classes[pair] = n
                left -= n
        found = corpus.entropies(wanted, window, classes)
        known.update({p: found[p] for p in wanted})
        floors.update({p: found[p] for p in classes})


def fused_sample(sample: Sequence[int], vectors: dict[int, np.ndarray], pair: Pair | None) -> np.ndarray:
    """Points of a sample's tokens, the places of ``pair`` fused left to right."""
    if pair is None:
        return np.array([vectors[t] for t in sample])
    middle, fused, i = simplex.np_midpoint(vectors[pair[0]], vectors[pair[1]]), [], 0
    while i < len(sample):
        hit = tuple(sample[i : i + 2]) == pair
        fused.append(middle if hit else vectors[sample[i]])
        i += 2 if hit else 1
    return np.array(fused)


def phis(sample: Sequence[int], points, pairs: Sequence[Pair | None], kernel: Kernel, spark: SparkSession | None = None) -> list[float | None]:
    """phi of the sample with each of these pairs fused (None: as it is); 0.5 for an empty sample.

    With ``spark`` every candidate is a task of its own: the sample, its points and the kernel go out with the closure (as large as the
    sample, which the caller bounds), and one number a candidate comes back.  A kernel that raises, in the driver or in a
    worker, gives None for that candidate; the others stand."""
    vectors = {t: points[t].vector for t in {*sample, *(t for p in pairs if p is not None for t in p)}}
    sample = list(sample)

    def one(pair: Pair | None) -> float | None:
        try:
            return float(kernel(fused_sample(sample, vectors, pair))[0]) if sample else 0.5
        except Exception:  # whatever a caller's kernel raises
            return None

    if spark is None:
        return [one(p) for p in pairs]

    def work(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [one(None if r["a"] is None else (r["a"], r["b"])) for r in rows]
            yield pa.record_batch([pa.array([r["k"] for r in rows], pa.int32()), pa.array(found, pa.float64())], names=["k", "phi"])

    rows = [(k, *(p or (None, None))) for k, p in enumerate(pairs)]
    tasks = spark.createDataFrame(rows, "k int, a int, b int").repartition(len(rows)).mapInArrow(work, "k int, phi double")
    found = {r["k"]: r["phi"] for r in tasks.collect()}  # a row a candidate
    return [found[k] for k in range(len(pairs))]


def _by_phi(table: PairTable, sample: list[int], length: int, slate: int, measured: int, kernel: Kernel, spark: SparkSession | None):
    """The best of the slate's first candidates by count x coupling x gain in phi; the first wins a tie.  Where the kernel fails, on a
    candidate or on the sample as it is, the gain is 0."""
    order = table.top(slate, length)[:measured]
    if not len(order):
        return None
    product = table.products(length)
    base, *after = phis(sample, table.points, [None, *table.pairs(order)], kernel, spark)
    best = None
    for k, phi in zip(order.tolist(), after, strict=True):
        gain = 0.0 if phi is None or base is None else phi - base
        score = product[k] * (1.0 / (1.0 + scores.SOFTEN)) * max(0.0, gain + 0.1)
        if best is None or score > best[1]:
            best = (k, score, None, gain)
    return best


def settled(history: list[float], window: int = 5, relative: float = 0.05, least: int = 8) -> bool:
    """Whether the last values hardly change any more: enough of them, and all within a relative band."""
    if len(history) < max(window, least):
        return False
    last = np.array(history[-window:])
    return bool((last.max() - last.min()) <= relative * max(abs(last.mean()), 1e-12))


def measure(tokens: Sequence[int], model: Model, kernel: Kernel) -> tuple[float, float]:
    """phi and kappa of some tokens."""
    return kernel(np.array([model.points[t].vector for t in tokens])) if tokens else (0.5, 1.0)


@dataclass
class _Trial:
    """A rule whose token has a number for the time of a scan, and what it changes behind the trials before it."""

    rule: Rule
    changes: dict[Pair, int]
    merged: int
    dirty: set[Pair]


def swapped(v: _Trial, u: _Trial) -> bool:
    """Lets ``u`` come before ``v``, which stood just before it; false if their places can overlap.

    Rules whose places never overlap fuse the same places in either order.  What differs are the pairs where a place of one
    follows a place of the other, and their number is the count of the pair of the two new tokens."""
    (a, b, v_new), (x, y, u_new) = v.rule, u.rule
    if y == a or b == x or v_new in (x, y):
        return False
    behind, ahead = u.changes.get((v_new, u_new), 0), u.changes.get((u_new, v_new), 0)
    for n, moves in (
        (behind, (((v_new, x), 1), ((v_new, u_new), -1), ((b, x), -1), ((b, u_new), 1))),
        (ahead, (((y, v_new), 1), ((u_new, v_new), -1), ((y, a), -1), ((u_new, a), 1))),
    ):
        for pair, sign in moves if n else ():
            u.changes[pair] = u.changes.get(pair, 0) + sign * n
            v.changes[pair] = v.changes.get(pair, 0) - sign * n
    return True


def to_front(pool: list[_Trial], pair: Pair, next_id: int, named: dict[int, int]) -> bool:
    """Brings the trial of ``pair`` to the front of the pool, whose trials before it then follow; false if there is none, or if it
    depends on one of them."""
    for k, own in enumerate(pool):
        if pair == tuple(named.get(t, -1) if t >= next_id else t for t in own.rule[:2]):
            break
    else:
        return False
    for i in range(k, 0, -1):
        if not swapped(pool[i - 1], pool[i]):
            return False
        pool[i - 1], pool[i] = pool[i], pool[i - 1]
    return True


def train(
    seqs: DataFrame,
    target: int,
    mode: str = "frequency",
    window: int = 5,
    min_count: int = 5,
    model: Model | None = None,
    kernel: Kernel = simplex.np_phi_kappa,
    slate: int = 50,
    measured: int = 10,
    sample: int = 1000,
    batch_accept: int = 200,
    local: bool = False,
    cut_every: int = 128,
    block_tokens: int = BLOCK_TOKENS,
    state_to: str | None = None,
    save_every: int = 0,
    save_to: str | None = None,
    keep: int = 3,
    should_stop: Callable[[], bool] = lambda: False,
    on_step: Callable[[Step], None] = lambda step: None,
) -> Result:
    """Learns rules until the vocabulary has ``target`` tokens, no pair is frequent enough, or ``should_stop`` says so.

    ``seqs`` is (doc_id, seq).  ``model`` continues an earlier training: its rules are applied to ``seqs`` first.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = seqs.sparkSession
    shared_folder(spark)
    model = replace(model or Model(), target=target)
    # Null sequences go where each table is read: a filter here has Spark compute the sequences twice, in two Python workers a core.
    seqs = seqs.select("doc_id", "seq")
    # Rules of an earlier training are applied once, to the blocks, and not to the texts each time these are read.
    prior = [] if local or not in_order(model.rules) else list(model.rules)
    docs = seqs if prior else seqs.withColumn("seq", apply_rules(F.col("seq"), model.rules))
    table = PairTable(dict(model.points), min_count)
    known: dict[Pair, float] = {}
    state = None if state_to is None else _State(spark, state_to)
    kept = None if state is None else state.load()
    logged: list[Step] = []
    if kept is not None:
        n_bytes, length, steps, logged = kept["n_bytes"], kept["length"], [Step(*x) for x in kept["steps"]], [Step(*x) for x in kept["logged"]]
        corpus = Blocks(docs, length, cut_every, block_tokens, state_to, kept["table"], [*prior, *(s.rule for s in steps)])
        for s in steps:
            table.points[s.rule[2]] = fused_point(table.points, *s.rule[:2], decode_bytes=mode != "entropy")
        counts, known = state.pairs(kept["pairs"])
        table.push_changed(counts)
    else:
        n_bytes, steps = live_length(seqs).first()["length"], []
        length = n_bytes if prior or not model.rules else live_length(docs).first()["length"]
        if local:
            rows = docs.filter("char_length(seq) > 0").orderBy("doc_id").toArrow()
            corpus = _Local(list(zip(*(c.to_pylist() for c in rows.columns), strict=True)), docs)
        else:
            corpus = Blocks(docs, length, cut_every, block_tokens, state_to)
            if prior:
                length = corpus.begin(prior)
        table.push_changed(corpus.pair_counts())
    near = window if mode == "entropy" else 0
    rules, points = [*model.rules, *(s.rule for s in steps)], table.points
    if logged:  # merges behind the last manifest: one scan for all of them
        for step, (changes, merged, dirty) in zip(logged, corpus.changes([s.rule for s in logged], near), strict=True):
            points[step.rule[2]] = fused_point(points, *step.rule[:2], decode_bytes=mode != "entropy")
            table.push_changed(changes)
            for pair in (*dirty, *((a, b) for a, b, _ in changes if near)):
                known.pop(pair, None)
                table.floors.pop(pair, None)
            length -= merged
        steps += logged
        rules += [s.rule for s in logged]
        corpus.accept([s.rule for s in logged])
    if kept is not None:
        phi0, kappa0 = kept["before"]
    else:
        phi0, kappa0 = measure(corpus.first(100), model, kernel)

    def snapshot() -> None:
        if state is not None:
            state.save(corpus, table, known, steps, n_bytes, length, (phi0, kappa0))

    if kept is None:
        snapshot()
    history = [s.coupling for s in steps if s.gain is not None]
    skipped, batch, stopped = 0, corpus.batch, False
    next_id = max(max((r[2] for r in rules), default=255), max((k for k in points), default=255)) + 1
    while not stopped and 256 + len(rules) < target and not should_stop():
        measuring = mode == "phi" and skipped == 0
        if mode == "entropy":
            found = _by_entropy(table, corpus, length, window, known)
        elif measuring:
            found = _by_phi(table, corpus.first(sample), length, slate, measured, kernel, None if local else spark)
        else:
            found = (top := table.pop_best(length)) and (*top, None, None)
        if not found:
            break
        alone = mode == "entropy" or measuring or corpus.batch == 1
        left = target - 256 - len(rules)
        planned = table.pairs([found[0]]) if alone else table.guess_by(corpus.some(), found[0], length, min(batch, left, max(skipped, 1) if mode == "phi" else batch), next_id)
        trial = [(a, b, next_id + t) for t, (a, b) in enumerate(planned)]
        taken: list[Rule] = []
        named: dict[int, int] = {}
        most = int(table.count[found[0]]) * len(trial)
        pool = [_Trial(rule, {(a, b): n for a, b, n in changes}, merged, dirty) for rule, (changes, merged, dirty) in zip(trial, corpus.changes(trial, near, most), strict=True)]
        while pool:
            if taken:
                if should_stop():
                    stopped = True
                    break
                found = (top := table.pop_best(length)) and (*top, None, None)
                if not found or not to_front(pool, table.pairs([found[0]])[0], next_id, named):
                    break
            own = pool.pop(0)
            named[own.rule[2]] = next_id + len(taken)
            name = lambda t: named[t] if t >= next_id else t
            rule = (name(own.rule[0]), name(own.rule[1]), named[own.rule[2]])
            changes, merged, dirty = [(name(a), name(b), n) for (a, b), n in own.changes.items() if n], own.merged, own.dirty
            k, score, entropy, gain = found
            count, link = int(table.count[k]), table.coupling(k, length)
            points[rule[2]] = fused_point(points, *rule[:2], decode_bytes=mode != "entropy")
            table.push_changed(changes)
            for pair in (*dirty, *((a, b) for a, b, _ in changes if near)):
                known.pop(pair, None)
                table.floors.pop(pair, None)
            length -= merged
            rules.append(rule)
            taken.append(rule)
            step = Step(rule, count, link, float(score), merged, length, entropy, gain)
            steps.append(step)
            on_step(step)
            skipped = max(0, skipped - 1)
            if gain is not None:
                history.append(link)
                if settled(history) and np.mean(history[-5:]) < 2.0:
                    skipped = batch_accept
            if save_every and save_to and len(steps) % save_every == 0:
                _save(spark, replace(model, rules=tuple(rules), points=dict(points)), save_to, 256 + len(rules), keep)
        if corpus.accept(taken, length):
            snapshot()
        elif state is not None:
            state.log(steps, len(taken))
        next_id += len(taken)
        if len(planned) > 1:
            batch = min(2 * batch, 128) if len(taken) == len(trial) else max(2, 2 * len(taken))

    gains = tuple(s.gain for s in steps if s.gain is not None)
    model = replace(model, rules=tuple(rules), points=dict(points), phi_history=(*model.phi_history, *gains))
    phi1, kappa1 = measure(corpus.first(100), model, kernel)
    report = {
        "n_bytes": n_bytes,
        "n_tokens": length,
        "ratio": length / n_bytes if n_bytes else 1.0,
        "phi_before": phi0,
        "kappa_before": kappa0,
        "phi_after": phi1,
        "kappa_after": kappa1,
    }
    return Result(model, tuple(steps), corpus.seqs(), report)


class _State:
    """The folder of a training that can go on: block tables, pair tables, manifests and the log of merges."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def load(self) -> dict | None:
        """What the newest manifest holds, and as ``logged`` the steps behind it."""
        manifests = read_texts(self.spark, self.folder, ".manifest")
        if not manifests:
            return None
        kept = json.loads(manifests[max(manifests)])
        done = len(kept["steps"])
        logged = [json.loads(text) for _, text in sorted(read_texts(self.spark, self.folder, ".steps").items())]
        kept["logged"] = [x for first, steps in logged for k, x in enumerate(steps, first) if k >= done]
        for x in (*kept["steps"], *kept["logged"]):
            x[0] = tuple(x[0])
        return kept

    def pairs(self, path: str) -> tuple[list[tuple[int, int, int]], dict[Pair, float]]:
        rows = self.spark.read.parquet(path).toArrow().to_pylist()
        return [(r["a"], r["b"], r["cnt"]) for r in rows], {(r["a"], r["b"]): r["entropy"] for r in rows if r["entropy"] is not None}

    def save(self, corpus: Blocks, table: PairTable, known: dict[Pair, float], steps: list[Step], n_bytes: int, length: int, before) -> None:
        """Pair table first, then the manifest that names it and the block table; only then the ones before go."""
        if corpus.pending:
            corpus.cut()
        path = f"{self.folder}/pairs-{len(steps):08d}"
        a, b, n = (x[: table.size][table.count[: table.size] > 0].astype(np.int64) for x in (table.a, table.b, table.count))
        entropies = [known.get(p) for p in zip(a.tolist(), b.tolist(), strict=True)]
        rows = pa.table({"a": a, "b": b, "cnt": n, "entropy": pa.array(entropies, pa.float64())})
        self.spark.createDataFrame(rows).write.mode("overwrite").parquet(path)
        manifest = {"steps": [astuple(s) for s in steps], "n_bytes": n_bytes, "length": length, "table": corpus.path, "pairs": path, "before": before}
        old = [*read_texts(self.spark, self.folder, ".manifest"), *read_texts(self.spark, self.folder, ".steps")]
        own = f"{len(steps):08d}.manifest"
        write_text(self.spark, f"{self.folder}/{own}", json.dumps(manifest))
        for name in old:
            if name != own:
                remove(self.spark, f"{self.folder}/{name}")
                if name.endswith(".manifest"):
                    remove(self.spark, f"{self.folder}/pairs-{name[:8]}")
        corpus.drop_stale()

    def log(self, steps: list[Step], n: int) -> None:
        if n:
            first = len(steps) - n
            write_text(self.spark, f"{self.folder}/{first:08d}.steps", json.dumps([first, [astuple(s) for s in steps[first:]]]))


def _save(spark: SparkSession, model: Model, folder: str, size: int, keep: int) -> None:
    """Writes the model and removes all but the newest ``keep``."""
    model.save(spark, f"{folder}/model-{size:08d}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("model-"))
    for name in old[:-keep]:
        remove(spark, f"{folder}/{name}")
