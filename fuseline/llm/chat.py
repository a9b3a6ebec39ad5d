"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, user first.  Every input turn goes
through an automaton whose states are the role of the last turn written; what it may do, and at which cost:

* stand as it is (0), if its role may follow;
* merge into the turn before it (``MERGE``), if that has its role;
* have empty turns inserted before it (``INSERT`` each), so that its role may follow;
* be relabelled (``RELABEL``; ``UNNAMED`` for a role that is none of the three), and then any of these.

The cheapest repair of the whole conversation is found by dynamic programming; ties go to the first in the order
above.  The result is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.

Scale.  A turn is a 4x4 min-plus matrix over the states, and matrices of consecutive turns multiply.  The turns are
sorted by range over all conversations, so that one conversation that holds a third of all rows lies in many
partitions, and are cut into segments of ``chunk_turns`` turns by their rank in the conversation; only the first
conversation of a partition has turns before it, and those few ranks (one number for each partition) are all that the
driver gets.  Each segment (or the part of it that lies in a partition) is reduced to its matrix, the few matrices of
a conversation give each its entry and exit state, and segments are repaired and rendered independently.  So a long
conversation's rendering comes in segments whose concatenation in order is the whole.  A conversation of up to
``chunk_turns`` turns is one segment.

Odd input: roles are trimmed and lower-cased, ``human``, ``bot``, ``model``, ``gpt`` and ``developer`` are known by
their usual meaning, others (null too) are unnamed; null texts are empty; the marks' strings inside a text get a
blank; turns are ordered by turn, then role, then MD5 of the text, null first, and repeated rows are turns of their own; rows
without a conversation id form one conversation, and turns without a number are its first; a text of any length is
one turn; empty tables give no rows; additional columns are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed

ROLES = ("system", "user", "assistant")
SYNONYMS = {"human": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant", "developer": "system"}
START = 3  # the states: 0-2 the role of the last turn written, 3 nothing yet
FOLLOWS = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, INSERT, RELABEL, UNNAMED = 1.0, 2.0, 3.0, 1.0
INF = float("inf")


def _inserted() -> dict[int, dict[int, tuple[int, ...]]]:
    """For each state and role the shortest run of empty turns after which the role may follow."""
    out: dict[int, dict[int, tuple[int, ...]]] = {}
    for state in FOLLOWS:
        paths, reach = {state: ()}, {}
        for _ in range(4):
            for at, path in list(paths.items()):
                for role in FOLLOWS[at]:
                    if role not in reach or len(path) < len(reach[role]):
                        reach[role] = path
                    if role not in paths:
                        paths[role] = (*path, role)
        out[state] = reach
    return out


_BEFORE = _inserted()


def role_code(role: str | None) -> int:
    """Number of a role; -1 for one that is none of the three."""
    name = (role or "").strip().lower()
    name = SYNONYMS.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def _moves(state: int, code: int) -> list[tuple[float, int, str]]:
    """(cost, next state, action) of a turn with this role; actions: s(tand), m(erge), i(nsert) and the new role."""
    out = []
    for role in range(3):
        label = 0.0 if role == code else UNNAMED if code < 0 else RELABEL
        name = "" if role == code else f">{ROLES[role][0]}"
        if role in _BEFORE[state]:
            empty = _BEFORE[state][role]
            out.append((label + INSERT * len(empty), role, ("i" * len(empty) or "s") + name))
        if state == role:
            out.append((label + MERGE, role, "m" + name))
    rank = {"s": 0, "m": 1, "i": 2}
    return sorted(out, key=lambda x: (x[0], ">" in x[2], rank[x[2][0]], x[1]))


MOVES = {(s, c): _moves(s, c) for s in FOLLOWS for c in (-1, 0, 1, 2)}


def matrix(codes: list[int]) -> list[float]:
    """Least cost from each state to each, over these turns; 16 numbers."""
    out = []
    for start in range(4):
        cost = [INF] * 4
        cost[start] = 0.0
        for c in codes:
            after = [INF] * 4
            for state, own in enumerate(cost):
                if own < INF:
                    for price, to, _ in MOVES[state, c]:
                        if own + price < after[to]:
                            after[to] = own + price
            cost = after
        out += cost
    return out


def entries(matrices: list[list[float]]) -> list[tuple[int, int]]:
    """Entry and exit state of each chunk on the cheapest way through all."""
    best = [[0.0] * 4]
    for m in reversed(matrices):  # cost still to come, from each state before the chunk
        rest = best[-1]
        best.append([min(m[4 * a + b] + rest[b] for b in range(4)) for a in range(4)])
    best.reverse()
    state, out = START, []
    for k, m in enumerate(matrices):
        to = min(range(4), key=lambda b: (m[4 * state + b] + best[k + 1][b], b))
        out.append((state, to))
        state = to
    return out


def repair(codes: list[int], start: int = START, end: int | None = None) -> tuple[float, list[tuple[int, str]]]:
    """Cheapest repair: its cost and for each turn the role it gets and the action."""
    ahead = [[0.0 if end is None or s == end else INF for s in range(4)]]
    for c in reversed(codes):
        rest = ahead[-1]
        ahead.append([min(price + rest[to] for price, to, _ in MOVES[s, c]) for s in range(4)])
    ahead.reverse()
    state, out = start, []
    for k, c in enumerate(codes):
        price, to, action = min(MOVES[state, c], key=lambda m: m[0] + ahead[k + 1][m[1]])
        out.append((to, action))
        state = to
    return ahead[0][start], out


def render(texts: list[str], steps: list[tuple[int, str]], start: int, last: bool) -> tuple[str, int]:
    """The rendering of a chunk (it closes the turn that the chunk before left open) and the turns it begins."""
    parts, state, turns = [], start, 0

    def begin(role: int):
        nonlocal turns
        if state != START:
            parts.append("<|im_end|>\n")
        parts.append(f"<|im_start|>{ROLES[role]}\n")
        turns += 1

    for text, (role, action) in zip(texts, steps, strict=True):
        text = text.replace("<|im_", "<| im_")
        if action[0] == "m":
            parts += ["\n", text]
        else:
            if action[0] == "i":
                for empty in _BEFORE[state][role]:
                    begin(empty)
                    state = empty
            begin(role)
            parts.append(text)
        state = role
    if last and state != START:
        parts.append("<|im_end|>\n")
    return "".join(parts), turns


_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_RENDERED = T.StructType(
    [
        T.StructField("cost", T.DoubleType()),
        T.StructField("n_out", T.LongType()),
        T.StructField("edits", T.StringType()),
        T.StructField("rendered", T.StringType()),
    ]
)
_PLACE = T.StructType([T.StructField(n, T.LongType()) for n in ("segment", "part", "enter", "leave", "last")])


def _cutter(before: dict[int, int], goes_on: set[int], chunk_turns: int):
    """Rows (part, conv, role, text) in order: one row for each segment, or part of one that the partition's ends cut.

    ``before`` has, by partition, the turns of its first conversation in earlier partitions; ``goes_on`` the partitions
    whose last conversation continues in the next one.
    """

    def cut(batches):
        kind = None
        own: list[dict] = []
        at = rank = part = None

        def piece(more: bool):
            first = rank - len(own)
            cut_off = first % chunk_turns != 0 or more and rank % chunk_turns != 0
            codes = matrix([role_code(t["role"]) for t in own])
            values = [[at], [first // chunk_turns], [part], [cut_off], [own], [codes]]
            kinds = [kind, pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.list_(pa.float64())]
            return pa.record_batch(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["conv", "segment", "part", "cut", "turns", "m"]
            )

        for batch in batches:
            kind = batch.schema.field(1).type
            for p, conv, role, text in zip(*batch.columns, strict=True):
                conv = conv.as_py()
                if part is None or conv != at:
                    if own:
                        yield piece(False)
                    rank = before.get(p.as_py(), 0) if part is None else 0
                    part, at, own = p.as_py(), conv, []
                elif rank % chunk_turns == 0 and own:
                    yield piece(False)
                    own = []
                own.append({"role": role.as_py(), "text": text.as_py()})
                rank += 1
        if own:
            yield piece(part in goes_on)

    return cut


def _partition_ends(placed: DataFrame) -> tuple[dict[int, int], set[int]]:
    """What ``_cutter`` needs to know of each partition's first and last conversation."""
    runs = placed.groupBy("part", "conv").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"), F.max("row").alias("high"))
    edge = lambda col, best: best(F.struct(col, "conv", "n"))
    ends = runs.groupBy("part").agg(edge("low", F.min).alias("first"), edge("high", F.max).alias("last")).orderBy("part")
    before, goes_on = {}, set()
    conv = count = last = None  # of the conversation at the end of the partition before
    for r in ends.toLocalIterator():  # one row a partition
        if last is not None and r["first"]["conv"] == conv:
            before[r["part"]] = count
            goes_on.add(last)
        whole = r["first"]["low"] == r["last"]["high"] - r["last"]["n"] + 1  # the partition holds one conversation
        count = before.get(r["part"], 0) + r["first"]["n"] if whole else r["last"]["n"]
        conv, last = r["last"]["conv"], r["part"]
    return before, goes_on


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    chunk_turns: int = 512,
) -> DataFrame:
    """One row per conversation and segment: ``conv``, ``segment``, ``n_turns``, ``n_out`` (turns written), ``cost``,
    ``edits`` (one action per input turn, comma-joined) and ``rendered``."""

    @F.arrow_udf(T.ArrayType(_PLACE))
    def route(chunks: pa.Array) -> pa.Array:
        out = []
        for x in chunks:
            x = x.as_py()
            ways = entries([c["m"] for c in x])
            out.append(
                [
                    {"segment": c["segment"], "part": c["part"], "enter": a, "leave": b, "last": int(k == len(x) - 1)}
                    for k, (c, (a, b)) in enumerate(zip(x, ways, strict=True))
                ]
            )
        return pa.array(out, pa.list_(pa.struct([(f.name, pa.int64()) for f in _PLACE.fields])))

    @F.arrow_udf(_RENDERED)
    def rendered(own: pa.Array, enter: pa.Array, leave: pa.Array, last: pa.Array) -> pa.Array:
        out = []
        for x, a, b, z in zip(own, enter.to_pylist(), leave.to_pylist(), last.to_pylist(), strict=True):
            x = x.as_py()
            cost, steps = repair([role_code(t["role"]) for t in x], a, b)
            text, n = render([t["text"] or "" for t in x], steps, a, bool(z))
            out.append({"cost": cost, "n_out": n, "edits": ",".join(s[1] for s in steps), "rendered": text})
        kinds = [("cost", pa.float64()), ("n_out", pa.int64()), ("edits", pa.string()), ("rendered", pa.string())]
        return pa.array(out, pa.struct(kinds))

    text = F.col(text_col).cast("string")
    order = ["conv", "turn", "role", "digest", "tie"]
    placed = checkpointed(
        turns.select(
            F.col(conv_col).alias("conv"),
            F.col(turn_col).alias("turn"),
            F.col(role_col).cast("string").alias("role"),
            text.alias("text"),
            F.md5(text).alias("digest"),
            F.monotonically_increasing_id().alias("tie"),  # deals rows that are alike
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "conv", "role", "text", F.monotonically_increasing_id().alias("row"))
    )
    before, goes_on = _partition_ends(placed)
    kind = placed.schema["conv"].dataType.simpleString()
    chunks = checkpointed(
        placed.select("part", "conv", "role", "text").mapInArrow(
            _cutter(before, goes_on, chunk_turns),
            f"conv {kind}, segment long, part long, cut boolean, turns {_TURNS.simpleString()}, m array<double>",
        )
    )
    ways = (
        chunks.groupBy("conv")
        .agg(F.sort_array(F.collect_list(F.struct("segment", "part", "m"))).alias("own"))
        .select("conv", F.explode(route("own")).alias("way"))
    )
    c, w = chunks.alias("c"), ways.alias("w")
    same = F.col("c.conv").eqNullSafe(F.col("w.conv")) & (F.col("c.segment") == F.col("w.way.segment")) & (F.col("c.part") == F.col("w.way.part"))
    pieces = (
        c.join(w, same)
        .select("c.conv", "c.segment", "c.part", "c.cut", F.size("c.turns").cast("long").alias("n_turns"), rendered("c.turns", "w.way.enter", "w.way.leave", "w.way.last").alias("r"))
        .select("conv", "segment", "part", "cut", "n_turns", "r.*")
    )
    if not before:
        return pieces.select("conv", "segment", "n_turns", "n_out", "cost", "edits", "rendered")
    # The few segments that lie in more than one partition are put together.
    each = F.sort_array(F.collect_list(F.struct("part", "edits", "rendered")))
    joined = pieces.filter("cut").groupBy("conv", "segment").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("n_out").alias("n_out"), F.sum("cost").alias("cost"), each.alias("each")
    )
    return pieces.filter("not cut").select("conv", "segment", "n_turns", "n_out", "cost", "edits", "rendered").unionByName(
        joined.select(
            "conv", "segment", "n_turns", "n_out", "cost",
            F.array_join("each.edits", ",").alias("edits"), F.array_join("each.rendered", "").alias("rendered"),
        )
    )
