"""Secret scan with multipart credential linking, in SQL functions only.

Strong spans (each is reported as it stands, leftmost and non-overlapping within its kind):

* ``assign``: a name such as ``password`` or ``api_key``, a separator and a value of 6 or more characters;
* ``access``: an access identifier, ``AKIA`` and capitals or digits, 20 or more characters;
* ``hex``: 24 or more hexadecimal digits in lower case.

Weak candidates are reported only when complementary parts co-occur in a scope (the same document, at most ``scope``
characters apart):

* ``secret``: a run of 32 or more base64 characters with a capital, a small letter and a digit; it needs an access identifier, or a
  user name and an endpoint, near it;
* ``identifier``: a user name or key identifier given by name (``user = ...``, ``access_key_id: ...``); it needs a strong span or a
  weak secret, and an endpoint, near it;
* ``endpoint``: a URL or a database address; it needs an access identifier or ``identifier``, and a strong ``assign`` or ``hex``
  span or a weak secret, near it.

Screens.  Most texts hold nothing, so each pattern is run only where a plain search finds what every match of it must
hold: a key word for ``assign``, ``AKIA`` for ``access``, ``://`` for ``endpoint``, and a run of 24 token characters for ``hex`` and
``secret``.  A weak secret is reported only with an access identifier or an endpoint in its document, and an identifier only with an
endpoint, so neither is looked for where those cannot be.  The screens change no result.

Positions.  ``split`` and ``regexp_extract_all`` see the same matches; the lengths of the pieces in between and of the matches,
added up by a running sum over a document's matches of a kind, give each match's place in linear time.  The interval
join: within a document the spans are ordered by place, and each weak one needs only the nearest part of each other
kind before and behind it, which windows find without forming pairs; whatever lies within the scope, the nearest one
does.

Plan.  One pass over the texts makes a header row for each document and a row for each match; what is shuffled are
numbers, by (id, text hash) at last, which brings a document's matches together.  Texts are never shuffled, and no
group is larger than one document's matches.

Odd input: a null text is empty; every row gets a result, also without an id; rows repeated with the same id and text
are returned as often as they occur; an empty table gives no rows; additional columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base patterns.  The quantifiers of ``access`` and ``hex`` hold the least length, which leaves the same
#: matches as dropping shorter ones afterwards, since both are runs of one class; ``assign`` is filtered afterwards.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ("assign", "access", "hex")

SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}={0,2}"
IDENTIFIER = r"""(?i)(?<![a-z0-9])(?:user(?:_?name)?|login|account(?:_?id)?|access_?key_?id|key_?id|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
ENDPOINT = r"""(?<![A-Za-z0-9])(?:https?|ftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}"""
WEAK = ("secret", "identifier", "endpoint")
KINDS = (*BASE, *WEAK)
PORTION = 1 << 16


#: A run as long as the shortest ``hex`` and of characters that ``hex`` and ``secret`` are made of.
LONG_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}"
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _matches(text: Column, kind: str, pattern: str, screen: Column) -> Column:
    """Array of (order of the kind, number of the match, length of the text between it and the one before, its length,
    whether it counts), lengths in code points; empty where the screen finds nothing."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(0)))
    counts = lambda m: F.char_length(F.regexp_extract(m, pattern, 2)) >= 6 if kind == "assign" else F.lit(True)
    number = F.lit(KINDS.index(kind))
    pairs = F.zip_with(
        found, gaps, lambda m, g: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), counts(m).alias("counts"))
    )
    numbered = F.transform(
        pairs, lambda p, i: F.struct(number.alias("k"), i.alias("i"), p["gap"].alias("gap"), p["size"].alias("size"), p["counts"].alias("counts"))
    )
    return F.when(screen, numbered).otherwise(F.array())


def _list(col: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(col, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ","
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """One row per input row: ``id``, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans`` (strings
    ``kind:start:end`` joined by commas, ordered by start and then kind), ``found`` (the spans as an array of
    ``kind``, ``start``, ``end``)."""
    plain = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text, small = F.col("text"), F.lower(F.col("text"))
    words = F.lit(False)
    for w in KEY_WORDS:
        words = words | F.contains(small, F.lit(w))
    access, endpoint, run = (F.contains(text, F.lit("AKIA")), F.contains(text, F.lit("://")), F.col("run"))
    arrays = [
        _matches(text, "assign", ASSIGN, words),
        _matches(text, "access", ACCESS, access),
        _matches(text, "hex", HEX, run),
        _matches(text, "secret", SECRET, run & (access | endpoint)),
        _matches(text, "identifier", IDENTIFIER, endpoint),
        _matches(text, "endpoint", ENDPOINT, endpoint),
    ]
    none = F.lit(-1)
    header = F.array(F.struct(none.alias("k"), none.alias("i"), none.alias("gap"), F.lit(0).alias("size"), F.lit(True).alias("counts")))
    each = (
        docs.select(F.col(id_col).alias("id"), plain.alias("text"))
        .select("id", "text", F.rlike(F.col("text"), F.lit(LONG_RUN)).alias("run"))
        # Hashed below the explode: beside it, the whole text would be hashed again for each match.
        .select("id", F.xxhash64("text").alias("raw"), F.concat(header, *arrays).alias("ms"))
        .select("id", "raw", F.explode("ms").alias("m"))
        # Rows of repeated documents fall together here and are counted by their headers.
        .groupBy("id", "raw", "m.k", "m.i", "m.gap", "m.size", "m.counts")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    so_far = Window.partitionBy("id", "raw", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        each.repartition("id", "raw")
        .withColumn("b", F.sum(F.col("gap").cast("long") + F.col("size")).over(so_far))
        .filter("counts")
        .select("id", "raw", (F.col("b") - F.col("size")).alias("a"), "k", "b", "n")
    )

    key = Window.partitionBy("id", "raw")
    order = ["a", "k", "b"]
    before = key.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # The rows behind are those before in the reverse order, whose running frame is linear.
    after = key.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)

    def near(*kinds: str) -> Column:
        """Whether a span of these kinds lies within the scope."""
        own = F.col("k").isin([KINDS.index(k) for k in kinds])
        back = F.col("a") - F.max(F.when(own, F.col("b"))).over(before)
        ahead = F.min(F.when(own, F.col("a"))).over(after) - F.col("b")
        return F.coalesce(back <= scope, F.lit(False)) | F.coalesce(ahead <= scope, F.lit(False))

    kind = lambda name: F.col("k") == KINDS.index(name)
    part = {
        "by_access": near("access"),
        "by_name": near("identifier"),
        "by_endpoint": near("endpoint"),
        "by_value": near("assign", "hex", "secret"),
        "by_strong": near("assign", "access", "hex", "secret"),
    }
    linked = (
        (F.col("k") < len(BASE))
        | (kind("secret") & (F.col("by_access") | (F.col("by_name") & F.col("by_endpoint"))))
        | (kind("identifier") & F.col("by_strong") & F.col("by_endpoint"))
        | (kind("endpoint") & (F.col("by_access") | F.col("by_name")) & F.col("by_value"))
    )
    span = F.struct("a", "k", "b")
    shown = rows.withColumns(part).filter(linked)
    count = lambda name: F.count(F.when(kind(name), 1)).alias(f"n_{name}")
    return (
        shown.groupBy("id", "raw")
        .agg(
            F.max(F.when(F.col("k") == -1, F.col("n"))).alias("copies"),
            *[count(k) for k in BASE],
            F.array_sort(F.collect_list(F.when(F.col("k") >= 0, span))).alias("all"),
        )
        .select(
            "id",
            *[f"n_{k}" for k in BASE],
            _list(F.filter("all", lambda s: s["k"] < len(BASE))).alias("base"),
            _list(F.col("all")).alias("spans"),
            F.transform(
                "all",
                lambda s: F.struct(
                    F.get(F.array(*[F.lit(k) for k in KINDS]), s["k"]).alias("kind"), s["a"].alias("start"), s["b"].alias("end")
                ),
            ).alias("found"),
            "copies",
            # Rows that repeat are given out in portions, since a third of a table may be one row.
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PORTION).cast("long"))).alias("portion"),
        )
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.least(F.col("copies") - F.col("portion"), F.lit(PORTION)).cast("int"))))
        .drop("copies", "portion", "copy")
    )
