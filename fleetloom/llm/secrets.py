"""Secrets in texts: fixed patterns, and strings of high entropy in a sliding window."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# Runs of the class are taken whole, so shorter ones need not be found to be dropped.
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"

# Character classes, the first that has all characters of a candidate counts, and the entropy in bits from
# which a window is no chance product of language.
CLASSES: Mapping[str, tuple[str, float]] = {
    "high_hex": (r"^[0-9a-fA-F]+$", 2.95),
    "high_alnum": (r"^[0-9A-Za-z]+$", 3.65),
    "high_base64": (r"^.+$", 3.85),
}
# Candidates that are no secrets: identifiers, numbers and dates, words and paths, placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
    r"(?i)(example|sample|placeholder|dummy|xxxxx|00000|12345678)",
)

_SPANS = "array<struct<start:int,end:int,match:string>>"


def _spans(text: Column, matches: Column, pattern: str) -> Column:
    """Where the matches are. What stands between them is cut out by the same pattern, and lengths add up."""
    pieces = F.slice(
        F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match"))),
        1,
        F.size(matches),
    )

    def add(so_far: Column, piece: Column) -> Column:
        start = so_far["at"] + piece["gap"]
        end = start + F.length(piece["match"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(so_far["out"], F.array(span)).cast(_SPANS).alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(pieces, nothing, add, lambda done: done["out"])).otherwise(
        F.array().cast(_SPANS)
    )


def _hot_windows(candidate: Column, threshold: Column) -> Column:
    """The stretches of the candidate covered by windows whose Shannon entropy reaches the threshold.

    One pass over the characters: the counts in the window change by the character that comes in and the
    one that goes out, and so does the sum of n*log2(n) over the counts, which is all the entropy needs.
    """
    codes = F.slice(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c)), 1, F.length(candidate))
    weigh = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)])
    state = f"struct<i:int,counts:array<int>,total:double,from:int,to:int,out:{_HOT}>"

    def step(s: Column, code: Column) -> Column:
        # Place 0 counts nothing; the character that goes out leaves before the other comes in.
        come, gone = code["come"], code["gone"]
        less = F.get(s["counts"], gone)
        left = s["total"] + F.when(gone > 0, F.get(weigh, less - 1) - F.get(weigh, less)).otherwise(F.lit(0.0))
        more = F.get(s["counts"], come) - F.when(gone == come, 1).otherwise(0)
        counts = F.transform(
            s["counts"], lambda n, j: n + F.when(j == come, 1).otherwise(0) - F.when((j == gone) & (gone > 0), 1).otherwise(0)
        )
        return _bound(left + F.get(weigh, more + 1) - F.get(weigh, more), lambda total: moved(s, counts, total))

    def moved(s: Column, counts: Column, total: Column) -> Column:
        i = s["i"] + 1
        hot = (i >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= threshold)
        apart = hot & (s["to"] >= 0) & (i - WINDOW > s["to"])
        closed = F.array(F.struct(s["from"].alias("from"), s["to"].alias("to")))
        return F.struct(
            i.alias("i"),
            counts.alias("counts"),
            total.alias("total"),
            F.when(hot & ((s["to"] < 0) | apart), i - WINDOW).otherwise(s["from"]).alias("from"),
            F.when(hot, i).otherwise(s["to"]).alias("to"),
            F.when(apart, F.concat(s["out"], closed)).otherwise(s["out"]).alias("out"),
        ).cast(state)

    begin = F.struct(
        F.lit(0).alias("i"),
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(-1).alias("from"),
        F.lit(-1).alias("to"),
        F.array().cast(_HOT).alias("out"),
    ).cast(state)
    last = lambda s: F.when(
        s["to"] >= 0, F.concat(s["out"], F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))
    ).otherwise(s["out"])

    def slide(codes: Column) -> Column:
        gone = lambda i: F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(0))
        pairs = F.transform(codes, lambda come, i: F.struct(come.alias("come"), gone(i).alias("gone")))
        return F.aggregate(pairs, begin, step, lambda s: last(s).cast(_HOT))

    return _bound(codes, slide)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


_HOT = "array<struct<from:int,to:int>>"
_FOUND = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _of_kind(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    ).cast(_FOUND)


def _written(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: Mapping[str, tuple[str, float]] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """Secrets of every whole text: ``doc_id``, base ``assign``, ``access``, ``hex`` and added ``high`` spans.

    Base spans are the leftmost matches of each pattern that do not overlap; those too short (a value of
    under 8 characters, an access key of under 16) are dropped after matching, so what they covered is not
    searched again. Added spans are stretches of candidates (long runs of letters, digits and ``+/_=-``) in
    which some window reaches the entropy of its character class. A candidate that an allow-list pattern
    knows, or that overlaps a base span, adds nothing.

    Positions are code points, ends exclusive. NULL texts count as empty and have no spans. One row per
    input row, in arrays of ``(start, rank, end, kind)``; other columns are ignored.
    """
    text = F.col("text")
    all_of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    matched = rows.select("doc_id", "text", *[all_of(p).alias(k) for k, p in patterns.items()])
    placed = matched.select("doc_id", *[_spans(text, F.col(k), p).alias(k) for k, p in patterns.items()])
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2))
    base = placed.select(
        "doc_id",
        _of_kind(F.filter("assign", lambda s: value(s) >= 8), "assign", 0).alias("assign"),
        _of_kind(F.filter("access", lambda s: F.length(s["match"]) >= 16), "access", 1).alias("access"),
        _of_kind(F.col("hex"), "hex", 2).alias("hex"),
        "candidate",
    ).withColumn("base", F.concat("assign", "access", "hex"))

    def unknown(c: Column) -> Column:
        fine = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        for pattern in allowed:
            fine = fine & ~c["match"].rlike(pattern)
        return fine

    def first_class(c: Column, values: Sequence[Column]) -> Column:
        chosen = None
        for (pattern, _), v in zip(classes.values(), values, strict=True):
            holds = c["match"].rlike(pattern)
            chosen = F.when(holds, v) if chosen is None else chosen.when(holds, v)
        return chosen

    def stretches(c: Column) -> Column:
        threshold = first_class(c, [F.lit(bits) for _, bits in classes.values()])
        kind = first_class(c, [F.lit(name) for name in classes])
        rank = first_class(c, [F.lit(len(KINDS) + i) for i in range(len(classes))])
        return F.transform(
            _hot_windows(c["match"], threshold),
            lambda w: F.struct(
                (c["start"] + w["from"]).alias("start"), rank.alias("rank"), (c["start"] + w["to"]).alias("end"), kind.alias("kind")
            ),
        ).cast(_FOUND)

    chosen = base.withColumn("candidate", F.filter("candidate", unknown))
    return chosen.select(
        "doc_id", "assign", "access", "hex", "base", F.flatten(F.transform("candidate", stretches)).alias("high")
    )


def secrets_report(docs: DataFrame, **settings) -> DataFrame:
    """Counts per document, the digest of the base spans, and all spans as text."""
    found = find_secrets(docs, **settings)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat("base", "high")).alias("spans"),
    )
