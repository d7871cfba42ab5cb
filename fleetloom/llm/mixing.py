"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.durable import durable
from fleetloom.llm.common import WORD, text_or_empty

WIDE = "decimal(38,0)"


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Words to take from every source; ``sizes`` has one row per ``source`` with its ``source_size``.

    Sources, sorted by code point with NULL last, weigh ``weights`` in turn and share ``budget`` (a fraction)
    of all words. No target exceeds ``most`` times its source; the excess is shared by weight among the
    others until none is above. The sources that stop are those with the smallest size per weight, so
    sums over the sources in that order find them at once. All is counted in whole numbers; ``up``
    over ``down`` is the expected number of copies of a document, ``target`` that times the size.
    """
    over, under = budget
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1)
    weighed = sizes.select("source", F.col("source_size").cast(WIDE).alias("s"), weight.cast(WIDE).alias("w"))
    # One row per source: these are the only windows over a whole table.
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("s").cast("double") / F.col("w").cast("double"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast(WIDE)
    wide = lambda c: c.cast(WIDE)  # noqa: E731  products and sums stay whole numbers of full width
    summed = weighed.select(
        "*",
        wide(F.sum("s").over(every)).alias("all_s"),
        wide(F.sum("w").over(every)).alias("all_w"),
        wide(F.coalesce(F.sum("s").over(before), none)).alias("less_s"),
        wide(F.coalesce(F.sum("w").over(before), none)).alias("less_w"),
    )
    spare = lambda s: wide(over * F.col("all_s") - under * most * s)  # noqa: E731  words left, times ``under``
    left = lambda w: wide(F.col("all_w") - w)  # noqa: E731  weight left
    stops = wide(F.col("w") * spare(F.col("less_s"))) >= wide(wide(under * most * F.col("s")) * left(F.col("less_w")))
    stopped = summed.withColumn("stops", stops)
    taken = lambda c: wide(F.coalesce(F.sum(F.when(F.col("stops"), F.col(c))).over(every), none))
    solved = stopped.select("*", taken("s").alias("full_s"), taken("w").alias("full_w"))
    up = (
        F.when(F.col("s") == 0, none)
        .when(F.col("stops"), F.lit(most).cast(WIDE))
        .otherwise(wide(F.col("w") * spare(F.col("full_s"))))
    )
    down = F.when(F.col("stops"), F.lit(1).cast(WIDE)).otherwise(wide(wide(under * F.col("s")) * left(F.col("full_w"))))
    target = F.when(F.col("stops"), (most * F.col("s")).cast("double")).otherwise(
        wide(F.col("w") * spare(F.col("full_s"))).cast("double") / wide(under * left(F.col("full_w"))).cast("double")
    )
    return solved.select(
        "source", F.col("s").cast("long").alias("source_size"), target.alias("target"), up.alias("up"), down.alias("down")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size_col: str | None = None,
    weights: Sequence[int] = (5, 2, 1),
    budget: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """The documents with ``size, source_size, target, copies, taken``; ``copies`` says how often the mix has them.

    Systematic sampling: the expected copies of a source's documents are summed up in one order, one
    offset per source (from ``seed``) is added, and a document is taken once per whole number crossed.
    The order goes by size class first, so documents of about one size alternate and the words taken stay
    near the target. A source's order is cut into parts by size class and a hash of the id: each part is
    numbered alone and starts at the counts of the parts before it, so a source with most rows is
    spread over many tasks. The result depends on the rows alone; equal rows are interchangeable.

    NULL texts have size 0. A source without words has target 0 and no copies. Columns of the input
    with the names of the results are replaced. NULL ids and NULL sources are values like others.
    """
    results = ("size", "source_size", "target", "copies", "taken")
    size = word_count(text_col) if size_col is None else F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    salt = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 2)
    tie = [F.xxhash64(text_col)] if text_col in docs.columns else []
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c not in results]).alias("row"),
        # NULL sorts last, as every other source begins with a lower letter.
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("~")).alias("source"),
        F.struct(F.col(id_col).alias("id"), *[t.alias("tie") for t in tie]).alias("rank"),
        size.alias("size"),
        salt.alias("salt"),
    )
    digits = F.bin("size")
    part = F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 3), F.lit("-"), F.col("salt"))
    rows = rows.withColumn("part", part).drop("salt")
    counts = durable(rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    per_source = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    # At most some thousand parts per source: size classes times salts.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col("source")), 256), 1, 8), 16, 10)
    # A share of ``down``, which is what one copy counts.
    starts = first.join(per_source.withColumn("draw", draw.cast(WIDE)), "source").withColumn(
        "offset", F.expr(f"cast((draw * down) div {1 << 32} as {WIDE})")
    )
    number = F.row_number().over(Window.partitionBy("source", "part").orderBy("size", "rank"))
    crossed = f"(cast(first + number - {{}} as {WIDE}) * up + offset) div down"
    copies = F.expr(f"({crossed.format(0)}) - ({crossed.format(1)})")
    return (
        rows.withColumn("number", number)
        .join(starts, ["source", "part"])
        .withColumn("copies", copies)
        .select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
