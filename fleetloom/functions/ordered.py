"""Order-dependent building blocks that hold up when one key has most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.durable import durable


def with_previous(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Add, to each row, values of the row before it in its series.

    ``values`` maps new column names to existing ones. ``order_by`` must order the rows of a series up to rows
    that are equal in it and in ``values``. Rows are dealt out by ranges of (keys, order) of about equal size and
    written, so that the ranges are settled once: neither a series nor a moment that has most of the
    rows meets in one task, and rows equal in all of it are spread by a random number. The only row of
    another range that a range needs is the last one before it, which is carried over.
    """
    used = list(dict.fromkeys([*keys, *order_by, *values.values()]))
    ranged = df.withColumn("_tie", F.rand(0)).repartitionByRange(*keys, *order_by, "_tie").drop("_tie")
    rows = durable(ranged.withColumn("_part", F.spark_partition_id()))
    last = rows.groupBy("_part").agg(F.max(F.struct(*used)).alias("_last"))
    # One row per range that has rows.
    following = F.lead("_part").over(Window.orderBy("_part"))
    carried = last.select(following.alias("_part"), "_last.*", F.lit(True).alias("_carried")).where(F.col("_part").isNotNull())
    within = Window.partitionBy("_part", *keys).orderBy(F.desc("_carried"), *order_by)
    return (
        rows.withColumn("_carried", F.lit(False))
        .unionByName(carried, allowMissingColumns=True)
        .withColumns({new: F.lag(old).over(within) for new, old in values.items()})
        .where(~F.col("_carried"))
        .drop("_part", "_carried")
    )


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the newest row of ``right`` of its key that is not later; others are left out.

    Both sides have the key and the time. A row of ``right`` without a time holds from the beginning; a row of
    ``left`` without one meets only such rows. Of rows of ``right`` of one key and time the greatest by ``values`` counts. NULL
    key parts equal each other.

    Both sides are dealt out together by ranges of (key, time) of about equal size and written, so that a key with most of
    the rows is spread, and what a range needs of those before it is one row: the last one of ``right``.
    """
    row, held = F.struct("*").alias("_row"), F.struct(*values).alias("_held")
    kind = left.select(row).schema["_row"].dataType
    facts = right.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_row"), held)
    asked = left.select(*keys, time, F.lit(1).alias("_side"), row, F.lit(None).cast(facts.schema["_held"].dataType).alias("_held"))
    order = [*keys, time, "_side", "_held"]
    # The random number spreads rows that are equal in all of it.
    dealt = facts.unionByName(asked).withColumn("_tie", F.rand(0)).repartitionByRange(*order[:-1], "_tie").drop("_tie")
    rows = durable(dealt.withColumn("_part", F.spark_partition_id()))
    last = rows.groupBy("_part").agg(F.max(F.when(F.col("_side") == 0, F.struct(*order))).alias("_last"))
    # One row per range that has rows. The last fact of all ranges before is the one its first key may need.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_part", F.last("_last", ignorenulls=True).over(earlier).alias("_last")).where("_last is not null")
    carried = carried.select("_part", *[F.col("_last")[c].alias(c) for c in order])
    within = Window.partitionBy("_part", *keys).orderBy(time, "_side", "_held").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(carried, allowMissingColumns=True).withColumn("_held", F.last("_held", ignorenulls=True).over(within))
    return met.where((F.col("_side") == 1) & F.col("_held").isNotNull()).select("_row.*", *[F.col("_held")[c].alias(c) for c in values])


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows per key. Spark cuts every map task to ``k`` rows per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def with_global_number(df: DataFrame, order_by: Sequence[str | Column], name: str) -> DataFrame:
    """1-based position of every row in one total order over the whole table.

    Range-sorts the table and writes it, so that the layout is settled once; a row's number is the
    count of rows in the partitions before its own plus its place within it.
    """
    placed = durable(df.orderBy(*order_by).withColumn("_place", F.monotonically_increasing_id()))
    # monotonically_increasing_id: partition number in the upper bits, position in the lower 33.
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, which is what bounds both this window and the broadcast.
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + place + 1)
        .drop("_part", "_place", "_before")
    )
