"""Latest state of keyed rows as a log of changes: every batch appends, deletions are rows too."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.functions.ordered import first_per_key
from fleetloom.sources import files


class ChangeLog:
    """Upserts and deletes of a stream, appended as plain Parquet by date of change and batch.

    A batch appends, for each key, its last row by ``order_by`` and, if that is a deletion, the last row before it that is none; it
    reads nothing of what was written before, so its work does not depend on the history. A repeated batch replaces
    its own rows. The order decides, not the batch, so the state does not depend on how rows were dealt to batches.

    ``order_by`` must order the rows of a key; of equal ones any counts. Rows without a key part are rows of the key NULL.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], order_by: str, date_col: str, deleted: str):
        """``schema`` has all columns of arriving rows, ``deleted`` is a condition on them that says that the key is gone."""
        self.spark, self.root, self.keys, self.order_by = spark, root.rstrip("/"), list(keys), order_by
        self.date_col, self.deleted = date_col, deleted
        self.columns = T.StructType.fromDDL(schema)
        extra = [T.StructField("_gone", T.BooleanType()), T.StructField("batch", T.LongType()), T.StructField("change_date", T.DateType())]
        self.stored = T.StructType([*self.columns.fields, *extra])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        gone = F.coalesce(F.expr(self.deleted), F.lit(False)).alias("_gone")
        rows = batch.select(*self.columns.names, gone)
        # The last deletion and the last other row of each key: Spark cuts the map tasks to these before the shuffle.
        last = first_per_key(rows, [*self.keys, "_gone"], [F.desc(self.order_by)])
        self._write(last.withColumn("batch", F.lit(batch_id).cast("bigint")))

    def _write(self, rows: DataFrame) -> None:
        dated = rows.withColumn("change_date", F.col(self.date_col).cast("date"))
        # Rows are spread by size, however few days or keys there are.
        dated.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "change_date", "batch"
        ).parquet(self.root)

    def changes(self) -> DataFrame:
        if not files.exists(self.spark, self.root):
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(self.root)

    def current(self, flag: str = "is_dropped") -> DataFrame:
        """One row a key, with what was last known of it and whether it is gone. Keys that were only deleted are not there."""
        values = [c for c in self.columns.names if c not in self.keys]
        order, alive = F.col(self.order_by), ~F.col("_gone")
        latest = self.changes().groupBy(*self.keys).agg(
            F.max_by(F.when(alive, F.struct(*values)), F.when(alive, order)).alias("_row"),
            F.max(F.when(F.col("_gone"), order)).alias("_end"),
            F.max(F.when(alive, order)).alias("_last"),
        )
        dropped = F.coalesce(F.col("_end") > F.col("_last"), F.lit(False)).alias(flag)
        return latest.where("_row is not null").select(*self.keys, *[F.col("_row")[c].alias(c) for c in values], dropped)

    def compact(self, before: str) -> int:
        """Put the changes before a date together: what later state needs of them, in one batch a day; returns rows removed.

        The new rows are written beside the old ones first, and these are removed after that. If it is interrupted, rows
        are there twice at most, which changes no state.
        """
        old = self.changes().where(F.col("change_date") < F.lit(before).cast("date"))
        count = old.count()
        if not count:
            return 0
        number = -1 - uuid.uuid4().int % (1 << 31)
        kept = first_per_key(old, [*self.keys, "_gone"], [F.desc(self.order_by)])
        folders = [r[0] for r in old.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).distinct().collect()]
        self._write(kept.withColumn("batch", F.lit(number).cast("bigint")).drop("change_date"))
        for folder in folders:
            files.remove(self.spark, folder)
        return count - self.changes().where(F.col("change_date") < F.lit(before).cast("date")).count()


def first_within(rows: DataFrame, keys: Sequence[str], time_col: str, delay: str) -> DataFrame:
    """A stream without rows whose key came already, as long as copies are at most ``delay`` apart.

    Spark keeps a key only until the stream's time is ``delay`` past it, so the state does not grow with the
    stream. Rows older than that are late: they are dropped, and counted in the query's progress.
    """
    return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))


def late_rows(query) -> int:
    """Rows that a finished or running query dropped because they came too late, as far as its progress is kept."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
