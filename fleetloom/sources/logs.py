"""Append logs partitioned by date, the sink of the sample collectors."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.sources import files

NO_DATE = "__HIVE_DEFAULT_PARTITION__"


class DatedLog:
    """Parquet log with one folder per day and, below it, one per load.

    A load repeated under its number replaces its own rows only. Reading a range of days lists and
    reads these days' folders, however long the log is.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, date_col: str = "sample_date"):
        self.spark, self.root, self.schema, self.date_col = spark, root.rstrip("/"), schema, date_col

    def write(self, rows: DataFrame, load: int) -> None:
        (
            rows.withColumn("load", F.lit(load))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(self.date_col, "load")
            .parquet(self.root)
        )

    def days(self) -> list[str]:
        """Days present, as ISO text; the folder of rows without a date comes under its own name."""
        prefix = f"{self.date_col}="
        return sorted(n[len(prefix) :] for n in files.folder_names(self.spark, self.root) if n.startswith(prefix))

    def rows(self, first: date = date.min, last: date = date.max, before_load: int | None = None) -> DataFrame:
        """Rows of a range of days (rows without a date always included), of the loads before one."""
        low, high = str(first), str(last)
        wanted = [d for d in self.days() if d == NO_DATE or low <= d <= high]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        log = (
            self.spark.read.schema(f"{self.schema}, load INT")
            .option("basePath", self.root)
            .parquet(*[f"{self.root}/{self.date_col}={d}" for d in wanted])
        )
        if before_load is not None:
            log = log.where(F.col("load") < before_load)
        return log.drop("load")

    def expire(self, days: int, as_of: date) -> list[str]:
        """Remove the folders of days that lie wholly before the retained ones; returns them.

        The oldest retained day may still have rows past their time: reports filter these by time.
        """
        oldest = str(as_of - timedelta(days=days))
        expired = [d for d in self.days() if d != NO_DATE and d < oldest]
        for day in expired:
            files.remove(self.spark, f"{self.root}/{self.date_col}={day}")
        return expired
