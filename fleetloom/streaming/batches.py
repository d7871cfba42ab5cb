"""Tables written by micro-batches: one folder per batch, so a repeated batch replaces only its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetloom.sources import files


class BatchTable:
    """Folders ``<root>/batch=<id>`` of Parquet files.

    ``write`` replaces the folder of its batch. Readers name the batches they want, so the folder
    being written is never read. Batch ids of one streaming checkpoint are consecutive from 0.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def folder(self, batch: int) -> str:
        return f"{self.root}/batch={batch}"

    def batches(self) -> list[int]:
        """Batches completely written (their commit marker is there)."""
        names = files.folder_names(self.spark, self.root)
        ids = [int(name.split("=", 1)[1]) for name in names if name.startswith("batch=")]
        return sorted(i for i in ids if files.exists(self.spark, f"{self.folder(i)}/_SUCCESS"))

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.folder(batch))

    def version(self, batch: int) -> DataFrame | None:
        """What one batch wrote, for tables every batch writes anew; None before the first."""
        if batch < 0:
            return None
        return self.spark.read.schema(self.schema).parquet(self.folder(batch))

    def latest(self) -> DataFrame:
        done = self.batches()
        return self.version(done[-1]) if done else self.spark.createDataFrame([], self.schema)

    def appended(self) -> DataFrame:
        """All rows, for tables every batch adds to."""
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self.folder(b) for b in done])

    def forget(self, batch: int) -> None:
        """Remove the version of an old batch, no longer needed by any retry."""
        if batch >= 0:
            files.remove(self.spark, self.folder(batch))
