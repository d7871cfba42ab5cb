"""Latest-state tables kept in hash buckets, so that a load rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.sources import files


class BucketedTable:
    """Parquet table with one folder per bucket of its key and, below it, one per load that changed it.

    The newest load of a bucket is its current state. A load never overwrites what it reads; repeated
    under its number it replaces its own folders only.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.keys, self.buckets = list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _loads(self, bucket: int) -> list[int]:
        names = files.folder_names(self.spark, f"{self.root}/bucket={bucket}")
        return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("load="))

    def newest_load(self) -> int:
        """The newest load of any bucket, -1 before the first."""
        return max((load for bucket in range(self.buckets) for load in self._loads(bucket)), default=-1)

    def current(self, only: Iterable[int] | None = None, before_load: int | None = None) -> DataFrame:
        """Current rows, of some buckets or of all, as they were before a load or as they are."""
        folders = []
        for bucket in range(self.buckets) if only is None else only:
            loads = [n for n in self._loads(bucket) if before_load is None or n < before_load]
            if loads:
                folders.append(f"{self.root}/bucket={bucket}/load={loads[-1]}")
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, rows: DataFrame, load: int) -> None:
        """Write the new state of all buckets that ``rows`` has rows of."""
        (
            rows.withColumns({"bucket": self.bucket(), "load": F.lit(load)})
            .repartition("bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "load")
            .parquet(self.root)
        )

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the keys of ``rows`` fall into: a list no longer than the number of buckets."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def forget(self, buckets: Iterable[int], before_load: int) -> None:
        """Remove superseded states of buckets; the last two before a load are kept for its retry."""
        for bucket in buckets:
            for load in [n for n in self._loads(bucket) if n < before_load][:-2]:
                files.remove(self.spark, f"{self.root}/bucket={bucket}/load={load}")
