"""Readers for snapshot data: Parquet and JDBC tables, XML documents, file listings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_snapshot(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """A snapshot table with its declared schema; nothing is inferred."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(schema).parquet(*paths)


def stream_snapshot(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None
) -> DataFrame:
    """The files of a snapshot folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def jdbc_source(
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 8,
    **options: str,
) -> Callable[[SparkSession], DataFrame]:
    """A reader of one server for the fan-in. ``query`` runs at the server, so do its filters."""

    def read(spark: SparkSession) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).options(**options)
        if partition_column is None:
            return reader.option("query", query).load()
        low, high = bounds
        return (
            reader.option("dbtable", f"({query}) AS snapshot")
            .option("partitionColumn", partition_column)
            .option("lowerBound", low)
            .option("upperBound", high)
            .option("numPartitions", partitions)
            .load()
        )

    return read


def read_documents(spark: SparkSession, path: str, column: str = "textdata", instance: str | None = None) -> DataFrame:
    """Whole text files (XML event files) of one server, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.lit(instance).cast("string").alias("instance_fullname"),
        F.col("value").alias(column), F.col("_metadata.file_path").alias("file_path")
    )


def file_listing(spark: SparkSession, path: str, pattern: str = "*", max_depth: int | None = None) -> DataFrame:
    """Files below a folder, and the folders that hold them, from file metadata only; contents are not read.

    ``depth`` is 1 for what stands in the folder itself and one more for each folder between. Folders without
    any file below are not seen. ``max_depth`` leaves out what stands deeper.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length", F.col("modificationTime").alias("modified_on"))
    )
    # A scheme and host may have been added to the path, so places are counted from its end.
    root = F.lit("/" + path.split("://", 1)[-1].strip("/") + "/")
    below = F.split(F.expr("substring(path, locate(root, path) + length(root))"), "/")
    placed = files.withColumn("root", root).withColumn("steps", below).withColumn("depth", F.size("steps"))
    up = lambda depth: F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - F.col("depth") + depth - 1), "/")
    listed = placed.select(
        up(F.col("depth")).alias("folder"),
        F.element_at("steps", -1).alias("filename"),
        F.col("depth").cast("smallint").alias("depth"),
        F.lit(1).cast("smallint").alias("isfile"),
        "length",
        "modified_on",
    )
    folders = (
        placed.where("depth > 1")
        .select("path", "steps", "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("at"))
        .select(
            up(F.col("at")).alias("folder"),
            F.element_at("steps", F.col("at")).alias("filename"),
            F.col("at").cast("smallint").alias("depth"),
            F.lit(0).cast("smallint").alias("isfile"),
            F.lit(None).cast("bigint").alias("length"),
            F.lit(None).cast("timestamp").alias("modified_on"),
        )
        .distinct()
    )
    every = listed.unionByName(folders)
    return every if max_depth is None else every.where(F.col("depth") <= max_depth)


def read_trace_events(spark: SparkSession, path: str, instance: str | None = None) -> DataFrame:
    """Events of one server's exported XML trace files, one row each; large files are read in splits."""
    from fleetloom.operators.xmlevents import TRACE_EVENT

    return (
        spark.read.format("xml")
        .option("rowTag", "Event")
        .option("ignoreNamespace", "true")
        .schema(TRACE_EVENT)
        .load(path)
        .withColumn("instance_fullname", F.lit(instance).cast("string"))
    )
