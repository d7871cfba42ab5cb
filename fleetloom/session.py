"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings, safe to put on a session somebody else made.
RUNTIME = {
    # Zone-less timestamps in snapshot files are UTC instants; reading them as such lets
    # time filters reach the scan.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    # Hot join keys are split at run time; the extra shuffle is worth it when
    # one key holds a large share of the rows.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def size_shuffles(spark: SparkSession, shuffled_bytes: int, per_task: int = 128 << 20) -> int:
    """Set the number of shuffle partitions for the largest shuffle of a job, and return it.

    Tasks then get about ``per_task`` bytes, few enough to sort without much spilling; partitions
    that turn out small are put together at run time.
    """
    partitions = max(-(-shuffled_bytes // per_task), 200)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return partitions


def local_session(cpus: int = 8, app: str = "fleetloom", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in RUNTIME.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
