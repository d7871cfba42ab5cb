"""Streaming jobs over the event files, run until all files are read."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.durable import shared_folder
from fleetloom.plans.registry import Tables, query
from fleetloom.plans.series import CPU_SQL, RATES_SQL, cpu_samples
from fleetloom.streaming import changes, streams

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(tables: Tables) -> DataFrame:
    return (
        # As a pattern the path may be one file or a folder of files.
        tables.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 64).parquet(f"{tables.folder.rstrip('/')}/events.parque[t]")
    )


@query(
    "stream_cpu_utilization",
    CPU_SQL.replace("ts >= TIMESTAMP '2024-01-05 12:00:00'", "true")
    + """
    HAVING date_trunc('minute', ts + INTERVAL 30 SECOND) + INTERVAL 30 SECOND
        <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE
    """,
)
def stream_cpu_utilization(tables: Tables) -> DataFrame:
    """Mean shares of all minutes closed when the files end."""
    work = shared_folder(tables.spark, "stream-cpu")
    job = streams.CpuUtilization(tables.spark, work, delay=timedelta(minutes=10))
    streams.start_batches(cpu_samples(event_stream(tables)), job, f"{work}/checkpoint").awaitTermination()
    return job.closed()


@query(
    "stream_counter_rates",
    f"SELECT * FROM ({RATES_SQL}) WHERE sample_time <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
def stream_counter_rates(tables: Tables) -> DataFrame:
    """Rates of all samples at least ten minutes older than the newest."""
    work = shared_folder(tables.spark, "stream-rates")
    samples = event_stream(tables).select(
        F.concat(F.lit("node-"), "user_id").alias("instance_fullname"),
        F.lit("events").alias("object_name"),
        F.col("event_type").alias("counter_name"),
        F.lit(None).cast("string").alias("instance_name"),
        F.col("ts").alias("sample_time"),
        F.round(F.col("value") * 100).cast("bigint").alias("cntr_value"),
    )
    job = streams.CounterRates(tables.spark, work, delay=timedelta(minutes=10), keep_late=True)
    streams.start_batches(samples, job, f"{work}/checkpoint").awaitTermination()
    return job.settled().select(
        "instance_fullname", "counter_name", "sample_time", F.col("counter_value").cast("double").alias("counter_value")
    )


@query(
    "stream_insert_new",
    """
    SELECT event_type, user_id, CAST(ts AS DATE) AS sample_date, date_trunc('hour', ts) AS sample_time, event_id, value
    FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id, date_trunc('hour', ts) ORDER BY event_id) = 1
    """,
)
def stream_insert_new(tables: Tables) -> DataFrame:
    """The first event per type, user and hour."""
    work = shared_folder(tables.spark, "stream-insert")
    rows = event_stream(tables).select(
        "event_type",
        "user_id",
        F.date_trunc("hour", "ts").alias("sample_time"),
        F.to_date("ts").alias("sample_date"),
        "event_id",
        "value",
    )
    job = streams.InsertNew(
        tables.spark,
        f"{work}/log",
        "event_type STRING, user_id BIGINT, sample_time TIMESTAMP, sample_date DATE, event_id BIGINT, value DOUBLE",
        keys=["event_type", "user_id", "sample_time"],
        order_by=["event_id"],
        date_col="sample_date",
        any_order=True,
    )
    streams.start_batches(rows, job, f"{work}/checkpoint").awaitTermination()
    return job.rows()


@query(
    "stream_upsert",
    """
    SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value,
           max(ts) AS created_on, NULL::TIMESTAMP AS modified_on
    FROM events GROUP BY user_id
    """,
)
def stream_upsert(tables: Tables) -> DataFrame:
    """The last event of each user."""
    work = shared_folder(tables.spark, "stream-upsert")
    job = streams.UpsertRuns(
        tables.spark,
        work,
        "user_id BIGINT, event_type STRING, value DOUBLE, created_on TIMESTAMP, modified_on TIMESTAMP",
        "user_id BIGINT, event_type STRING, value DOUBLE, ts TIMESTAMP, event_id BIGINT",
        keys=["user_id"],
        update_cols=["event_type", "value"],
        order_by=[F.desc("event_id")],
        as_of=F.col("s.ts"),
        buckets=8,
    )
    streams.start_batches(
        event_stream(tables).select("user_id", "event_type", "value", "ts", "event_id"), job, f"{work}/checkpoint"
    ).awaitTermination()
    job.finish()
    return job.table.current()


@query(
    "stream_change_log",
    """
    SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS event_type,
           arg_max(value, event_id) FILTER (event_type <> 'error') AS value, arg_max(ts, event_id) FILTER (event_type <> 'error') AS ts,
           max(event_id) FILTER (event_type <> 'error') AS event_id,
           coalesce(max(event_id) FILTER (event_type = 'error') > max(event_id) FILTER (event_type <> 'error'), false) AS is_dropped
    FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'error') > 0
    """,
)
def stream_change_log(tables: Tables) -> DataFrame:
    """The last event of each user that is no error; a user whose last event is one is gone. Old changes are compacted."""
    work = shared_folder(tables.spark, "stream-changes")
    row = "user_id BIGINT, event_type STRING, value DOUBLE, ts TIMESTAMP, event_id BIGINT"
    log = changes.ChangeLog(tables.spark, f"{work}/log", row, ["user_id"], "event_id", "ts", "event_type = 'error'")
    rows = event_stream(tables).select("user_id", "event_type", "value", "ts", "event_id")
    streams.start_batches(rows, log, f"{work}/checkpoint").awaitTermination()
    log.compact("2024-01-15")
    return log.current()


@query(
    "stream_first_within",
    """
    SELECT DISTINCT event_type, user_id, date_trunc('hour', ts) AS sample_time FROM events
    """,
)
def stream_first_within(tables: Tables) -> DataFrame:
    """Types and users by hour, once each, deduplicated by Spark's bounded state: however files of two months are ordered."""
    work = shared_folder(tables.spark, "stream-first")
    rows = event_stream(tables).select("event_type", "user_id", F.date_trunc("hour", "ts").alias("sample_time"))
    once = changes.first_within(rows, ["event_type", "user_id", "sample_time"], "sample_time", "62 days")
    streams.start_files(once, f"{work}/rows", f"{work}/checkpoint").awaitTermination()
    return tables.spark.read.schema("event_type STRING, user_id BIGINT, sample_time TIMESTAMP").parquet(f"{work}/rows")
