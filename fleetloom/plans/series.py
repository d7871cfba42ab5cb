"""Time-series operators over events, line items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators import series
from fleetloom.plans.registry import Tables, query


def event_samples(tables: Tables, object_name: str = "srv:SQL Statistics") -> DataFrame:
    """Events as counter samples: one series per user and event type."""
    return tables.events.select(
        F.concat(F.lit("node-"), "user_id").alias("instance_fullname"),
        F.lit(object_name).alias("object_name"),
        F.col("event_type").alias("counter_name"),
        F.lit(None).cast("string").alias("instance_name"),
        F.col("ts").alias("sample_time"),
        F.round(F.col("value") * 100).cast("bigint").alias("cntr_value"),
    )


RATES_SQL = """
    SELECT 'node-' || user_id AS instance_fullname, event_type AS counter_name, ts AS sample_time,
           CASE WHEN step IS NULL OR step < 0 THEN 0.0
                ELSE ((200 * step + secs) // (2 * secs))::DOUBLE / 100 END::DOUBLE AS counter_value
    FROM (SELECT *, v - lag(v) OVER w AS step, greatest(coalesce(datediff('second', lag(ts) OVER w, ts), 1), 1) AS secs
          FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events)
          WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts))
"""


@query("counter_rates", RATES_SQL)
def counter_rates(tables: Tables) -> DataFrame:
    """Rate of change of the event values per user and type."""
    return series.counter_rates(event_samples(tables)).select(
        "instance_fullname", "counter_name", "sample_time", F.col("counter_value").cast("double").alias("counter_value")
    )


@query(
    "replica_stats",
    """
    WITH s AS (SELECT user_id, date_trunc('day', ts) AS t, event_type, event_id,
                      CAST(round(value * 100) AS BIGINT) AS v
               FROM events WHERE event_type IN ('click', 'view')),
    d AS (SELECT *, v - lag(v) OVER w AS step, datediff('second', lag(t) OVER w, t) AS secs FROM s
          WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t, v)),
    g AS (SELECT user_id, t,
                 sum(CASE WHEN event_type = 'click' AND secs <> 0
                          THEN CASE WHEN step <= 0 THEN 1 ELSE step END::DOUBLE / secs END) AS tran_count,
                 sum(CASE WHEN event_type = 'view' THEN CASE WHEN step < 0 THEN 0 ELSE step END END) AS tran_delay,
                 sum(CASE WHEN event_type = 'view' THEN step END) AS delay
          FROM d GROUP BY user_id, t)
    SELECT 'node-' || user_id AS instance_fullname, t AS sample_time, round(tran_count, 6) AS tran_count,
           CAST(tran_delay AS BIGINT) AS tran_delay,
           round(delay::DOUBLE / nullif(tran_count, 0), 4) AS avg_tran_delay
    FROM g
    """,
)
def replica_stats(tables: Tables) -> DataFrame:
    """Clicks as mirrored writes and views as delays, sampled by day."""
    kind = F.col("counter_name")
    samples = event_samples(tables, "srv:Database Replica").withColumns(
        {
            "sample_time": F.date_trunc("day", "sample_time"),
            "counter_name": F.when(kind == "click", series.REPLICA_WRITES)
            .when(kind == "view", series.REPLICA_DELAY),
        }
    )
    return series.replica_stats(samples.where(F.col("counter_name").isNotNull())).select(
        "instance_fullname",
        "sample_time",
        F.round("tran_count", 6).alias("tran_count"),
        "tran_delay",
        F.round("avg_tran_delay", 4).alias("avg_tran_delay"),
    )


CPU_SQL = """
    SELECT event_type AS host_name, date_trunc('minute', ts + INTERVAL 30 SECOND) AS event_datetime,
           CAST(ts AS DATE) AS event_date,
           event_type || CASE WHEN user_id > 100 THEN '' ELSE '\\' || (user_id // 50) END AS instance_fullname,
           CAST(floor(sum(floor(value))::DOUBLE / count(*)) AS INTEGER) AS cpu_utilization_sqlserver,
           CAST(floor(sum(100 - floor(value / 5))::DOUBLE / count(*)) AS INTEGER) AS cpu_utilization_others
    FROM events WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1, 2, 3, 4
"""


def cpu_samples(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("hostname"),
        F.when(F.col("user_id") <= 100, F.floor(F.col("user_id") / 50).cast("string")).alias("sql_instance_name"),
        F.col("ts").alias("event_time"),
        F.floor("value").cast("int").alias("cpu_percent_sql_server"),
        (100 - F.floor(F.col("value") / 5)).cast("int").alias("cpu_percent_others"),
    )


@query("cpu_utilization", CPU_SQL)
def cpu_utilization(tables: Tables) -> DataFrame:
    """Event values as CPU shares, by type, minute and day."""
    return series.cpu_utilization(cpu_samples(tables.events), as_of="2024-02-19 12:00:00")


def line_sizes(tables: Tables) -> DataFrame:
    """Line items as daily size rows: one per flag, status, supplier and ship date load."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return tables.lineitem.select(
        F.concat(F.lit("host\\"), "l_suppkey").alias("instancefullname"),
        F.concat(F.lit("db"), "l_linenumber").alias("databasename"),
        F.to_date("l_shipdate").alias("log_date"),
        F.col("l_returnflag").alias("usagetype"),
        F.col("l_linestatus").alias("allocationtype"),
        F.lit(None).cast("string").alias("filegroupname"),
        cents.alias("reserved_mb"),
        F.col("l_quantity").cast("bigint").alias("used_mb"),
        # Load time: unique within a day of a series but for a handful of ties, then by size.
        (F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_orderkey"))).alias("modified_on"),
    )


SIZES_SQL = """
    SELECT 'host\\' || l_suppkey AS instancefullname, 'db' || l_linenumber AS databasename,
           CAST(l_shipdate AS DATE) AS log_date, l_returnflag AS usagetype, l_linestatus AS allocationtype,
           NULL::VARCHAR AS filegroupname, CAST(round(l_extendedprice * 100) AS BIGINT) AS reserved_mb,
           CAST(l_quantity AS BIGINT) AS used_mb, l_shipdate + to_seconds(l_orderkey) AS modified_on
    FROM lineitem
"""


@query(
    "size_growth",
    f"""
    WITH s AS ({SIZES_SQL}),
    newest AS (SELECT * FROM s WHERE log_date >= DATE '1998-11-01'
        QUALIFY row_number() OVER (PARTITION BY instancefullname, databasename, usagetype, allocationtype, log_date
                                   ORDER BY modified_on DESC, reserved_mb, used_mb) = 1)
    SELECT *, used_mb - lag(used_mb) OVER w AS daily_change_mb,
           CASE WHEN used_mb < lag(used_mb) OVER w THEN 0 ELSE used_mb - lag(used_mb) OVER w END AS daily_change2_mb
    FROM newest
    WINDOW w AS (PARTITION BY instancefullname, databasename, usagetype, allocationtype ORDER BY log_date)
    """,
)
def size_growth(tables: Tables) -> DataFrame:
    """Change of the daily line quantities per supplier, line, flag and status."""
    return series.size_growth(line_sizes(tables), as_of="2001-11-30", days=1125)


@query(
    "latest_db_size",
    f"""
    WITH s AS ({SIZES_SQL}),
    newest AS (SELECT * FROM s WHERE log_date >= DATE '1998-11-01'
        QUALIFY row_number() OVER (PARTITION BY instancefullname, databasename, usagetype, allocationtype
                                   ORDER BY log_date DESC, modified_on DESC, reserved_mb DESC, used_mb DESC) = 1)
    SELECT instancefullname, databasename, CAST(sum(reserved_mb) AS BIGINT) AS reserved_mb,
           CAST(sum(used_mb) AS BIGINT) AS used_mb
    FROM newest GROUP BY 1, 2
    """,
)
def latest_db_size(tables: Tables) -> DataFrame:
    """Newest line sizes per flag and status, summed per supplier and line."""
    return series.latest_db_size(line_sizes(tables), as_of="2001-11-30", days=1125)


@query(
    "error_log_context",
    """
    SELECT 'conv-' || conv_id AS instance_fullname, TIMESTAMP '2024-01-01' + to_minutes(20 * turn) AS date,
           turn AS line_no, role AS processinfo, text AS messagetext,
           lag(text, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS error
    FROM conversations WHERE text NOT LIKE 'The %'
    """,
)
def error_log_context(tables: Tables) -> DataFrame:
    """Conversation turns beside the turn before, turns with a certain beginning left out."""
    log = tables.conversations.select(
        F.concat(F.lit("conv-"), "conv_id").alias("instance_fullname"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("turn").cast("int") * 20)).alias("date"),
        F.col("turn").alias("line_no"),
        F.col("role").alias("processinfo"),
        "text",
    )
    return series.error_log_context(log, "2024-01-01", "2025-01-01", exclude_prefix="The ")
