"""Time series: counter rates, size growth, utilization, replica delay, log context, latest sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import times
from fleetloom.functions.ordered import first_per_key, with_previous
from fleetloom.functions.times import AsOf

# Counters and messages the reports look for.
STATISTICS_OBJECT = "SQL Statistics"
REPLICA_OBJECT = "Database Replica"
REPLICA_WRITES = "Mirrored Write Transactions/sec"
REPLICA_DELAY = "Transaction Delay"
BOILERPLATE_MESSAGE = "This instance of SQL Server has been using a process ID "
# End of the fixed values.

COUNTER_SERIES = ["instance_fullname", "object_name", "counter_name", "instance_name"]
SIZE_SERIES = ["instancefullname", "databasename", "usagetype", "allocationtype", "filegroupname"]


def _counter_steps(samples: DataFrame, keys: Sequence[str], time_col: str, value_col: str) -> DataFrame:
    """Change of the counter and seconds since the previous sample of the same series."""
    return (
        with_previous(
            samples,
            keys,
            [time_col, value_col],
            {"_last_time": time_col, "_last_value": value_col},
        )
        .withColumns(
            {
                "_step": F.col(value_col) - F.col("_last_value"),
                "_secs": times.seconds_between(F.col("_last_time"), F.col(time_col)),
            }
        )
        .drop("_last_time", "_last_value")
    )


def rate_of(step: Column, secs: Column) -> Column:
    """Counter change per second to two places.

    A falling counter (restart) and the first sample give 0, intervals of no length count as a second.
    """
    change = F.when(step < 0, 0).otherwise(F.coalesce(step, F.lit(0)))
    length = F.when(secs <= 0, 1).otherwise(F.coalesce(secs, F.lit(1)))
    return (change.cast("decimal(20,0)") / length.cast("decimal(10,0)")).cast("decimal(22,2)")


def counter_rates(
    samples: DataFrame,
    keys: Sequence[str] = COUNTER_SERIES,
    time_col: str = "sample_time",
    value_col: str = "cntr_value",
    object_suffix: str | None = STATISTICS_OBJECT,
) -> DataFrame:
    """Per-second rate of every sample of the cumulative counters, as ``counter_value``."""
    if object_suffix is not None:
        samples = samples.where(F.endswith("object_name", F.lit(object_suffix)))
    steps = _counter_steps(samples.select(*keys, time_col, value_col), keys, time_col, value_col)
    return steps.select(*keys, time_col, rate_of(F.col("_step"), F.col("_secs")).alias("counter_value"))


def replica_stats(samples: DataFrame) -> DataFrame:
    """Mirrored transactions, their delay and the delay per transaction of every sample."""
    replicas = samples.where(F.endswith("object_name", F.lit(REPLICA_OBJECT)))
    steps = _counter_steps(
        replicas.select(*COUNTER_SERIES, "sample_time", "cntr_value"),
        COUNTER_SERIES,
        "sample_time",
        "cntr_value",
    )
    step, counter = F.col("_step"), F.col("counter_name")
    written = F.when(
        counter == REPLICA_WRITES, F.try_divide(F.when(step <= 0, 1).otherwise(step).cast("double"), F.col("_secs"))
    )
    delayed = F.when(counter == REPLICA_DELAY, step)
    return (
        steps.groupBy("instance_fullname", "sample_time")
        .agg(
            F.sum(written).alias("tran_count"),
            F.sum(F.when(delayed < 0, 0).otherwise(delayed)).alias("tran_delay"),
            F.sum(delayed).alias("_delay"),
        )
        .select(
            "instance_fullname",
            "sample_time",
            "tran_count",
            "tran_delay",
            F.try_divide(F.col("_delay").cast("double"), F.col("tran_count")).alias("avg_tran_delay"),
        )
    )


def cpu_utilization(samples: DataFrame, as_of: AsOf, days: int = 45) -> DataFrame:
    """Mean CPU share per host, instance, rounded minute and day; whole numbers in, whole numbers out."""
    recent = samples.where(F.col("event_time") >= times.days_before(as_of, days))

    def whole_mean(name: str) -> Column:
        return F.expr(f"sum(`{name}`) div count(`{name}`)").cast("int")

    return (
        recent.groupBy(
            "hostname",
            "sql_instance_name",
            # A sample in the last half minute of a day counts to the next day's first minute.
            times.nearest_minute(F.col("event_time")).alias("event_datetime"),
            F.to_date("event_time").alias("event_date"),
        )
        .agg(
            whole_mean("cpu_percent_sql_server").alias("cpu_utilization_sqlserver"),
            whole_mean("cpu_percent_others").alias("cpu_utilization_others"),
        )
        .select(
            F.col("hostname").alias("host_name"),
            "event_datetime",
            "event_date",
            F.concat("hostname", F.coalesce(F.concat(F.lit("\\"), "sql_instance_name"), F.lit(""))).alias(
                "instance_fullname"
            ),
            "cpu_utilization_sqlserver",
            "cpu_utilization_others",
        )
    )


def since_day(date_col: str, as_of: AsOf, days: int) -> Column:
    """Days not older than ``days`` before the moment; the first test prunes date partitions."""
    cutoff = times.days_before(as_of, days)
    return (F.col(date_col) >= F.to_date(cutoff)) & (F.col(date_col).cast("timestamp") >= cutoff)


def size_growth(
    sizes: DataFrame,
    as_of: AsOf,
    days: int = 60,
    series_keys: Sequence[str] = SIZE_SERIES,
    date_col: str = "log_date",
    value_col: str = "used_mb",
    modified_col: str = "modified_on",
    strict: bool = False,
) -> DataFrame:
    """Daily change of a size series, plain and with shrinking shown as 0.

    Only the newest of several rows of a day counts, and is chosen before the change is taken.
    ``strict`` takes the change first and over a series of database, usage and allocation alone,
    which compares rows of different file groups, servers and loads with each other.
    """
    recent = sizes.where(since_day(date_col, as_of, days))
    rest = [c for c in recent.columns if c not in {*series_keys, date_col, modified_col}]
    newest = [F.desc(modified_col), *rest]
    if strict:
        series = ["databasename", "usagetype", "allocationtype"]
        day = [date_col, *series, "filegroupname"]
        order = [date_col, modified_col, *[c for c in recent.columns if c not in {*series, date_col, modified_col}]]
    else:
        series, day = list(series_keys), [*series_keys, date_col]
        order = [date_col, value_col]
        recent = first_per_key(recent, day, newest)
    changes = with_previous(recent, series, order, {"_before": value_col})
    if strict:
        changes = first_per_key(changes, day, newest)
    change = F.col(value_col) - F.col("_before")
    return changes.withColumns(
        {"daily_change_mb": change, "daily_change2_mb": F.when(change < 0, 0).otherwise(change)}
    ).drop("_before")


def latest_db_size(
    sizes: DataFrame,
    as_of: AsOf,
    days: int = 10,
    keys: Sequence[str] = ("usagetype", "allocationtype", "filegroupname"),
    group_by: Sequence[str] = ("instancefullname", "databasename"),
) -> DataFrame:
    """Reserved and used size per database from the newest row of each of its parts.

    ``keys`` are the parts of a database. Leaving the file group and the instance out reproduces
    sums over one arbitrary file group.
    """
    measures = ["reserved_mb", "used_mb"]
    newest = (
        sizes.where(since_day("log_date", as_of, days))
        .groupBy(*group_by, *keys)
        .agg(F.max(F.struct("log_date", "modified_on", *measures)).alias("_newest"))
    )
    return newest.groupBy(*group_by).agg(*[F.sum(f"_newest.{m}").alias(m) for m in measures])


def error_log_context(
    log: DataFrame,
    start: AsOf = None,
    end: AsOf = None,
    partition_by: Sequence[str] = ("instance_fullname",),
    exclude_prefix: str = BOILERPLATE_MESSAGE,
) -> DataFrame:
    """Messages of a time range, each beside the message before it in the same server's log.

    Without ``start`` the range begins with the day before its end. Boilerplate lines are removed
    first, so they are never the message before.
    """
    last = times.as_of_time(end)
    first = times.as_of_time(start) if start is not None else F.date_sub(last, 1).cast("timestamp")
    lines = log.where(
        F.col("date").between(first, last)
        & ~F.startswith("text", F.lit(exclude_prefix))
    )
    return with_previous(lines, partition_by, ["date", "line_no", "text"], {"_before": "text"}).select(
        *partition_by,
        "date",
        "line_no",
        "processinfo",
        F.col("text").alias("messagetext"),
        F.coalesce("_before", F.lit("")).alias("error"),
    )
