"""Streaming forms of the collection jobs: utilization, counter rates, insert-if-absent, upsert.

Utilization is a native windowed aggregation. The other three work micro-batch by micro-batch on the
batch operators: their work is shuffled and pre-aggregated like the batch jobs, so one hot series or
one much repeated row does not end up in a single state task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetloom.functions.durable import scratch
from fleetloom.functions.times import nearest_minute
from fleetloom.operators.ingest import dedupe, new_rows, upsert_latest
from fleetloom.operators.series import COUNTER_SERIES, counter_rates
from fleetloom.sources.logs import DatedLog
from fleetloom.sources.tables import BucketedTable
from fleetloom.streaming.batches import BatchTable


def stream_cpu_utilization(samples: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Mean CPU share per host, instance, rounded minute and day, emitted once the minute is closed."""
    # Rounded minutes are windows that start half a minute before the minute.
    minute = F.window("event_time", "1 minute", startTime="30 seconds")
    shares = ("cpu_percent_sql_server", "cpu_percent_others")
    averaged = (
        samples.withWatermark("event_time", delay)
        .withColumn("event_date", F.to_date("event_time"))
        .groupBy(minute, "hostname", "sql_instance_name", "event_date")
        .agg(*[F.sum(c).alias(f"_sum_{c}") for c in shares], *[F.count(c).alias(f"_n_{c}") for c in shares])
    )

    def whole_mean(name: str) -> Column:
        return F.expr(f"_sum_{name} div nullif(_n_{name}, 0)").cast("int")

    return averaged.select(
        F.col("hostname").alias("host_name"),
        (F.col("window.start") + F.make_dt_interval(secs=F.lit(30))).alias("event_datetime"),
        "event_date",
        F.concat("hostname", F.coalesce(F.concat(F.lit("\\"), "sql_instance_name"), F.lit(""))).alias(
            "instance_fullname"
        ),
        whole_mean("cpu_percent_sql_server").alias("cpu_utilization_sqlserver"),
        whole_mean("cpu_percent_others").alias("cpu_utilization_others"),
    )


SHARES = ("cpu_percent_sql_server", "cpu_percent_others")
CPU_SUMS = (
    "hostname STRING, sql_instance_name STRING, event_datetime TIMESTAMP, event_date DATE, newest BIGINT, "
    + ", ".join(f"_sum_{c} BIGINT, _n_{c} BIGINT" for c in SHARES)
)


class CpuUtilization:
    """Mean CPU shares by minute, however the samples are dealt to batches: none is late.

    Every batch appends its sums and counts; ``closed`` adds them up.
    """

    def __init__(self, spark: SparkSession, root: str, delay: timedelta = timedelta(minutes=10)):
        self.delay = delay // timedelta(microseconds=1)
        self.sums = BatchTable(spark, f"{root}/sums", CPU_SUMS)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        minute, day = nearest_minute(F.col("event_time")).alias("event_datetime"), F.to_date("event_time").alias("event_date")
        summed = batch.groupBy("hostname", "sql_instance_name", minute, day).agg(
            F.max(F.unix_micros("event_time")).alias("newest"),
            *[f(c).alias(f"{name}{c}") for c in SHARES for f, name in ((F.sum, "_sum_"), (F.count, "_n_"))],
        )
        self.sums.write(summed, batch_id)

    def closed(self) -> DataFrame:
        """The minutes that ended ``delay`` or more before the newest sample of all."""
        sums = self.sums.appended()
        newest = sums.agg(F.max("newest")).first()[0]
        until = F.lit(None).cast("bigint") if newest is None else F.lit(newest // 1000 * 1000 - self.delay)
        added = (
            sums.where(F.unix_micros("event_datetime") + 30_000_000 <= until)
            .groupBy("hostname", "sql_instance_name", "event_datetime", "event_date")
            .agg(*[F.expr(f"sum(_sum_{c}) div nullif(sum(_n_{c}), 0)").cast("int").alias(c) for c in SHARES])
        )
        return added.select(
            F.col("hostname").alias("host_name"),
            "event_datetime",
            "event_date",
            F.concat("hostname", F.coalesce(F.concat(F.lit("\\"), "sql_instance_name"), F.lit(""))).alias("instance_fullname"),
            F.col(SHARES[0]).alias("cpu_utilization_sqlserver"),
            F.col(SHARES[1]).alias("cpu_utilization_others"),
        )


def start_files(df: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to Parquet files."""
    return _triggered(
        df.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint, available_now
    )


def start_batches(
    df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Hand every micro-batch to ``each``."""
    return _triggered(df.writeStream.foreachBatch(each), checkpoint, available_now)


def _triggered(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


SAMPLE = "instance_fullname STRING, object_name STRING, counter_name STRING, instance_name STRING, sample_time TIMESTAMP, cntr_value BIGINT"
RATE = SAMPLE.replace("cntr_value BIGINT", "counter_value DECIMAL(22,2)")


class CounterRates:
    """Per-second counter rates of a stream.

    Samples wait until the newest sample seen is ``delay`` ahead of them, so they are rated in time
    order however they arrive; a sample that comes after its time has been rated is dropped. What a
    batch leaves to the next: the last rated sample of each series, the waiting samples, the time
    reached. A repeated batch starts from the same state and replaces its own output.

    With ``keep_late`` all samples are kept, and ``settled`` rates the series that had late ones again.
    """

    def __init__(self, spark: SparkSession, root: str, delay: timedelta = timedelta(minutes=10), keep_late: bool = False):
        self.keep_late = keep_late
        self.samples = BatchTable(spark, f"{root}/samples", SAMPLE)
        self.late = BatchTable(spark, f"{root}/late", SAMPLE.partition(", sample_time")[0])
        self.delay = delay // timedelta(microseconds=1)
        self.rates = BatchTable(spark, f"{root}/rates", RATE)
        self.last = BatchTable(spark, f"{root}/last", SAMPLE)
        self.waiting = BatchTable(spark, f"{root}/waiting", SAMPLE)
        # Time of the newest sample seen so far, in microseconds since the epoch.
        self.reached = BatchTable(spark, f"{root}/reached", "newest BIGINT")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        time = F.unix_micros("sample_time")
        samples = batch.select(*COUNTER_SERIES, "sample_time", "cntr_value")
        last, waiting, reached = (t.version(batch_id - 1) for t in (self.last, self.waiting, self.reached))
        before = reached.first()[0] if reached is not None else None
        newest = _later(before, samples.agg(F.max(time)).first()[0])
        ready = F.lit(False) if newest is None else time <= newest - self.delay
        # What was ready before this batch has been rated: samples of that time come too late, and
        # the last ones only give their series its past.
        is_new = F.lit(True) if before is None else time > before - self.delay
        if self.keep_late:
            self.samples.write(samples, batch_id)
            self.late.write(samples.where(~is_new).select(*COUNTER_SERIES).distinct(), batch_id)
        samples = samples.where(is_new)
        if waiting is not None:
            samples = samples.unionByName(waiting)
        samples = samples.persist()
        series = samples.where(ready)
        if last is not None:
            series = series.unionByName(last)
        with scratch():
            self.rates.write(counter_rates(series, object_suffix=None).where(is_new), batch_id)
        newest_of = series.groupBy(*COUNTER_SERIES).agg(F.max(F.struct("sample_time", "cntr_value")).alias("_last"))
        self.last.write(newest_of.select(*COUNTER_SERIES, "_last.*"), batch_id)
        self.waiting.write(samples.where(~ready), batch_id)
        self.reached.write(batch.sparkSession.createDataFrame([(newest,)], "newest BIGINT"), batch_id)
        samples.unpersist()
        for table in (self.last, self.waiting, self.reached):
            table.forget(batch_id - 2)


    def settled(self) -> DataFrame:
        """Rates of all samples up to ``delay`` before the newest, as if they had come in order. Needs ``keep_late``."""
        late, rated = self.late.appended().distinct(), self.rates.appended()
        if late.isEmpty():
            return rated
        # As one value, NULL parts of a series equal each other.
        series = lambda df: df.withColumn("_series", F.struct(*COUNTER_SERIES))
        touched = series(late).select("_series")
        again = series(self.samples.appended()).join(touched, "_series", "left_semi").drop("_series")
        until = self.reached.latest().first()[0] - self.delay
        rerated = counter_rates(again, object_suffix=None).where(F.unix_micros("sample_time") <= until)
        return series(rated).join(touched, "_series", "left_anti").drop("_series").unionByName(rerated)


def _later(a: int | None, b: int | None) -> int | None:
    return max((t for t in (a, b) if t is not None), default=None)


class InsertNew:
    """Insert-if-absent of a stream into a log partitioned by date.

    Copies within a batch are reduced before they are shuffled. Keys are looked up only in the dates
    that the batch has, which is why the date must follow from the key.

    The batch that first has a key decides. With ``any_order`` a later batch's row that comes before the stored one in
    ``order_by`` is written too, and ``rows`` has the first of all.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        keys: Sequence[str],
        order_by: Sequence[str],
        date_col: str,
        any_order: bool = False,
    ):
        self.any_order = any_order
        self.keys, self.order_by, self.date_col = [*keys, date_col], list(order_by), date_col
        self.log = DatedLog(spark, root, schema, date_col)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        first, last = batch.agg(F.min(self.date_col), F.max(self.date_col)).first()
        # A batch without any date has only rows without a date to look for.
        nearby = self.log.rows(first or date.max, last or date.min, before_load=batch_id)
        if not self.any_order:
            self.log.write(new_rows(nearby, batch, self.keys, self.order_by), batch_id)
            return
        both = nearby.withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)))
        self.log.write(dedupe(both, self.keys, [*self.order_by, "_new"]).where("_new").drop("_new"), batch_id)

    def rows(self) -> DataFrame:
        return dedupe(self.log.rows(), self.keys, self.order_by) if self.any_order else self.log.rows()


class Upsert:
    """Latest-state table kept up to date by a stream; a batch rewrites the buckets its keys fall into.

    Of several rows of a key in a batch the first in ``order_by`` counts; a later batch wins over an
    earlier one. ``as_of`` may be a column of the staged rows (``s.<name>``).
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        keys: Sequence[str],
        update_cols: Sequence[str],
        order_by: Sequence[str | Column],
        as_of: Column,
        created_col: str = "created_on",
        modified_col: str = "modified_on",
        buckets: int = 64,
    ):
        self.keys, self.update_cols, self.order_by = list(keys), list(update_cols), list(order_by)
        self.as_of, self.created_col, self.modified_col = as_of, created_col, modified_col
        self.table = BucketedTable(spark, root, schema, keys, buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        staged = dedupe(batch, self.keys, self.order_by)
        touched = self.table.touched(batch)
        target = self.table.current(touched, before_load=batch_id)
        merged = upsert_latest(
            target, staged, self.keys, self.update_cols, self.as_of, self.created_col, self.modified_col
        )
        self.table.write(merged, batch_id)
        self.table.forget(touched, before_load=batch_id)


class UpsertRuns(Upsert):
    """An :class:`Upsert` whose loads are runs, so that it does not matter how a run's rows are dealt to batches.

    Batches append their first row of each key to a table; ``finish``, at the end of a run, loads the keys whose
    first row of all came since the load before. ``staged_schema`` is that of the arriving rows.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, staged_schema: str, **settings):
        super().__init__(spark, f"{root}/table", schema, **settings)
        self.staged = BatchTable(spark, f"{root}/staged", f"{staged_schema}, _batch BIGINT")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.staged.write(dedupe(batch, self.keys, self.order_by).withColumn("_batch", F.lit(batch_id).cast("bigint")), batch_id)

    def finish(self) -> None:
        done = self.staged.batches()
        loaded = self.table.newest_load()
        if not done or done[-1] <= loaded:
            return
        # Of rows equal in the order the one that came first stays.
        first = dedupe(self.staged.appended(), self.keys, [*self.order_by, "_batch"])
        super().__call__(first.where(F.col("_batch") > loaded).drop("_batch"), done[-1])
