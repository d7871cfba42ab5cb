from pyspark.sql import functions as F

from fleetloom.operators import series
from fleetloom.sources import schemas
from tests.conftest import at, day, dec, tuples


def samples(table, rows, obj="x:SQL Statistics"):
    return table(schemas.OS_PERFORMANCE_COUNTERS, [
        dict(instance_fullname=n, sample_time=at(t) if t else None, object_name=obj, counter_name=c, instance_name=i, cntr_value=v)
        for n, t, c, i, v in rows])


def test_counter_rates_traps(table):
    df = samples(table, [
        ("n1", "2024-01-01 10:00", "Batches", None, 100),
        ("n1", "2024-01-01 10:01", "Batches", None, 160),
        ("n1", "2024-01-01 10:02", "Batches", None, 10),      # restart
        ("n1", "2024-01-01 12:00", "Batches", None, 20),      # next bucket with rows, hours later
        ("n1", "2024-01-01 12:00", "Batches", None, 27),      # same minute: no time passed
        ("n1", "2024-01-01 10:00", "Batches", "i2", 5),       # same counter of another part
        ("n1", "2024-01-01 10:03", "Batches", "i2", 6),
        ("n2", "2024-01-01 10:01", "Batches", None, 1000),
    ])
    got = series.counter_rates(df)
    assert tuples(got, "instance_fullname", "instance_name", "sample_time", "counter_value") == sorted([
        ("n1", None, at("2024-01-01 10:00"), dec("0.00")),
        ("n1", None, at("2024-01-01 10:01"), dec("1.00")),
        ("n1", None, at("2024-01-01 10:02"), dec("0.00")),
        ("n1", None, at("2024-01-01 12:00"), dec("0.00")),
        ("n1", None, at("2024-01-01 12:00"), dec("7.00")),
        ("n1", "i2", at("2024-01-01 10:00"), dec("0.00")),
        ("n1", "i2", at("2024-01-01 10:03"), dec("0.01")),
        ("n2", None, at("2024-01-01 10:01"), dec("0.00")),
    ], key=lambda r: [(v is not None, str(v)) for v in r])


def test_counter_rates_never_negative_and_layout_free(spark):
    df = spark.range(3000).select(
        F.lit("n").alias("instance_fullname"), F.lit("o:SQL Statistics").alias("object_name"),
        (F.col("id") % 3).cast("string").alias("counter_name"), F.lit(None).cast("string").alias("instance_name"),
        F.timestamp_seconds(1704067200 + F.col("id") * 37).alias("sample_time"),
        F.abs(F.hash("id") % 1000).cast("bigint").alias("cntr_value"))
    one, many = series.counter_rates(df.coalesce(1)), series.counter_rates(df.repartition(9))
    assert one.where("counter_value < 0").count() == 0
    assert one.count() == 3000 and tuples(one) == tuples(many)


def test_counter_rates_only_of_the_object(table):
    assert series.counter_rates(samples(table, [("n", "2024-01-01", "c", None, 1)], obj="x:Locks")).count() == 0


def test_rate_rounds_half_up(spark):
    df = spark.createDataFrame([(1, 200), (201, 200), (1, 3)], "step BIGINT, secs BIGINT")
    assert [str(r[0]) for r in df.select(series.rate_of(F.col("step"), F.col("secs"))).collect()] == ["0.01", "1.01", "0.33"]


def test_replica_stats(table):
    rows = []
    for t, writes, delay in (("10:00:00", 100, 50), ("10:00:10", 120, 90), ("10:00:20", 120, 40), ("10:00:20", 130, 45)):
        rows += [("n1", f"2024-01-01 {t}", series.REPLICA_WRITES, None, writes),
                 ("n1", f"2024-01-01 {t}", series.REPLICA_DELAY, None, delay)]
    got = {r.sample_time: r for r in series.replica_stats(samples(table, rows, obj="x:Database Replica")).collect()}
    first, second, third = (got[at(f"2024-01-01 10:00:{s}")] for s in ("00", "10", "20"))
    assert (first.tran_count, first.tran_delay, first.avg_tran_delay) == (None, None, None)
    assert (second.tran_count, second.tran_delay, second.avg_tran_delay) == (2.0, 40, 20.0)
    # No change counts as one write; a falling delay as none, but not in the mean. An interval of no
    # length gives no write rate instead of an error.
    assert (third.tran_count, third.tran_delay) == (0.1, 5)
    assert third.avg_tran_delay == -450.0


def test_cpu_utilization(table):
    def row(t, sql, inst="i1"):
        return dict(hostname="h", sql_instance_name=inst, event_time=at(t), cpu_percent_sql_server=sql, cpu_percent_others=1)

    df = table(schemas.CPU_RINGBUFFER, [
        row("2024-01-31 23:59:29.997", 10), row("2024-01-31 23:58:40", 15), row("2024-01-31 23:59:30.000", 50),
        row("2024-02-01 00:00:10", 60), row("2024-02-01 00:00:10", 70, None),
        row("2023-12-18 12:00:00", 1), row("2023-12-18 11:59:59", 1)])
    got = series.cpu_utilization(df, "2024-02-01 12:00:00")
    assert tuples(got, "event_datetime", "event_date", "instance_fullname", "cpu_utilization_sqlserver") == [
        (at("2023-12-18 12:00:00"), day("2023-12-18"), "h\\i1", 1),
        (at("2024-01-31 23:59:00"), day("2024-01-31"), "h\\i1", 12),
        (at("2024-02-01 00:00:00"), day("2024-01-31"), "h\\i1", 50),
        (at("2024-02-01 00:00:00"), day("2024-02-01"), "h", 70),
        (at("2024-02-01 00:00:00"), day("2024-02-01"), "h\\i1", 60),
    ]


def size(d, used, inst="n1", fg="PRIMARY", mod="01:00", db="db"):
    return dict(instancefullname=inst, databasename=db, databaseid=5, log_date=day(d), usagetype="data", allocationtype="in",
                filegroupname=fg, reserved_mb=dec("100"), used_mb=dec(used), modified_on=at(f"{d} {mod}"))


def test_size_growth_dedupes_before_the_change(table):
    df = table(schemas.DATABASE_SIZE_LOG_DETAILS, [
        size("2024-01-01", "10"), size("2024-01-02", "99"), size("2024-01-02", "12", mod="02:00"),
        size("2024-01-04", "9"),                                    # shrunk, after a missing day
        size("2024-02-01", "20"),                                   # next month
        size("2024-01-02", "50", fg=None), size("2024-01-03", "51", fg=None),
        size("2024-01-02", "70", inst="n2"), size("2023-12-02", "5")])
    got = series.size_growth(df, "2024-02-01 00:00:00")
    assert tuples(got.where("instancefullname = 'n1' and filegroupname is not null"),
                  "log_date", "used_mb", "daily_change_mb", "daily_change2_mb") == [
        (day("2024-01-01"), dec("10.000"), None, None),
        (day("2024-01-02"), dec("12.000"), dec("2.000"), dec("2.000")),
        (day("2024-01-04"), dec("9.000"), dec("-3.000"), dec("0.000")),
        (day("2024-02-01"), dec("20.000"), dec("11.000"), dec("11.000"))]
    assert tuples(got.where("filegroupname is null"), "daily_change_mb") == [(None,), (dec("1.000"),)]
    assert tuples(got.where("instancefullname = 'n2'"), "daily_change_mb") == [(None,)]
    telescoped = got.where("instancefullname = 'n1' and filegroupname is not null").agg(F.sum("daily_change_mb")).first()[0]
    assert telescoped == dec("10.000")


def test_size_growth_strict_mixes_series(table):
    df = table(schemas.DATABASE_SIZE_LOG_DETAILS, [
        size("2024-01-01", "10"), size("2024-01-02", "99"), size("2024-01-02", "12", mod="02:00")])
    got = series.size_growth(df, "2024-02-01", strict=True)
    assert tuples(got, "log_date", "used_mb", "daily_change_mb") == [
        (day("2024-01-01"), dec("10.000"), None), (day("2024-01-02"), dec("12.000"), dec("-87.000"))]


def test_size_window_counts_the_time_of_day(table):
    df = table(schemas.DATABASE_SIZE_LOG_DETAILS, [size("2024-01-22", "1"), size("2024-01-23", "1")])
    assert series.size_growth(df, "2024-02-01 12:00:00", days=10).count() == 1
    assert series.size_growth(df, "2024-02-01 00:00:00", days=10).count() == 2


def test_latest_db_size(table):
    df = table(schemas.DATABASE_SIZE_LOG_DETAILS, [
        size("2024-01-30", "10"), size("2024-01-31", "11"), size("2024-01-30", "5", fg="FG2"), size("2024-01-31", "7", fg=None),
        size("2024-01-31", "100", inst="n2"), size("2024-01-01", "1000", fg="OLD")])
    got = series.latest_db_size(df, "2024-02-01")
    assert tuples(got, "instancefullname", "used_mb") == [("n1", dec("23.000")), ("n2", dec("100.000"))]


def test_error_log_context(table):
    def line(n, t, text, inst="n1"):
        return dict(instance_fullname=inst, date=at(t), line_no=n, processinfo="p", text=text)

    df = table(schemas.ERROR_LOG, [
        line(1, "2024-01-01 10:00", "first"), line(3, "2024-01-01 10:05", "third"), line(2, "2024-01-01 10:05", "second"),
        line(4, "2024-01-01 10:06", series.BOILERPLATE_MESSAGE + "77"), line(5, "2024-01-01 10:07", None),
        line(6, "2024-01-01 15:00", "last"), line(7, "2024-01-01 11:00", "other", "n2"), line(8, "2024-01-02 00:00:01", "late")])
    got = series.error_log_context(df, "2024-01-01", "2024-01-02")
    assert tuples(got, "line_no", "messagetext", "error") == [
        (1, "first", ""), (2, "second", "first"), (3, "third", "second"), (6, "last", "third"), (7, "other", "")]
    # The default range is the day before and the day so far.
    assert tuples(series.error_log_context(df, end="2024-01-02 23:00"), "line_no") == [(1,), (2,), (3,), (6,), (7,), (8,)]
    assert tuples(series.error_log_context(df, end="2024-01-03 01:00"), "line_no") == [(8,)]
