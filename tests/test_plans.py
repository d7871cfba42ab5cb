"""What the physical plans must and must not have."""

import re

import pytest
from pyspark.sql import functions as F

from fleetloom import plans
from fleetloom.functions import ordered
from fleetloom.functions.durable import durable
from fleetloom.operators import ingest, inventory, reports, series
from fleetloom.plans.inventory import directory_entries
from fleetloom.plans.registry import Tables
from fleetloom.sources import readers, schemas
from tests.conftest import at, day, tuples

SMALL = "/root/testdata/sf0.001"
STREAMS = {n for n in plans.QUERIES if n.startswith("stream_")}
# The one unpartitioned window runs over one row per range partition.
NUMBERED = {
    "report_catalog", "counter_rates", "replica_stats", "error_log_context", "size_growth",
    "active_sessions", "active_sessions_as_of", "session_log",
}
# Broadcasts of a proven bound: the row counts of range partitions.
BOUNDED = {"report_catalog"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    """Plan as for sides too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture()
def unwritten(monkeypatch):
    """Previous-row logic without its written table, so that the plan has the steps before it, too."""
    monkeypatch.setattr(ordered, "durable", lambda df: df)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - STREAMS))
def test_plan(spark, no_broadcast, name):
    plan = plan_of(plans.QUERIES[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in plan
    assert plan.count("SinglePartition") == (name in NUMBERED)
    assert ("BroadcastExchange" in plan) == (name in BOUNDED)


@pytest.mark.parametrize("name", ["insert_new", "upsert_latest", "mark_dropped"])
def test_loads_shuffle_each_side_once(spark, no_broadcast, name):
    assert plan_of(plans.QUERIES[name](spark, SMALL)).count("Exchange hashpartitioning") == 2


def test_directory_sync_shuffles_each_side_once(spark, no_broadcast, tmp_path):
    entries = directory_entries(Tables(spark, SMALL))
    # The users are read from a table, so that nothing but the load itself is in the plan.
    path = str(tmp_path / "users")
    stamps = {c: F.lit(None).cast("timestamp") for c in ("created_on", "modified_on")}
    inventory.directory_users(entries).withColumns(stamps).write.parquet(path)
    plan = plan_of(inventory.sync_directory_users(spark.read.parquet(path), entries, "2024-02-01"))
    assert plan.count("Exchange hashpartitioning") == 2


def written(spark, tmp_path, df, *partitions):
    path = str(tmp_path / "t")
    df.write.partitionBy(*partitions).parquet(path)
    return path


def test_time_filter_reaches_the_scan(spark, tmp_path, table):
    df = table(schemas.CPU_RINGBUFFER, [dict(hostname="h", event_time=at("2024-01-01"), cpu_percent_sql_server=1, cpu_percent_others=2)])
    log = readers.read_snapshot(spark, written(spark, tmp_path, df), schemas.CPU_RINGBUFFER)
    plan = plan_of(series.cpu_utilization(log, "2024-01-02"))
    assert "GreaterThanOrEqual(event_time" in plan


def test_old_days_are_not_read(spark, tmp_path, table, unwritten):
    rows = [dict(instancefullname="n", databasename="d", log_date=day(d), modified_on=at(d)) for d in ("2023-01-01", "2024-01-30", "2024-01-31")]
    path = written(spark, tmp_path, table(schemas.DATABASE_SIZE_LOG_DETAILS, rows), "log_date")
    log = readers.read_snapshot(spark, path, schemas.DATABASE_SIZE_LOG_DETAILS)
    for report in (series.size_growth(log, "2024-02-01"), series.latest_db_size(log, "2024-02-01")):
        assert re.search(r"PartitionFilters: \[[^\]]*log_date", plan_of(report))
        assert len(report.inputFiles()) == 2 or "PartitionFilters" in plan_of(report)
    samples = ingest.retain(log.withColumn("t", F.col("modified_on")), "t", 30, "2024-02-01", date_col="log_date")
    assert re.search(r"PartitionFilters: \[[^\]]*log_date", plan_of(samples))


def test_only_needed_columns_are_read(spark, tmp_path, table, unwritten):
    df = table(schemas.OS_PERFORMANCE_COUNTERS, [dict(object_name="x:SQL Statistics", sample_time=at("2024-01-01"), cntr_value=1)])
    wide = df.withColumn("unused", F.lit("x"))
    path = written(spark, tmp_path, wide)
    log = readers.read_snapshot(spark, path, schemas.OS_PERFORMANCE_COUNTERS + ", unused STRING")
    assert "unused" not in plan_of(series.counter_rates(log))


def test_previous_rows_take_one_scan_of_the_input(spark, no_broadcast, monkeypatch):
    steps = []
    monkeypatch.setattr(ordered, "durable", lambda df: steps.append(plan_of(df)) or durable(df))
    for name in ("counter_rates", "replica_stats", "error_log_context", "size_growth"):
        steps.clear()
        last = plan_of(plans.QUERIES[name](spark, SMALL))
        assert len(steps) == 1 and steps[0].count("Exchange rangepartitioning") == 1
        assert "events.parquet" not in last and "Broadcast" not in steps[0]


def test_backup_day_is_a_range_on_the_column(spark, tmp_path, table):
    df = table(schemas.BACKUPSET, [dict(media_set_id=1, backup_finish_date=at("2024-01-01"))])
    sets = readers.read_snapshot(spark, written(spark, tmp_path, df), schemas.BACKUPSET)
    plan = plan_of(inventory.backup_files(sets, table(schemas.BACKUPMEDIAFAMILY, []), day="2024-01-01"))
    assert "GreaterThanOrEqual(backup_finish_date" in plan and "LessThan(backup_finish_date" in plan


def test_catalog_is_one_shuffle_per_side(spark, no_broadcast, table):
    plan = plan_of(reports.database_catalog(table(schemas.DATABASE_MASTER, []), table(schemas.DATABASE_SIZE_LOG_DETAILS, []), "2024-01-01"))
    assert "Window" not in plan


def test_hot_key_gives_the_same_rows(spark, short):
    """A third of all staged rows are copies of one key, a third belong to one instance."""
    rows = [("hot", 1, i) for i in range(2000)] + [("big", i, 0) for i in range(2000)] + [(f"n{i}", i, 0) for i in range(2000)]
    staged = short("inst STRING, db INT, v INT", rows).repartition(8)
    target = short("inst STRING, db INT, v INT", [("big", i, 9) for i in range(1000)])
    got = ingest.insert_new(target, staged, ["inst", "db"])
    assert got.count() == 1 + 2000 + 2000
    assert tuples(got.where("inst = 'hot'")) == [("hot", 1, 0)]
    assert got.where("inst = 'big' and v = 9").count() == 1000


def test_hot_join_key_is_split(spark, no_broadcast, table):
    """A third of the log is executions of one report; the catalog has it once."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        log = spark.range(0, 60000, numPartitions=8).select(
            F.col("id").alias("logentryid"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 3000)).alias("reportid"),
            *[F.lit(None).cast(t).alias(c) for c, t in _columns(schemas.EXECUTION_LOG) if c not in ("logentryid", "reportid")],
        )
        catalog = spark.range(3000).select(
            F.concat(F.lit("r"), "id").alias("itemid"), F.lit("n").alias("name"), F.lit("/p").alias("path"), F.lit(2).alias("type")
        ).unionByName(spark.createDataFrame([("hot", "hot", "/h", 13)], "itemid STRING, name STRING, path STRING, type INT"))
        got = reports.execution_log(log, catalog).select("logentryid", "itemname")
        rows = got.collect()
        assert len(rows) == 60000 and sum(r.itemname == "hot" for r in rows) == 20000
        assert "skew=true" in plan_of(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _columns(ddl):
    return [tuple(part.split()) for part in ddl.split(", ")]


def test_a_load_of_three_parts_shuffles_each_side_once(spark, tmp_path):
    row = "src STRING, k INT, v STRING, is_dropped BOOLEAN, created_on TIMESTAMP, modified_on TIMESTAMP"
    for name in ("target", "staged"):
        spark.createDataFrame([("a", i, "x", False, None, None) for i in range(50)], row).write.parquet(f"{tmp_path}/{name}")
    target, staged = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("target", "staged"))
    plan = plan_of(ingest.merge_load(target, staged.select("src", "k", "v"), ["src", "k"], ["v"], "2024-01-01", ["a"], latest_by=["v"]))
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FullOuter") == 1
