import pytest
from pyspark.sql import functions as F

from fleetloom.operators import ingest
from fleetloom.sources import schemas
from fleetloom.sources.fleet import fleet_union, health_check_union
from fleetloom.sources.logs import DatedLog
from tests.conftest import at, day, dec, tuples


def counters(table):
    def row(obj, name, value, inst=None):
        return dict(instance_fullname="n1", object_name=obj, counter_name=name, instance_name=inst, cntr_value=value)

    return table(schemas.OS_PERFORMANCE_COUNTERS, [
        row("x:SQL Statistics   ", "Batch Requests/sec  ", 0),
        row("x:Databases ", "Transactions/sec  ", 5, "db1"),
        row("x:Databases", "Transactions/sec", 0, "db2"),
        row("x:Databases", "Active Transactions", 7, "db1"),
        row("x:Locks", "Lock Waits/sec", 3, "_Total"),
        row("x:Plan Cache", "Hits", 3),
    ])


def test_zero_test_binds_to_database_counters_only(table):
    kept = ingest.select_counters(counters(table))
    assert tuples(kept, "object_name", "counter_name", "cntr_value") == [
        ("x:Databases", "Transactions/sec", 5), ("x:Locks", "Lock Waits/sec", 3), ("x:SQL Statistics", "Batch Requests/sec", 0)]


def test_append_sample_stamps(table):
    got = ingest.append_sample(counters(table), "2024-01-01 23:59:30", "node-9")
    assert set(tuples(got, "instance_fullname", "sample_time", "sample_date")) == {
        ("node-9", at("2024-01-02 00:00:00"), day("2024-01-02"))}


def test_new_rows_null_keys_and_copies(short):
    target = short("k STRING, n INT, v STRING", [("a", 1, "old"), ("a", None, "old")])
    staged = short("k STRING, n INT, v STRING", [("a", 1, "new"), ("a", None, "new"), ("b", None, "z"), ("b", None, "y"), ("c", 3, "c")])
    assert tuples(ingest.new_rows(target, staged, ["k", "n"])) == [("b", None, "y"), ("c", 3, "c")]
    # With plain equality a NULL key is never found in the target.
    assert tuples(ingest.new_rows(target, staged, ["k", "n"], null_safe=False)) == [
        ("a", None, "new"), ("b", None, "y"), ("c", 3, "c")]


def test_insert_new_twice_is_once(short):
    target = short("k INT, v STRING", [(1, "a")])
    staged = short("k INT, v STRING", [(1, "b"), (2, "c"), (2, "d")])
    once = ingest.insert_new(target, staged, ["k"])
    assert tuples(once) == [(1, "a"), (2, "c")]
    assert tuples(ingest.insert_new(once, staged, ["k"])) == tuples(once)


MASTER = "inst STRING, db STRING, level INT, model STRING, is_dropped BOOLEAN, created_on TIMESTAMP, modified_on TIMESTAMP"


def master(short):
    return short(MASTER, [
        ("n1", "a", 100, "FULL", False, at("2023-01-01"), None),
        ("n1", "b", 100, "FULL", True, at("2023-01-01"), at("2023-02-01")),
        ("n2", "c", 100, "FULL", False, at("2023-01-01"), None),
        ("n3", "d", 100, "FULL", False, at("2023-01-01"), None),
    ])


def test_upsert_refreshes_only_named_columns(short):
    staged = short("inst STRING, db STRING, level INT, model STRING", [("n1", "a", 150, "SIMPLE"), ("n1", "new", 150, "FULL")])
    got = ingest.upsert_latest(master(short), staged, ["inst", "db"], ["model"], "2024-01-01")
    assert got.columns == master(short).columns
    rows = {(r.inst, r.db): r for r in got.collect()}
    assert len(rows) == 5
    assert (rows["n1", "a"].level, rows["n1", "a"].model, rows["n1", "a"].modified_on) == (100, "SIMPLE", at("2024-01-01"))
    assert rows["n1", "a"].created_on == at("2023-01-01")
    assert (rows["n1", "new"].level, rows["n1", "new"].created_on, rows["n1", "new"].modified_on) == (150, at("2024-01-01"), None)
    assert (rows["n2", "c"].model, rows["n2", "c"].modified_on) == ("FULL", None)


def test_upsert_takes_a_staged_null(short):
    staged = short("inst STRING, db STRING, level INT, model STRING", [("n1", "a", 1, None)])
    got = ingest.upsert_latest(master(short), staged, ["inst", "db"], ["model"], "2024-01-01")
    assert [r.model for r in got.where("db = 'a'").collect()] == [None]


def test_upsert_twice_is_once(short):
    staged = short("inst STRING, db STRING, level INT, model STRING", [("n1", "a", 150, "SIMPLE"), ("n9", "new", 150, "FULL")])
    once = ingest.upsert_latest(master(short), staged, ["inst", "db"], ["model"], "2024-01-01")
    twice = ingest.upsert_latest(once, staged, ["inst", "db"], ["model"], "2024-01-01")
    assert tuples(twice.drop("modified_on")) == tuples(once.drop("modified_on"))


def test_upsert_rejects_staged_duplicates(short):
    staged = short("inst STRING, db STRING, level INT, model STRING", [("n1", "a", 1, "x"), ("n1", "a", 2, "y")])
    with pytest.raises(Exception, match="not unique"):
        ingest.upsert_latest(master(short), staged, ["inst", "db"], ["model"], "2024-01-01").collect()


def test_mark_dropped(short):
    # n1 has b back and a gone, n2 has nothing left, n3 did not answer.
    staged = short("inst STRING, db STRING", [("n1", "b"), ("n1", "b")])
    got = ingest.mark_dropped(master(short), staged, ["inst", "db"], "2024-01-01", ok_sources=["n1", "n2"])
    assert tuples(got, "db", "is_dropped", "modified_on") == [
        ("a", True, at("2024-01-01")), ("b", False, at("2024-01-01")), ("c", True, at("2024-01-01")), ("d", False, None)]
    strict = ingest.mark_dropped(master(short), staged, ["inst", "db"], "2024-01-01", ["n1", "n2"], strict=True)
    assert tuples(strict, "db", "is_dropped") == [("a", True), ("b", True), ("c", True), ("d", True)]


def test_sync_database_master(table):
    def db(name, **kw):
        return dict(dict(instancefullname="n1", databasename=name, compatibility_level=100, recovery_model="FULL"), **kw)

    master_rows = table(schemas.DATABASE_MASTER, [
        db("a", is_dropped=False, created_on=at("2023-01-01")), db("gone", is_dropped=False), db("back", is_dropped=True),
        db("x", instancefullname="n2", is_dropped=False)])
    staged = table(schemas.DATABASE_MASTER, [
        db("a", compatibility_level=150, recovery_model="SIMPLE"), db("a", compatibility_level=150, recovery_model="SIMPLE"),
        db("back"), db("new")]).drop("is_dropped", "created_on", "modified_on")
    got = ingest.sync_database_master(master_rows, staged, "2024-01-01", ok_sources=["n1"])
    assert got.columns == master_rows.columns
    assert tuples(got, "databasename", "compatibility_level", "recovery_model", "is_dropped", "created_on") == [
        ("a", 100, "SIMPLE", False, at("2023-01-01")), ("back", 100, "FULL", False, None), ("gone", 100, "FULL", True, None),
        ("new", 100, "FULL", False, at("2024-01-01")), ("x", 100, "FULL", False, None)]


def test_merge_load_inserts_updates_and_flags_in_one_pass(short):
    target = short("src STRING, k INT, v STRING, fixed STRING, is_dropped BOOLEAN, created_on TIMESTAMP, modified_on TIMESTAMP", [
        ("a", 1, "old", "f", False, at("2023-01-01"), None), ("a", 2, "old", "f", False, None, None), ("a", 3, "old", "f", True, None, None),
        ("a", None, "old", "f", False, None, None), ("b", 1, "old", "f", False, None, None), (None, 9, "old", "f", None, None, None),
        ("a", 5, "old", "f", True, None, at("2023-05-05"))])
    staged = short("src STRING, k INT, v STRING, fixed STRING, extra INT", [
        ("a", 1, "new", "g", 1), ("a", 1, "late", "g", 2), ("a", 3, "new", "g", 1), ("a", None, "new", "g", 1), ("c", 7, "new", "g", 1)])
    now = at("2024-01-01")
    got = ingest.merge_load(target, staged, ["src", "k"], ["v"], "2024-01-01", ok_sources=["a", "c"], latest_by=["extra"])
    assert got.columns == target.columns
    assert set(map(tuple, got.collect())) == {
        ("a", 1, "new", "f", False, at("2023-01-01"), now), ("a", 2, "old", "f", True, None, now), ("a", 3, "new", "f", False, None, now),
        ("a", None, "new", "f", False, None, now), ("b", 1, "old", "f", False, None, None), (None, 9, "old", "f", None, None, None),
        ("a", 5, "old", "f", True, None, now), ("c", 7, "new", "g", False, now, None)}
    everyone = ingest.merge_load(target, staged, ["src", "k"], ["v"], "2024-01-01", latest_by=["extra"])
    assert tuples(everyone.where("is_dropped"), "src", "k") == [(None, 9), ("a", 2), ("a", 5), ("b", 1)]
    again = ingest.merge_load(got, staged, ["src", "k"], ["v"], "2024-01-02", ok_sources=["a", "c"], latest_by=["extra"])
    assert tuples(again, "src", "k", "v", "is_dropped") == tuples(got, "src", "k", "v", "is_dropped")
    assert ingest.merge_load(target.limit(0), staged.limit(0), ["src", "k"], ["v"], "2024-01-01").count() == 0
    with pytest.raises(Exception, match="not unique"):
        ingest.merge_load(target, staged, ["src", "k"], ["v"], "2024-01-01").collect()


def test_sync_size_log_knows_parts_without_file_group(table):
    def size(fg, used, **kw):
        return dict(dict(instancefullname="n1", databasename="d", databaseid=5, log_date=day("2024-01-01"), usagetype="log",
                         allocationtype="x", filegroupname=fg, used_mb=dec(used), reserved_mb=dec("9")), **kw)

    log = table(schemas.DATABASE_SIZE_LOG_DETAILS, [size(None, "1"), size("P", "2")])
    staged = table(schemas.DATABASE_SIZE_LOG_DETAILS, [size(None, "5"), size("Q", "7"), size("P", "2", log_date=day("2024-01-02"))])
    once = ingest.sync_size_log(log, staged.drop("modified_on"), "2024-01-03")
    assert tuples(once, "filegroupname", "log_date", "used_mb", "modified_on") == [
        (None, day("2024-01-01"), dec("5.000"), at("2024-01-03")), ("P", day("2024-01-01"), dec("2.000"), None),
        ("P", day("2024-01-02"), dec("2.000"), None), ("Q", day("2024-01-01"), dec("7.000"), None)]
    assert ingest.sync_size_log(once, staged.drop("modified_on"), "2024-01-04").count() == 4


def test_retain_bounds(short):
    df = short("id INT, t TIMESTAMP, d DATE", [
        (1, at("2023-12-02 10:00:00"), day("2023-12-02")), (2, at("2023-12-02 10:00:01"), day("2023-12-02")),
        (3, None, None), (4, at("2023-01-01"), day("2023-01-01"))])
    assert tuples(ingest.retain(df, "t", 30, "2024-01-01 10:00:00"), "id") == [(2,), (3,)]
    assert tuples(ingest.retain(df, "t", 30, "2024-01-01 10:00:00", date_col="d"), "id") == [(2,), (3,)]
    counts = [ingest.retain(df, "t", n, "2024-01-01 10:00:00").count() for n in (1, 30, 31, 3650)]
    assert counts == sorted(counts)


def test_dedupe_is_stable(short):
    df = short("k INT, t INT, v STRING", [(1, 2, "b"), (1, 1, "a"), (2, 5, "c"), (2, 5, "b")])
    want = [(1, 1, "a"), (2, 5, "b")]
    for n in (1, 5):
        assert tuples(ingest.dedupe(df.repartition(n), ["k"], ["t", "v"])) == want


def test_derive_instances(short):
    rows = short("instancefullname STRING, is_dropped BOOLEAN", [
        ("h1\\i1", False), ("h1\\i1", False), ("h2", False), ("h3", True), (None, False), ("h4\\x", False)])
    known = short("instance_full_name STRING", [("h4\\x",), (None,)])
    assert tuples(ingest.derive_instances(rows, known)) == [("h1\\i1", "h1", "i1"), ("h2", "h2", "Default")]


def test_integrity_history_scope(short):
    history = short("dbid INT, messagetext STRING, instancefullname STRING", [(5, "old", "n9"), (6, "old", "n9")])
    results = short("dbid INT, messagetext STRING", [(5, "new"), (7, "new"), (None, "new")])
    scope = short("dbid INT", [(5,), (5,)])
    assert tuples(ingest.integrity_history(history, results, "n1", scope)) == [
        (None, "new", None), (5, "new", "n1"), (5, "old", "n9"), (6, "old", "n9"), (7, "new", None)]
    restamped = ingest.integrity_history(history, results, "n1", scope, restamp=True)
    assert (5, "old", "n1") in tuples(restamped, "dbid", "messagetext", "instancefullname")


def test_notification_log(table):
    log = table(schemas.NOTIFICATION_LOG, [
        dict(sessionid=1, appname="a", logdatetime=at("2023-01-01 00:00:00")),
        dict(sessionid=2, appname="a", logdatetime=at("2023-01-01 00:00:01"), staustext="OK"),
        dict(sessionid=3, appname="a")])
    calls = table(schemas.NOTIFICATION_LOG, [dict(appname="b", logdatetime=at("2023-12-31 23:59:58.123456"), staustext="OK")]).drop("sessionid")
    got = ingest.notification_log(log, calls, "2024-01-01 00:00:00")
    assert tuples(got, "sessionid") == [(2,), (2023123123595812345,), (3,)]
    assert tuples(ingest.notification_status(got), "appname", "staustext", "calls") == [
        ("a", None, 1), ("a", "OK", 1), ("b", "OK", 1)]


def test_fleet_union_skips_and_records_failures(spark, short):
    def broken(_):
        # Fails in the middle of its job, not when it is planned.
        return spark.range(10).select((F.lit(1) / (F.col("id") - 5)).alias("v"), F.col("id"))

    def missing(_):
        raise ConnectionError("no route to n3")

    sources = {
        "n1": lambda s: short("id INT, v DOUBLE, extra STRING", [(1, 1.0, "x")]),
        "h2\\i1": broken,
        "n3": missing,
        "n4": lambda s: short("id INT", [(1,)]),
        "n5": lambda s: short("id LONG, v DOUBLE", []),
    }
    result = fleet_union(spark, sources, "id BIGINT, v DOUBLE", "collect")
    assert result.data.columns == ["id", "v", "source"]
    assert tuples(result.data) == [(1, 1.0, "n1")]
    assert result.ok_sources == ["n1", "n5"]
    errors = {r.object_ref: r for r in result.errors.collect()}
    assert set(errors) == {"h2\\i1", "n3", "n4"}
    assert errors["n3"].process_name == "collect" and "no route" in errors["n3"].error_msg
    assert "columns missing: v" in errors["n4"].error_msg


def test_fleet_union_of_nothing(spark):
    result = fleet_union(spark, {}, "id INT")
    assert result.data.count() == 0 and result.errors.count() == 0 and result.ok_sources == []


def test_health_check_union(spark, table):
    row = dict(database_name="d", database_size_mb=dec("10.50"), recovery_model="FULL")

    def unreachable(_):
        raise ConnectionError("unreachable")

    sources = {
        "n1": lambda s: table(schemas.HEALTH_CHECK, [row]).withColumn("extra", F.lit(1)),
        "n2": unreachable,
    }
    result = health_check_union(spark, sources)
    assert tuples(result.data, "instance_name", "database_name", "database_size_mb") == [("n1", "d", dec("10.50"))]
    assert "extra" not in result.data.columns


def test_dated_log(spark, tmp_path, short):
    ddl = "id INT, sample_date DATE"
    log = DatedLog(spark, str(tmp_path / "log"), ddl)
    assert log.rows().count() == 0
    log.write(short(ddl, [(1, day("2024-01-01")), (2, day("2024-01-02")), (3, None)]), 0)
    log.write(short(ddl, [(4, day("2024-01-02"))]), 1)
    log.write(short(ddl, [(5, day("2024-01-02"))]), 1)
    assert tuples(log.rows(), "id") == [(1,), (2,), (3,), (5,)]
    assert tuples(log.rows(first=day("2024-01-02"), before_load=1), "id") == [(2,), (3,)]
    assert log.expire(30, day("2024-02-01")) == ["2024-01-01"]
    assert tuples(log.rows(), "id") == [(2,), (3,), (5,)]
