import pytest

from fleetloom.operators import inventory
from fleetloom.sources import schemas
from tests.conftest import at, day, dec, tuples

BASE = dict(instance_fullname="n1")


def test_database_properties(table):
    dbs = table(schemas.DATABASES, [
        dict(BASE, database_id=i, name=f"d{i}", group_database_id=g, state=0) for i, g in ((4, None), (5, None), (6, "g6"), (7, "g7"))])
    files = table(schemas.MASTER_FILES, [
        dict(BASE, database_id=5, type=t, size=s) for t, s in ((0, 100), (0, 100), (1, 127), (1, 1), (2, 256), (3, 384), (4, 512), (9, 9999))])
    replicas = table(schemas.REPLICA_STATES, [
        dict(BASE, group_database_id="g6", group_id="G", is_local=True, is_primary_replica=True),
        dict(BASE, group_database_id="g6", group_id="G", is_local=False, is_primary_replica=False),
        dict(BASE, group_database_id="g7", group_id="missing", is_local=True, is_primary_replica=False)])
    groups = table(schemas.AVAILABILITY_GROUPS, [dict(BASE, group_id="G", name="AG1")])
    props = table(schemas.EXTENDED_PROPERTIES, [
        dict(BASE, database_id=5, property_name="Application", property_value="ERP"),
        dict(BASE, database_id=6, property_name="Description", property_value="text"), dict(BASE, database_id=6, property_name="x", property_value="y")])
    got = inventory.database_properties(dbs, files, replicas, groups, props)
    assert tuples(got, "databasename", "row_data_mb", "log_data_mb", "filestream_data_mb", "unknown_data_mb", "fulltext_data_mb") == [
        ("d5", 1, 1, 2, 3, 4), ("d6", None, None, None, None, None), ("d7", None, None, None, None, None)]
    assert tuples(got, "databasename", "agname", "is_ag_primary", "is_joined_availabilitygroups", "application_name", "db_description") == [
        ("d5", None, None, 0, "ERP", None), ("d6", "AG1", True, 1, None, "text"), ("d7", None, False, 1, None, None)]


def size_inputs(table):
    d = dict(BASE, database_id=5)
    tables = table(schemas.OBJECTS, [dict(d, object_id=o, schema_id=s, name=f"t{o}") for o, s in ((300, 1), (301, 9), (255, 1))])
    named = table(schemas.INDEXES, [dict(d, object_id=o, index_id=i) for o in (300, 301, 255) for i in (1, 2)])
    parts = table(schemas.PARTITIONS, [
        dict(d, object_id=o, index_id=i, partition_number=1, partition_id=p, rows=r)
        for o, i, p, r in ((300, 1, 1, 10), (300, 2, 2, 9), (301, 1, 3, 0), (255, 1, 4, 5), (300, 1, 5, 10))])
    alloc = table(schemas.ALLOCATION_UNITS, [
        dict(d, container_id=c, total_pages=t, used_pages=u) for c, t, u in ((1, 1000, 500), (1, 28, 12), (2, 128, 64), (3, 131072, 1), (4, 1, 1), (5, 0, 0))])
    schemata = table(schemas.SCHEMAS, [dict(d, schema_id=1, name="dbo")])
    return tables, named, parts, alloc, schemata


def test_table_sizes(table):
    cols = ("schema_name", "table_name", "row_count", "totalsize_mb", "totalsize_gb", "usedsize_mb")
    got = inventory.table_sizes(*size_inputs(table))
    assert tuples(got, *cols) == [("dbo", "t300", 10, dec("8.03"), dec("0.01"), dec("4.00")), ("dbo", "t300", 9, dec("1.00"), dec("0.00"), dec("0.50"))]
    merged = inventory.table_sizes(*size_inputs(table), only_with_rows=False, merge_rows=True)
    assert tuples(merged, *cols) == [
        (None, "t301", 0, dec("1024.00"), dec("1.00"), dec("0.01")), ("dbo", "t300", 10, dec("9.03"), dec("0.01"), dec("4.50"))]


def test_server_properties(table, short):
    config = table(schemas.CONFIGURATIONS, [
        dict(BASE, name=n, value=v) for n, v in (("max degree of parallelism", 8), ("max server memory (MB)", 4096), ("xp_cmdshell", 1))])
    props = short("instance_fullname STRING, edition STRING", [("n1", "Std"), ("n2", "Ent")])
    got = inventory.server_properties(config, props, "2024-01-01")
    assert tuples(got, "instance_fullname", "edition", "maxdop", "costthreshold", "maxmemorymb", "sample_time") == [
        ("n1", "Std", 8, None, 4096, at("2024-01-01")), ("n2", "Ent", None, None, None, at("2024-01-01"))]


def logins(table):
    return table(schemas.LOGINS, [
        dict(BASE, name="admin", sysadmin=True, bulkadmin=True, dbcreator=False), dict(BASE, name="plain", sysadmin=False),
        dict(BASE, name="loader", bulkadmin=True)])


def test_roles(table):
    assert tuples(inventory.role_membership(logins(table)), "name", "role") == [
        ("admin", "bulkadmin"), ("admin", "sysadmin"), ("loader", "bulkadmin")]
    assert tuples(inventory.role_list(logins(table)), "name", "roles") == [("admin", "sysadmin, bulkadmin"), ("loader", "bulkadmin")]


def test_login_sid_mismatch(table):
    df = table(schemas.LOGINS, [
        dict(instance_fullname=n, name=u, sid=s) for n, u, s in (
            ("n1", "a", b"\x0a\xff"), ("n2", "a", b"\x0a\xff"), ("n3", "a", b"\x01"), ("n1", "b", b"\x02"), ("n2", "b", b"\x02"),
            ("n1", "c", None), ("n2", "c", b"\x03"))])
    assert tuples(inventory.login_sid_mismatch(df), "name", "sid", "instance_fullname", "identities") == [
        ("a", "0x01", "n3", 2), ("a", "0x0AFF", "n1", 2), ("a", "0x0AFF", "n2", 2)]


def test_backup_files(table):
    sets = table(schemas.BACKUPSET, [
        dict(BASE, media_set_id=i, database_name=d, backup_finish_date=at(t)) for i, d, t in (
            (1, "a", "2024-01-31 00:00:00"), (2, "b", "2024-01-31 23:59:59.999"), (3, "a", "2024-02-01 00:00:00"), (4, "c", "2024-01-31 12:00"))])
    media = table(schemas.BACKUPMEDIAFAMILY, [
        dict(BASE, media_set_id=i, physical_device_name=p) for i, p in ((1, "\\\\bk\\a\\1.bak"), (1, "\\\\bk\\a\\2.bak"), (2, "noslash.bak"), (3, "x"))])
    got = inventory.backup_files(sets, media, as_of="2024-02-01 05:00:00")
    assert tuples(got, "database_name", "folder", "filename", "backup_date") == [
        ("a", "\\\\bk\\a", "1.bak", day("2024-01-31")), ("a", "\\\\bk\\a", "2.bak", day("2024-01-31")),
        ("b", "noslash.bak", None, day("2024-01-31")), ("c", None, None, day("2024-01-31"))]
    assert inventory.backup_files(sets, media, day="2024-02-01", database="a").count() == 1


def test_config_compliance(table):
    df = table(schemas.CONFIGURATIONS, [
        dict(instance_fullname=n, name=o, value_in_use=v, sample_time=at(t)) for n, o, v, t in (
            ("n1", "clr enabled", 1, "2024-01-01"), ("n1", "clr enabled", 0, "2024-01-02"), ("n1", "XP_CMDSHELL", 1, "2024-01-02"),
            ("n2", "unrelated", 1, "2024-01-01"))])
    got = inventory.config_compliance(df)
    status = {(r.instance_fullname, r.name): r.status for r in got.collect()}
    assert len(status) == 2 * len(inventory.CONFIG_BASELINE)
    assert status["n1", "clr enabled"] == "PASS" and status["n1", "xp_cmdshell"] == "FAIL" and status["n2", "clr enabled"] == "MISSING"
    assert tuples(inventory.config_score(got), "instance_fullname", "options", "passed") == [("n1", 12, 1), ("n2", 12, 0)]


def test_latest_full_backup(table):
    df = table(schemas.FILE_LISTING, [
        dict(folder=f, filename=n, depth=1, isfile=i) for f, n, i in (
            ("d1", "db_20240101_Full_15.BAK", 1), ("d1", "db_20240102_full_15.bak", 1), ("d1", "db_20240103Full15.BAK", 1),
            ("d1", "db_20240104_Full_dir.BAK", 0), ("d1", "db_20240105_Full_15.trn", 1), ("d2", "x_Full_1.BAK", 1))])
    assert tuples(inventory.latest_full_backup(df), "folder", "filename") == [
        ("d1", "db_20240102_full_15.bak"), ("d2", "x_Full_1.BAK")]
    assert tuples(inventory.latest_full_backup(df, case_insensitive=False), "filename") == [("db_20240101_Full_15.BAK",), ("x_Full_1.BAK",)]
    assert inventory.latest_full_backup(df, k=2).count() == 3


def entry(account="ann", **kw):
    return dict(dict(cn="Ann", employeeid="7", samaccountname=account, manager="CN=Bob Ray,OU=IT,DC=x", whencreated="2023-01-02 03:04:05",
                     whenchanged="2023-02-02", useraccountcontrol="512"), **kw)


def test_directory_users(table):
    df = table(schemas.DIRECTORY_USERS, [
        entry(), entry(), entry("bo", manager=None, useraccountcontrol="66050"), entry("cy", manager="CN=No Unit", whencreated="soon"),
        entry("di", manager="CN=Eve,CN=Users,OU=X", useraccountcontrol="66048"), entry("ed", manager="OU=X", useraccountcontrol="514"),
        entry("fi", useraccountcontrol="1")])
    got = inventory.directory_users(df)
    assert tuples(got, "user_account", "manager_name", "ldap_created_on", "user_status") == [
        ("ann", "Bob Ray", at("2023-01-02 03:04:05"), "Active"), ("bo", None, at("2023-01-02 03:04:05"), "Inactive"),
        ("cy", None, None, "Active"), ("di", "Eve,Users", at("2023-01-02 03:04:05"), "Active"),
        ("ed", None, at("2023-01-02 03:04:05"), "Inactive"), ("fi", "Bob Ray", at("2023-01-02 03:04:05"), "Unknown")]


def test_directory_sync(table, short):
    ddl = ("username STRING, employee_id STRING, title STRING, user_account STRING, manager_name STRING, user_department STRING, "
           "email STRING, mobile_number STRING, ldap_created_on TIMESTAMP, ldap_modified_on TIMESTAMP, user_status STRING, "
           "sma_account_type STRING, created_on TIMESTAMP, modified_on TIMESTAMP")
    users = table(ddl, [dict(user_account="ann", username="Old", created_on=at("2020-01-01")), dict(user_account="gone", username="G")])
    staged = table(schemas.DIRECTORY_USERS, [entry(cn="Newer", whenchanged="2023-03-03"), entry(cn="Older"), entry("new")])
    got = inventory.sync_directory_users(users, staged, "2024-01-01")
    assert tuples(got, "user_account", "username", "created_on", "modified_on") == [
        ("ann", "Newer", at("2020-01-01"), at("2024-01-01")), ("gone", "G", None, None), ("new", "Ann", at("2024-01-01"), None)]


def test_password_expiry(table):
    df = table(schemas.LOGINS, [
        dict(BASE, name="a", password_last_set=at("2024-01-31 23:00"), days_until_expiration=30, is_expiration_checked=True),
        dict(BASE, name="b", password_last_set=at("2024-01-31"), is_expiration_checked=False), dict(BASE, name="##sys"),
        dict(BASE, name="c", days_until_expiration=5)])
    assert tuples(inventory.password_expiry(df), "loginname", "daysuntilexpiration", "passwordexpirationdate", "expiration_date",
                  "passwordexpirechecked") == [
        ("a", "30", "03/01/2024", day("2024-03-01"), "TRUE"), ("b", "Never Expire", "Never Expire", None, "FALSE"),
        ("c", "5", "Never Expire", None, "FALSE")]


def test_backup_archive_plan(short):
    df = short("database_name STRING, filename STRING, backup_finish_date TIMESTAMP", [
        ("db", n, at(t)) for n, t in (
            ("a_Full_.bak", "2024-01-31 22:00"), ("a_Dif_.bak", "2024-01-31 22:00"), ("b_FULL_COPY_.bak", "2024-01-28 22:00"),
            ("c_Full_.bak", "2024-01-27 22:00"), ("d_Full_.bak", "2024-02-01 22:00"), ("e_Full_.bak", "2024-01-21 22:00"))])
    plan = inventory.backup_archive_plan(df, "2024-02-29 03:00", "\\\\bk\\x\\", retention_days=29)
    assert tuples(plan, "filename", "destination", "keep_monthly", "monthly_folder", "purge") == [
        ("a_Dif_.bak", "\\\\bk\\x\\db\\20240131", False, None, True),
        ("a_Full_.bak", "\\\\bk\\x\\db\\20240131", True, "\\\\bk\\x\\db\\2024-Jan", False),
        ("b_FULL_COPY_.bak", "\\\\bk\\x\\db\\20240128", True, "\\\\bk\\x\\db\\2024-Jan", False),
        ("c_Full_.bak", "\\\\bk\\x\\db\\20240127", False, None, True),
        ("d_Full_.bak", "\\\\bk\\x\\db\\20240201", False, None, False),
        ("e_Full_.bak", "\\\\bk\\x\\db\\20240121", False, None, True)]
    exact = inventory.backup_archive_plan(df, "2024-02-29 03:00", "\\\\bk\\x", retention_days=29, purge="exact_day")
    assert tuples(exact.where("purge"), "filename") == [("a_Dif_.bak",)]


@pytest.mark.parametrize("days, purged", [(31, False), (32, True), (33, True)])
def test_purge_age(short, days, purged):
    df = short("database_name STRING, filename STRING, backup_finish_date TIMESTAMP", [("db", "x_Dif_.bak", at("2024-03-01 12:00"))])
    as_of = f"2024-04-{days - 30:02d} 01:00"
    assert inventory.backup_archive_plan(df, as_of, "d").first()["purge"] is purged


def test_backup_eligibility(table, short):
    dbs = table(schemas.DATABASES, [
        dict(instance_fullname=n, database_id=i, name=d, recovery_model_desc=m, group_database_id=g, state=s) for n, i, d, m, g, s in (
            ("h1\\i1", 5, "alone", "FULL", None, 0), ("h1\\i1", 6, "simple", "SIMPLE", None, 0), ("h1\\i1", 7, "second", "FULL", "g7", 0),
            ("h2", 7, "second", "FULL", "g7", 0), ("h1\\i1", 4, "system", "FULL", None, 0), ("h1\\i1", 8, "offline", "FULL", None, 6),
            ("h1\\i1", 9, "unknown", None, "g9", 0))])
    replicas = short(
        "instance_fullname STRING, group_database_id STRING, is_local BOOLEAN, is_primary_replica BOOLEAN, is_preferred_backup BOOLEAN", [
            ("h1\\i1", "g7", True, False, True), ("h1\\i1", "g7", False, True, False), ("h2", "g7", True, True, False)])
    got = inventory.backup_eligibility(dbs, replicas, ["FULL", "FULL_COPY", "DIF", "LOG"], "2024-01-02 03:04:05", "D:\\bk\\", "15.0")
    decisions = {(r.instance_fullname, r.name, r.backup_type): (r.decision, r.reason) for r in got.collect()}
    assert len(decisions) == 20
    run = ("RUN", None)
    assert all(decisions["h1\\i1", "alone", t] == run for t in ("FULL", "FULL_COPY", "DIF", "LOG"))
    assert decisions["h1\\i1", "simple", "LOG"] == ("SKIP", "recovery model is not full")
    assert decisions["h1\\i1", "second", "FULL"] == ("SKIP", "not the primary replica") and decisions["h1\\i1", "second", "LOG"] == run
    assert decisions["h2", "second", "DIF"] == run and decisions["h2", "second", "FULL_COPY"] == ("SKIP", "not the preferred replica")
    assert decisions["h1\\i1", "unknown", "LOG"][1] == "recovery model is not full"
    files = {(r.name, r.backup_type, r.instance_fullname): r.backup_file for r in got.collect()}
    assert files["alone", "LOG", "h1\\i1"] == "D:\\bk\\alone\\alone_202401020304_h1_i1_Log_15.0.TRN"
    assert files["second", "FULL", "h2"] == "D:\\bk\\second\\second_202401020304_h2_MSSQLSERVER_Full_15.0.BAK"
    with pytest.raises(ValueError, match="unknown backup types"):
        inventory.backup_eligibility(dbs, replicas, ["HALF"], "2024-01-01", "d", "1")
