import random

from pyspark.sql import functions as F

from fleetloom.operators import reports
from fleetloom.sources import schemas
from tests.conftest import at, day, dec, tuples


def catalog(table):
    def item(i, name, path, kind):
        return dict(itemid=i, name=name, path=path, type=kind, creationdate=at("2024-01-01 23:00"), modifieddate=at("2024-01-02 01:00"))

    return table(schemas.CATALOG, [
        item("r1", "Sales", "/Finance/Sales", 13), item("r2", "Sales", "/WorkSpaceA/Subscriptions and Notifications/x", 2),
        item("r3", "Alpha", "/area/hyperlinks/x", 2), item("r4", "Beta", "/far/off/WorkSpace/Subscriptions and Notifications", 2),
        item("r5", "Folder", "/f", 1), item("r6", "Null", "/n", None), item("r7", "Src", "/s", 5), item("r8", "Set", "/s", 8),
        item("r9", "Emb", "/e", 3), item("r0", "New", "/n", 99)])


def log(table, rows):
    return table(schemas.EXECUTION_LOG, rows)


URI = "<AdditionalInfo><SourceReportUri>/a&amp;b</SourceReportUri><SourceReportUri>/c</SourceReportUri></AdditionalInfo>"


def test_execution_log(table):
    def row(n, **kw):
        return dict(dict(logentryid=n, reportid="r1", username="corp\\ann", requesttype=0, reportaction=1, source=1), **kw)

    df = log(table, [
        row(1), row(2, reportid="gone", requesttype=9, reportaction=99, source=0), row(3, reportaction=11, additionalinfo=URI),
        row(4, reportaction=11, additionalinfo="<AdditionalInfo/>"), row(5, reportaction=11, additionalinfo="<broken"),
        row(6, username="corp\\Admin.x"), row(7, username=None), row(8, reportid=None, reportaction=19, source=7)])
    got = reports.execution_log(df, catalog(table), exclude_user_like="corp\\\\Admin.%")
    assert tuples(got, "logentryid", "itempath", "isitemdeleted", "itemname", "itemtypedesc", "requesttype", "itemaction", "source") == [
        (1, "/Finance/Sales", 0, "Sales", "PowerBI Report", "Interactive", "Render", "Live"),
        (2, "Unknown", 1, "Deleted", "Unknown", "Unknown", "Unknown", "Unknown"),
        (3, "/a&b", 0, "Sales", "PowerBI Report", "Interactive", "ExecuteDataShapeQuery", "Live"),
        (4, "Unknown", 0, "Sales", "PowerBI Report", "Interactive", "ExecuteDataShapeQuery", "Live"),
        (5, "Unknown", 0, "Sales", "PowerBI Report", "Interactive", "ExecuteDataShapeQuery", "Live"),
        (8, "Unknown", 1, "Deleted", "Unknown", "Interactive", "DataRefresh", "Rdce"),
    ]
    assert reports.execution_log(df, catalog(table)).count() == 8


def test_parent_folder(short):
    df = short("p STRING", [("",), ("/top",), ("/Finance/Sales",), ("/a/b/c",), (None,), ("/",), ("//x/y",)])
    assert tuples(df.select("p", reports.parent_folder(F.col("p")))) == [
        (None, None), ("", ""), ("/", ""), ("//x/y", ""), ("/Finance/Sales", "Finance"), ("/a/b/c", "a"), ("/top", "")]


EXECUTIONS = (
    "itemid STRING, username STRING, itempath STRING, itemtype INT, itemname STRING, itemaction STRING, executionid STRING, "
    "timeprocessing INT, timerendering INT, bytecount BIGINT, timestart TIMESTAMP, timeend TIMESTAMP"
)


def executions(short):
    def row(user, action, start, end, run="e"):
        return ("r1", user, "/Finance/Sales", 13, "Sales", action, run, 1500, 250, 10, at(start), at(end))

    return short(EXECUTIONS, [
        row("ann", "Render", "2024-01-01 10:00:00", "2024-01-01 10:00:01"),
        row("ann", "DataRefresh", "2024-01-31 23:59:59.900", "2024-02-01 00:00:00.100", None),
        row("ann", "DataRefresh", "2024-01-02 10:00:00", "2024-01-02 10:00:02"),
        row("bob", "Render", "2024-01-01 10:00:00", "2024-01-01 10:00:01"),
        row(None, "Render", "2024-01-01 10:00:00", "2024-01-01 10:00:01"),
        row("ann", "Render", "2011-01-31 23:00:00", "2011-01-31 23:00:00"),
        row("ann", "Render", "2011-02-01 12:00:00", "2011-02-01 12:00:00")])


def test_execution_stats(short):
    got = reports.execution_stats(executions(short), "2024-02-01 12:00:00", base_url="http://r")
    rows = {(r.username, r.periodmonth): r for r in got.collect()}
    assert set(rows) == {("ann", "202401"), ("bob", "202401"), (None, "202401"), ("ann", "201102")}
    ann = rows["ann", "202401"]
    assert (ann.distinct_users, ann.total_executions, ann.total_bytecount, ann.statsperiod_days) == (1, 2, 30, 31)
    assert (float(ann.total_timeprocessing), float(ann.total_timerendering)) == (4.5, 0.75)
    assert ann.avgmodelrefresh_sec == 1      # (1 + 2) / 2, fraction dropped
    assert (ann.parentfolder, ann.reporturl) == ("Finance", "http://r/Finance/Sales")
    assert rows[None, "202401"].distinct_users == 0 and rows["bob", "202401"].avgmodelrefresh_sec is None


def test_execution_stats_over_users(short):
    got = reports.execution_stats(executions(short), "2024-02-01 12:00:00", by_user=False)
    assert "username" not in got.columns
    assert tuples(got, "periodmonth", "distinct_users", "total_executions") == [("201102", 1, 1), ("202401", 2, 4)]


def test_subscriptions(table):
    subs = table(schemas.SUBSCRIPTIONS, [dict(report_oid="r1", description="weekly", eventtype="Timed"), dict(report_oid="gone")])
    assert tuples(reports.subscriptions(subs, catalog(table)), "reportitemid", "subscriptiontitle", "eventtype") == [
        ("r1", "weekly", "Timed")]


def test_report_catalog(table):
    got = reports.report_catalog(catalog(table))
    assert tuples(got, "slnum", "reportitemid", "reportstage", "reporttype", "createdon", "modifiedon") == [
        (1, "r3", "URL Ref.", "Paginated Report", day("2024-01-01"), day("2024-01-02")),
        (2, "r4", "Subscriptions", "Paginated Report", day("2024-01-01"), day("2024-01-02")),
        (3, "r0", "LIVE", "Unknown", day("2024-01-01"), day("2024-01-02")),
        (4, "r1", "LIVE", "PowerBI Report", day("2024-01-01"), day("2024-01-02")),
        (5, "r2", "WorkSpace", "Paginated Report", day("2024-01-01"), day("2024-01-02"))]
    assert tuples(reports.report_catalog(catalog(table), case_insensitive=False).where("reportitemid = 'r3'"), "reportstage") == [("LIVE",)]


def test_report_sources(table):
    df = log(table, [
        dict(additionalinfo=URI, timeend=at("2024-01-01")), dict(additionalinfo=URI, timeend=at("2024-01-03")),
        dict(additionalinfo="<AdditionalInfo/>"), dict(additionalinfo=None), dict(additionalinfo="oops<")])
    assert tuples(reports.report_sources(df)) == [("/a&b", 2, at("2024-01-03"))]


def classification_inputs(table):
    def prop(major, minor, name, value):
        return dict(instance_fullname="n1", database_id=5, major_id=major, minor_id=minor, name=name, value=value)

    info, label, use = reports.INFORMATION_TYPE, reports.SENSITIVITY_LABEL, reports.USAGE_TYPE
    props = table(schemas.CLASS_PROPERTIES, [
        prop(1, 1, info, "Name"), prop(1, 2, label, "Secret"), prop(1, 3, use, "Mail"), prop(1, 4, label, "Low"), prop(1, 4, use, "Ads"),
        prop(1, 5, info, "Card"), prop(1, 5, label, "High"), prop(9, 1, info, "NoObject"), prop(1, 9, info, "NoColumn"),
        prop(1, 1, "other", "x"), prop(2, 1, info, "Phone")])
    base = dict(instance_fullname="n1", database_id=5)
    objects = table(schemas.OBJECTS, [dict(base, object_id=1, schema_id=1, name="t1"), dict(base, object_id=2, schema_id=7, name="t2")])
    schemata = table(schemas.SCHEMAS, [dict(base, schema_id=1, name="dbo")])
    columns = table(schemas.COLUMNS, [dict(base, object_id=o, column_id=c, name=f"c{c}") for o, c in
                                      ((1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1))])
    return props, objects, schemata, columns


def test_classifications(table):
    got = reports.classifications(*classification_inputs(table))
    cols = ("schema_name", "table_name", "column_name", "information_type", "sensitivity_label", "usage_type")
    assert tuples(got, *cols) == [
        (None, "t2", "c1", "Phone", None, None), ("dbo", "t1", "c1", "Name", None, None), ("dbo", "t1", "c2", None, "Secret", None),
        ("dbo", "t1", "c3", None, None, "Mail"), ("dbo", "t1", "c4", None, "Low", "Ads"), ("dbo", "t1", "c5", "Card", "High", None)]
    strict = reports.classifications(*classification_inputs(table), strict=True)
    assert tuples(strict, "table_name", "column_name") == [("t1", "c1"), ("t1", "c5"), ("t2", "c1")]


def test_names_of_other_case(table):
    rows = [dict(logentryid=n, reportid="r1", username=u) for n, u in [(1, "corp\\ADMIN.x"), (2, "corp\\ann")]]
    got = lambda **kw: tuples(reports.execution_log(log(table, rows), catalog(table), "corp\\\\Admin.%", **kw), "logentryid")
    assert got() == [(2,)] and got(case_insensitive=False) == [(1,), (2,)]
    users = table(schemas.DATABASE_PRINCIPALS, [dict(instance_fullname="N1", principal_id=6, name="u", sid=b"\x01", type="S")])
    logins = table(schemas.LOGINS, [dict(instance_fullname="n1", sid=b"\x01")])
    assert reports.orphaned_users(users, logins).count() == 0
    assert reports.orphaned_users(users, logins, case_insensitive=False).count() == 1


def test_orphaned_users(table):
    def user(name, sid, kind="S", pid=6, inst="n1"):
        return dict(instance_fullname=inst, principal_id=pid, name=name, sid=sid, type=kind)

    users = table(schemas.DATABASE_PRINCIPALS, [
        user("known", b"\x01"), user("orphan", b"\x02", "G"), user("nosid", None, "U"), user("builtin", b"\x03", pid=5),
        user("role", b"\x04", "R"), user("elsewhere", b"\x01", inst="n2")])
    logins = table(schemas.LOGINS, [dict(instance_fullname="n1", sid=b"\x01"), dict(instance_fullname="n1", sid=None)])
    assert tuples(reports.orphaned_users(users, logins), "name") == [("elsewhere",), ("nosid",), ("orphan",)]


def test_database_catalog(table):
    def db(name, inst, app, primary, dropped=False, created="2024-01-01", joined=1):
        return dict(databasename=name, instancefullname=inst, application_name=app, is_ag_primary=primary, is_dropped=dropped,
                    created_on=at(created), is_joined_availabilitygroups=joined, recovery_model="FULL")

    def size(name, inst, used, fg="P", d="2024-01-31"):
        return dict(databasename=name, instancefullname=inst, log_date=day(d), usagetype="data", allocationtype="x", filegroupname=fg,
                    reserved_mb=dec("10"), used_mb=dec(used), modified_on=at(d))

    master = table(schemas.DATABASE_MASTER, [
        db("a", "n1", "App", True), db("a", "n2", None, False), db("b", "n1", None, None, joined=0), db("b", "n2", "Z", None, joined=0),
        db("c", "n1", "App", True, dropped=True), db("d", "n1", None, True)])
    sizes = table(schemas.DATABASE_SIZE_LOG_DETAILS, [
        size("a", "n1", "5"), size("a", "n1", "6", fg="Q"), size("a", "n2", "100"), size("b", "n1", "1"), size("d", "n1", "9", d="2024-01-02")])
    got = reports.database_catalog(master, sizes, "2024-02-01")
    assert tuples(got, "databasename", "instance_fullname", "application_name", "used_mb") == [
        ("a", "n1", "App", dec("11.000")), ("b", "n2", "Z", None), ("d", "n1", None, None)]
    strict = reports.database_catalog(master, sizes, "2024-02-01", strict=True)
    assert tuples(strict.where("databasename = 'b'"), "used_mb") == [(dec("1.000"),)]


def test_results_do_not_depend_on_layout(short):
    df = executions(short)
    random.seed(3)
    assert tuples(reports.execution_stats(df.repartition(6), "2024-02-01 12:00:00")) == tuples(
        reports.execution_stats(df.coalesce(1), "2024-02-01 12:00:00"))
