from fleetloom.operators import views
from fleetloom.sources import schemas
from tests.conftest import at, dec, tuples


def test_primary_only(table):
    dbs = table(schemas.DATABASES, [
        dict(instance_fullname=n, database_id=i, name=f"d{i}", group_database_id=g)
        for n, i, g in (("n1", 1, None), ("n1", 2, "g2"), ("n1", 3, "g3"), ("n2", 2, "g2"), ("n1", 4, "g4"))])
    states = table(schemas.REPLICA_STATES, [
        dict(instance_fullname=n, group_database_id=g, is_local=loc, is_primary_replica=p)
        for n, g, loc, p in (("n1", "g2", True, True), ("n1", "g2", True, True), ("n1", "g3", True, False),
                             ("n1", "g3", False, True), ("n2", "g2", True, False))])
    got = views.primary_only(dbs, states)
    assert got.columns == dbs.columns
    assert tuples(got, "instance_fullname", "database_id") == [("n1", 1), ("n1", 2)]


def test_live_primary_null_flags(short):
    df = short("id INT, is_dropped BOOLEAN, is_ag_primary BOOLEAN, is_joined_availabilitygroups INT", [
        (1, False, True, 1), (2, False, None, 0), (3, False, False, 1), (4, True, True, 1), (5, None, True, 0), (6, False, None, 1)])
    assert tuples(views.live_primary(df), "id") == [(1,), (2,)]


def test_resolve_scope(short):
    df = short("name STRING, n INT", [("a", 1), ("b", 2), ("c", 3), (None, 4)])
    names = lambda **kw: [r[0] for r in tuples(views.resolve_scope(df, "name", **kw), "name")]
    assert names() == [None, "a", "b", "c"]
    assert names(include=" a , b") == ["a", "b"]
    assert names(include="a,b", exclude="a") == ["a", "b"]
    assert names(include="a,b", exclude="a", always_exclude=True) == ["b"]
    assert names(exclude="a;c", sep=";") == [None, "b"]
    assert names(include=["c"]) == ["c"]
    listed = short("x STRING", [(" a ",), ("a",), (None,)])
    assert names(include=listed) == ["a"]
    assert names(exclude=listed) == [None, "b", "c"]


def test_resolve_scope_without_case(short):
    df = short("name STRING, n INT", [("Alpha", 1), ("ALPHA", 2), ("beta", 3), (None, 4)])
    rows = lambda **kw: [r[1] for r in tuples(views.resolve_scope(df, "name", **kw).select("n", "n"))]
    listed = short("x STRING", [(" alphA ",), ("alpha",), (None,)])
    assert rows(include="alpha") == [] and rows(include=listed) == []
    for include in ("alpha, gamma", listed):
        assert rows(include=include, case_insensitive=True) == [1, 2]
    for exclude in ("alpha, gamma", listed):
        assert rows(exclude=exclude, case_insensitive=True) == [3, 4]
    # Names keep their type and case.
    kept = views.resolve_scope(df, "name", include=listed, case_insensitive=True)
    assert kept.schema == df.schema and tuples(kept, "name") == [("ALPHA",), ("Alpha",)]


def test_missing_indexes(table):
    def row(**kw):
        return dict(dict(hostname="h", sql_instance="i", databaseid=100, impact_reduced=50.1, user_requests=501), **kw)

    df = table(schemas.MISSING_INDEXES, [
        row(), row(impact_reduced=50.0), row(user_requests=500), row(optimized_on=at("2024-01-01")), row(sql_instance=None)])
    assert tuples(views.missing_indexes(df), "server_fullname", "database_key") == [(None, None), ("h\\i", "h-i-100")]


def test_size_log(table):
    def row(inst, primary, t="2024-01-15"):
        return dict(instancefullname=inst, ag_isprimary=primary, db_logdate=at(t), filesize_gb=dec("1.00"))

    df = table(schemas.DATABASE_SIZE_LOG, [
        row("h1\\production-instance-x", 1), row("a-very-long-host-name", 2), row("h2\\i", 0), row("h2\\i", 1, "2023-01-01")])
    wanted = ("host_name", "instancename", "monthnum", "yearnum")
    assert tuples(views.size_log(df, "2024-02-01"), *wanted) == [
        ("a-very-long-host-name", "a-very-long-host-name", 1, 2024), ("h1", "production-instance-x", 1, 2024)]
    assert tuples(views.size_log(df, "2024-02-01", name_length=15), *wanted) == [
        ("a-very-long-host-name", "a-very-long-hos", 1, 2024), ("h1", "production-inst", 1, 2024)]


def test_server_lists(table):
    df = table(schemas.DB_INSTANCES, [
        dict(instance_host="h1", instance_full_name="h1\\a", is_deleted=False),
        dict(instance_host="h1", instance_full_name="h1\\b", is_deleted=True),
        dict(instance_host="h1", instance_full_name="h1\\a", is_deleted=False),
        dict(instance_host="h2", is_deleted=None)])
    assert tuples(views.server_hosts(df)) == [("h1",), ("h2",)]
    assert tuples(views.sql_servers(df), "hostname", "instance_fullname") == [("h1", "h1\\a")]


def test_storage(table):
    df = table(schemas.SERVER_STORAGE, [
        dict(hostname="h", drive="C", available_mb=25, total_size_mb=100), dict(hostname="h", drive="D", available_mb=0, total_size_mb=0)])
    assert tuples(views.storage(df), "drive", "used_pct") == [("C", 75.0), ("D", None)]


def process(**kw):
    return dict(dict(instance_fullname="n1", sample_time=at("2024-01-01 10:00"), spid=51, blocked=0, status="running   ",
                     memory_usage=3, sql_handle=b"\x01", hostname="h  ", cmd="SELECT  "), **kw)


def test_active_sessions(table):
    protocols = [0x70, 0x71, 0x72, 0x73, 0x74, 0x75]
    procs = table(schemas.PROCESSES, [process(spid=51 + i) for i in range(6)] + [
        process(spid=80), process(spid=51, sql_handle=b"\x09"), process(instance_fullname="n2", spid=51)])
    conns = table(schemas.CONNECTIONS, [
        dict(instance_fullname="n1", session_id=51 + i, protocol_version=p << 24 | 4) for i, p in enumerate(protocols)])
    texts = table(schemas.SQL_TEXT, [dict(instance_fullname="n1", sql_handle=b"\x01", text="select 1")])
    got = views.active_sessions(procs, conns, texts)
    assert tuples(got, "spid", "client_protocol_version", "sql_text") == [
        (51, "SQL Server 7.0", "select 1"), (52, "SQL Server 2000", "select 1"), (53, "SQL Server 2005", "select 1"),
        (54, "SQL Server 2008", "select 1"), (55, "SQL Server 2012+", "select 1"), (56, "Unknown driver", "select 1")]


def test_session_log(table):
    levels = [0, 1, 2, 3, 4, 5, 6, None]
    procs = table(schemas.PROCESSES, [process(spid=60 + i) for i in range(8)] + [process(spid=60, status="background  ")])
    sess = table(schemas.SESSIONS, [
        dict(instance_fullname="n1", session_id=60 + i, transaction_isolation_level=v) for i, v in enumerate(levels)])
    texts = table(schemas.SQL_TEXT, [dict(instance_fullname="n1", sql_handle=b"\x01", text="t")])
    got = views.session_log(procs, sess, texts, "job", as_of="2024-02-02")
    assert tuples(got, "spid", "isolation_level") == [
        (60, "Unspecified"), (61, "ReadUncommitted"), (62, "ReadCommitted"), (63, "RepeatableRead"), (64, "Serializable"),
        (65, "Snapshot"), (66, None), (67, None)]
    row = got.first()
    assert (row.memory_usage_mb, row.hostname, row.cmd, row.collected_by, row.sample_time, row.status) == (
        dec("0.02"), "h", "SELECT", "job", at("2024-02-02"), "running")


def test_a_reused_process_id_meets_the_settings_of_its_time(table):
    procs = table(schemas.PROCESSES, [
        process(spid=60, sample_time=at(f"2024-01-01 10:{m:02}"), cpu=m) for m in (0, 5, 10, 10, 30)] + [
        process(spid=61, sample_time=at("2024-01-01 10:00"), cpu=99), process(spid=60, sample_time=None, cpu=77),
        process(spid=62, sample_time=at("2024-01-01 10:00"), cpu=55)])
    sess = table(schemas.SESSIONS, [
        dict(instance_fullname="n1", session_id=60, sample_time=at(f"2024-01-01 10:{m:02}"), client_interface_name=name)
        for m, name in ((5, "first"), (10, "a"), (10, "b"), (20, "third"))] + [
        dict(instance_fullname="n2", session_id=60, sample_time=at("2024-01-01 09:00"), client_interface_name="other server"),
        dict(instance_fullname="n1", session_id=62, client_interface_name="always")])
    texts = table(schemas.SQL_TEXT, [dict(instance_fullname="n1", sql_handle=b"\x01", text="t")] * 3)
    got = views.session_log(procs, sess, texts, "job")
    assert tuples(got, "cpu", "client_interface_name") == [(10, "b"), (10, "b"), (30, "third"), (5, "first"), (55, "always")]
    assert views.session_log(procs.limit(0), sess, texts, "job").count() == 0
    assert views.session_log(procs, sess.limit(0), texts, "job").count() == 0
