"""View operators over orders, customers, parts, nations and suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import decode
from fleetloom.operators import views
from fleetloom.plans.registry import Tables, query


def binary_key(col: str | Column) -> Column:
    """A key as bytes, the type identities and statement handles have."""
    return F.encode((F.col(col) if isinstance(col, str) else col).cast("string"), "UTF-8")


def case_sql(code: str, table: dict, default: str | None = "Unknown") -> str:
    """SQL text of a code table."""
    arms = " ".join(f"WHEN {code} = {key} THEN '{label}'" for key, label in table.items())
    return f"CASE {arms} ELSE {'NULL' if default is None else repr(default)} END"


@query(
    "primary_only",
    """
    SELECT o_orderkey AS database_id, o_orderstatus AS name,
           CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey AS VARCHAR) END AS group_database_id
    FROM orders
    WHERE o_orderstatus = 'O' OR EXISTS (
        SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R' AND l_linestatus = 'O')
    """,
)
def primary_only(tables: Tables) -> DataFrame:
    """Orders in status O are in no group; the others need a local primary line item."""
    databases = tables.orders.select(
        F.lit("node-1").alias("instance_fullname"),
        F.col("o_orderkey").alias("database_id"),
        F.col("o_orderstatus").alias("name"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey").cast("string")).alias("group_database_id"),
    )
    replicas = tables.lineitem.select(
        F.lit("node-1").alias("instance_fullname"),
        F.col("l_orderkey").cast("string").alias("group_database_id"),
        (F.col("l_returnflag") != "R").alias("is_local"),
        (F.col("l_linestatus") == "O").alias("is_primary_replica"),
    )
    return views.primary_only(databases, replicas).drop("instance_fullname")


@query(
    "live_primary",
    """
    SELECT o_orderkey AS database_id, o_orderstatus = 'P' AS is_dropped, o_totalprice > 250000 AS is_ag_primary,
           CASE o_orderpriority WHEN '5-LOW' THEN 0 ELSE 1 END AS is_joined_availabilitygroups
    FROM orders WHERE o_orderstatus <> 'P' AND (o_totalprice > 250000 OR o_orderpriority = '5-LOW')
    """,
)
def live_primary(tables: Tables) -> DataFrame:
    """Orders not dropped that are primary (large) or in no group (low priority)."""
    return views.live_primary(
        tables.orders.select(
            F.col("o_orderkey").alias("database_id"),
            (F.col("o_orderstatus") == "P").alias("is_dropped"),
            (F.col("o_totalprice") > 250000).alias("is_ag_primary"),
            F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(1).alias("is_joined_availabilitygroups"),
        )
    )


@query(
    "resolve_scope",
    """
    SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_name IN ('NATION_1', 'NATION_3', 'NATION_7')
    """,
)
def resolve_scope(tables: Tables) -> DataFrame:
    """Customers of the listed nations; the include list wins over the exclude list."""
    customers = tables.customer.join(tables.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return views.resolve_scope(customers, "n_name", " NATION_1, NATION_3 ,NATION_7,", "NATION_3")


@query(
    "resolve_scope_exclude",
    """
    SELECT p_partkey, p_name, p_brand FROM part
    WHERE p_type IN ('SMALL', 'LARGE') AND p_name NOT IN (SELECT p_name FROM part WHERE p_size = 50 AND p_brand = 'Brand#7')
    """,
)
def resolve_scope_exclude(tables: Tables) -> DataFrame:
    """Parts of two types without the names that a table excludes."""
    part = tables.part
    excluded = part.where((F.col("p_size") == 50) & (F.col("p_brand") == "Brand#7")).select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"))
    listed = views.resolve_scope(part, "p_type", "SMALL; LARGE", sep=";")
    return views.resolve_scope(listed, "p_name", exclude=excluded).select("p_partkey", "p_name", "p_brand")


@query(
    "resolve_scope_collated",
    """
    SELECT p_partkey, p_name, p_type FROM part
    WHERE lower(p_type) IN ('small', 'large')
      AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 50 AND p_brand = 'Brand#7')
    """,
)
def resolve_scope_collated(tables: Tables) -> DataFrame:
    """Parts by lists whose names are written in other cases."""
    part = tables.part
    excluded = part.where((F.col("p_size") == 50) & (F.col("p_brand") == "Brand#7")).select(F.upper("p_name").alias("name"))
    listed = views.resolve_scope(part, "p_type", "small, LargE", case_insensitive=True)
    return views.resolve_scope(listed, "p_name", exclude=excluded, case_insensitive=True).select("p_partkey", "p_name", "p_type")


@query(
    "missing_indexes",
    """
    SELECT p_name AS hostname, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS sql_instance,
           CASE WHEN p_brand <> 'Brand#1' THEN p_name || '\\' || p_brand END AS server_fullname,
           p_type AS database_name, p_size::DOUBLE AS impact_reduced,
           CAST(floor(p_retailprice) AS BIGINT) AS user_requests,
           CASE WHEN p_brand <> 'Brand#1' THEN p_name || '-' || p_brand || '-' || p_partkey END AS database_key
    FROM part WHERE p_size > 25 AND floor(p_retailprice) > 905 AND p_type <> 'ECONOMY'
    """,
)
def missing_indexes(tables: Tables) -> DataFrame:
    """Parts as index suggestions: size as impact, price as requests."""
    suggestions = tables.part.select(
        F.col("p_name").alias("hostname"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("sql_instance"),
        F.col("p_type").alias("database_name"),
        F.col("p_partkey").alias("databaseid"),
        *[F.lit(None).cast("string").alias(c) for c in ("idx_table", "idx_columns", "idx_columns_include")],
        F.lit(None).cast("int").alias("index_handle"),
        F.floor("p_retailprice").alias("user_requests"),
        F.col("p_size").cast("double").alias("impact_reduced"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("2024-01-01").cast("timestamp")).alias("optimized_on"),
    )
    return views.missing_indexes(suggestions, min_impact=25, min_requests=905).drop(
        "idx_table", "idx_columns", "idx_columns_include", "index_handle"
    )


@query(
    "size_log",
    """
    WITH s AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'warehouse-server-one'
                              ELSE replace(o_orderpriority, '-', '\\') END AS full_name FROM orders)
    SELECT full_name AS sqlinstancefullname, split_part(full_name, '\\', 1) AS host_name,
           substr(full_name, strpos(full_name, '\\') + 1) AS instancename,
           CAST(month(o_orderdate) AS INTEGER) AS monthnum, CAST(year(o_orderdate) AS INTEGER) AS yearnum,
           o_orderdate AS db_logdate, 'db' || o_custkey AS databasename, 1 AS ag_isjoined,
           CASE o_orderstatus WHEN 'O' THEN 1 ELSE 2 END AS ag_isprimary, o_orderstatus AS db_filetype,
           floor(o_totalprice / 1024) AS db_filesizegb, o_totalprice AS db_filesizemb
    FROM s WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '1999-01-01'
    """,
)
def size_log(tables: Tables) -> DataFrame:
    """Orders as file sizes by date, priority as host and instance."""
    status = F.col("o_orderstatus")
    log = tables.orders.select(
        F.when(status == "P", "warehouse-server-one")
        .otherwise(F.replace("o_orderpriority", F.lit("-"), F.lit("\\")))
        .alias("instancefullname"),
        F.concat(F.lit("db"), "o_custkey").alias("databasename"),
        F.col("o_orderdate").alias("db_logdate"),
        F.lit(1).alias("ag_isjoined"),
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("ag_isprimary"),
        status.alias("db_filetype"),
        F.floor(F.col("o_totalprice") / 1024).cast("double").alias("filesize_gb"),
        F.col("o_totalprice").alias("filesize_mb"),
    )
    return views.size_log(log, as_of="2001-08-01", days=943)


@query("server_hosts", "SELECT DISTINCT p_brand AS hostname FROM part")
def server_hosts(tables: Tables) -> DataFrame:
    """Distinct brands."""
    return views.server_hosts(tables.part.select(F.col("p_brand").alias("instance_host")))


@query(
    "sql_servers",
    """
    SELECT DISTINCT 'h' || o_custkey AS hostname, 'h' || o_custkey || '\\' || o_orderpriority AS instance_fullname,
           o_orderpriority AS instance_name, o_orderstatus AS environ, 'dc1' AS dc
    FROM orders WHERE o_orderstatus <> 'P'
    """,
)
def sql_servers(tables: Tables) -> DataFrame:
    """Distinct customer, priority and status of orders not pending."""
    host = F.concat(F.lit("h"), "o_custkey")
    return views.sql_servers(
        tables.orders.select(
            host.alias("instance_host"),
            F.concat(host, F.lit("\\"), "o_orderpriority").alias("instance_full_name"),
            F.col("o_orderpriority").alias("instance_name"),
            F.col("o_orderstatus").alias("environment"),
            F.lit("dc1").alias("dc"),
            (F.col("o_orderstatus") == "P").alias("is_deleted"),
        )
    )


@query(
    "storage",
    """
    SELECT s_name AS hostname, 'C' AS drive, 'data' AS logical_name, CAST(floor(s_acctbal) AS BIGINT) AS available_mb,
           CAST(s_nationkey * 1000 AS BIGINT) AS total_size_mb,
           round((s_nationkey * 1000 - floor(s_acctbal)) * 100.0::DOUBLE / nullif(s_nationkey * 1000, 0), 4) AS used_pct
    FROM supplier
    """,
)
def storage(tables: Tables) -> DataFrame:
    """Suppliers as volumes: balance available of a nation-dependent total, which may be 0."""
    volumes = tables.supplier.select(
        F.col("s_name").alias("hostname"),
        F.lit("C").alias("drive"),
        F.lit("data").alias("logical_name"),
        F.floor("s_acctbal").alias("available_mb"),
        (F.col("s_nationkey") * 1000).cast("bigint").alias("total_size_mb"),
    )
    return views.storage(volumes).withColumn("used_pct", F.round("used_pct", 4))


@query(
    "active_sessions",
    f"""
    SELECT o_orderkey AS kpid, o_custkey AS spid, o_orderstatus AS status, c_mktsegment AS encrypt_option,
           {case_sql("112 + c_nationkey // 4", decode.CLIENT_PROTOCOL, "Unknown driver")} AS client_protocol_version,
           CAST(112 + c_nationkey // 4 AS INTEGER) AS client_protocol, n_name AS sql_text
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON day(o_orderdate) = n_nationkey
    """,
)
def active_sessions(tables: Tables) -> DataFrame:
    """Orders as processes, customers as connections, nations as statements (by day of month)."""
    node = F.lit("node-1").alias("instance_fullname")
    processes = tables.orders.select(
        node,
        F.col("o_orderkey").alias("kpid"),
        F.col("o_custkey").alias("spid"),
        F.col("o_orderstatus").alias("status"),
        F.lit("SELECT").alias("cmd"),
        binary_key(F.day("o_orderdate")).alias("sql_handle"),
    )
    connections = tables.customer.select(
        node,
        F.col("c_custkey").alias("session_id"),
        F.shiftleft(112 + F.floor(F.col("c_nationkey") / 4).cast("int"), 24).alias("protocol_version"),
        F.col("c_mktsegment").alias("encrypt_option"),
        F.lit(None).cast("string").alias("client_net_address"),
        F.lit(None).cast("int").alias("client_tcp_port"),
    )
    statements = tables.nation.select(node, binary_key("n_nationkey").alias("sql_handle"), F.col("n_name").alias("text"))
    return views.active_sessions(processes, connections, statements).select(
        "kpid", "spid", "status", "encrypt_option", "client_protocol_version", "client_protocol", "sql_text"
    )


@query(
    "session_log",
    f"""
    SELECT l_shipdate AS sample_time, l_orderkey AS spid, l_linestatus AS wait_type, l_returnflag AS status,
           l_linenumber AS blocked_by, round(l_quantity * 8 / 1024, 2) AS memory_usage_mb, p_name AS text,
           o_orderstatus AS client_interface_name, o_totalprice AS client_int_version,
           {case_sql("CAST(substr(o_orderpriority, 1, 1) AS INTEGER)", decode.ISOLATION_LEVEL, None)} AS isolation_level,
           'job' AS collected_by
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag <> 'R'
    """,
)
def session_log(tables: Tables) -> DataFrame:
    """Line items as processes (flag R in the background), orders as sessions, parts as statements."""
    node = F.lit("node-1").alias("instance_fullname")
    blank = ("dbname", "hostname", "program_name", "loginame", "nt_username", "cmd")
    processes = tables.lineitem.select(
        node,
        F.col("l_shipdate").alias("sample_time"),
        F.col("l_orderkey").alias("spid"),
        F.col("l_linenumber").alias("blocked"),
        F.when(F.col("l_returnflag") == "R", "background ").otherwise(F.col("l_returnflag")).alias("status"),
        F.col("l_linestatus").alias("lastwaittype"),
        F.lit(0).alias("waittime"),
        F.lit(0).alias("cpu"),
        F.lit(0).alias("physical_io"),
        F.col("l_quantity").cast("int").alias("memory_usage"),
        F.col("l_shipdate").alias("login_time"),
        F.col("l_shipdate").alias("last_batch"),
        F.lit(0).alias("open_tran"),
        *[F.lit("").alias(c) for c in blank],
        binary_key("l_partkey").alias("sql_handle"),
    )
    sessions = tables.orders.select(
        node,
        F.col("o_orderkey").alias("session_id"),
        F.col("o_orderstatus").alias("client_interface_name"),
        F.col("o_totalprice").alias("client_version"),
        F.substring("o_orderpriority", 1, 1).cast("smallint").alias("transaction_isolation_level"),
    )
    statements = tables.part.select(node, binary_key("p_partkey").alias("sql_handle"), F.col("p_name").alias("text"))
    return views.session_log(processes, sessions, statements, "job").select(
        "sample_time",
        "spid",
        "wait_type",
        "status",
        "blocked_by",
        F.col("memory_usage_mb").cast("double").alias("memory_usage_mb"),
        "text",
        "client_interface_name",
        "client_int_version",
        "isolation_level",
        "collected_by",
    )


@query(
    "active_sessions_as_of",
    """
    WITH p AS (SELECT * FROM events WHERE event_type IN ('view', 'purchase'))
    SELECT p.event_id AS kpid, CAST(p.user_id % 50 AS BIGINT) AS spid, p.ts AS sample_time,
           CAST(c.value AS VARCHAR) AS encrypt_option, n.n_name AS sql_text
    FROM p ASOF JOIN (
        SELECT user_id % 50 AS spid, user_id % 3 AS node, ts, max(value) AS value FROM events
        WHERE event_type = 'click' GROUP BY ALL) c
      ON p.user_id % 3 = c.node AND p.user_id % 50 = c.spid AND p.ts >= c.ts
    JOIN nation n ON p.user_id % 25 = n.n_nationkey
    """,
)
def active_sessions_as_of(tables: Tables) -> DataFrame:
    """Events as samples of processes and connections whose ids are used again: each process has the connection of its time."""
    server = F.concat(F.lit("node-"), (F.col("user_id") % 3).cast("string")).alias("instance_fullname")
    spid, time = (F.col("user_id") % 50).cast("bigint"), F.col("ts").alias("sample_time")
    kind = F.col("event_type")
    processes = tables.events.where(kind.isin("view", "purchase")).select(
        server, time, spid.alias("spid"), F.col("event_id").alias("kpid"), F.lit("SELECT").alias("cmd"),
        binary_key(F.col("user_id") % 25).alias("sql_handle"),
    )
    # The greatest of the settings of one moment counts.
    connections = tables.events.where(kind == "click").groupBy("user_id", "ts").agg(F.max("value").alias("value")).select(
        server, time, spid.alias("session_id"), F.lit(0).alias("protocol_version"), F.col("value").alias("encrypt_option"),
        F.lit(None).cast("string").alias("client_net_address"), F.lit(None).cast("int").alias("client_tcp_port"),
    )
    texts = tables.nation.select(binary_key("n_nationkey").alias("sql_handle"), F.col("n_name").alias("text"))
    statements = texts.withColumn("instance_fullname", F.explode(F.array(*[F.lit(f"node-{i}") for i in range(3)])))
    return views.active_sessions(processes, connections, statements).select(
        "kpid", "spid", "sample_time", F.col("encrypt_option").cast("string").alias("encrypt_option"), "sql_text"
    )
