"""Loading operators over the order, customer, part and event tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.durable import shared_folder
from fleetloom.operators import ingest
from fleetloom.plans.registry import Tables, query
from fleetloom.sources.fleet import fleet_union, health_check_union
from fleetloom.sources.logs import DatedLog

ORDER_ROW = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, "
    "o_orderpriority STRING"
)


def _orders_of(folder: str, status: str):
    return lambda spark: spark.read.parquet(folder).where(F.col("o_orderstatus") == status)


@query(
    "fleet_union",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
           'node-' || o_orderstatus AS source
    FROM orders
    """,
)
def fleet(tables: Tables) -> DataFrame:
    """Orders of three servers (one per status) and of a fourth that does not answer."""
    path = tables.path("orders")
    sources = {f"node-{status}": _orders_of(path, status) for status in ("F", "O", "P")}
    sources["node-down"] = lambda spark: spark.read.parquet(path + ".missing")
    return fleet_union(tables.spark, sources, ORDER_ROW).data


@query(
    "fleet_errors",
    """
    SELECT 'fleet_union' AS process_name, 'node-' || o_orderstatus AS object_ref, count(*) AS rows_read, NULL AS failed
    FROM orders GROUP BY o_orderstatus
    UNION ALL
    SELECT 'fleet_union', 'node-down', NULL, 'path'
    UNION ALL
    SELECT 'fleet_union', 'node-schema', NULL, 'columns'
    UNION ALL
    SELECT 'fleet_union', 'node-types', CASE WHEN count(*) = 0 THEN count(*) END, CASE WHEN count(*) > 0 THEN 'rows' END
    FROM orders WHERE o_orderpriority = '1-URGENT'
    """,
)
def fleet_errors(tables: Tables) -> DataFrame:
    """What the fan-in had of each source: rows read, or why it failed.

    One source is not there, one has no such columns, and one has rows that end its job when they are read.
    """
    path, other = tables.path("orders"), tables.path("customer")
    sources = {f"node-{status}": _orders_of(path, status) for status in ("F", "O", "P")}
    sources["node-down"] = lambda spark: spark.read.parquet(path + ".missing")
    sources["node-schema"] = lambda spark: spark.read.parquet(other)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    sources["node-types"] = lambda spark: spark.read.parquet(path).where(urgent).withColumn(
        "o_custkey", F.substring("o_orderpriority", 3, 10).cast("bigint")
    )
    found = fleet_union(tables.spark, sources, ORDER_ROW)
    message = F.col("error_msg")
    failed = F.when(F.contains(message, F.lit("columns missing")), "columns").when(F.contains(message, F.lit("PATH_NOT_FOUND")), "path")
    none = F.lit(None).cast("bigint").alias("rows_read")
    read = found.data.groupBy(F.col("source").alias("object_ref")).agg(F.count(F.lit(1)).alias("rows_read"))
    read = read.select(F.lit("fleet_union").alias("process_name"), "object_ref", "rows_read", F.lit(None).cast("string").alias("failed"))
    return read.unionByName(found.errors.select("process_name", "object_ref", none, failed.otherwise("rows").alias("failed")))


@query(
    "health_union",
    """
    SELECT 'customers' AS instance_name, c_name AS database_name, c_nationkey AS replica, c_acctbal AS database_size_mb
    FROM customer
    UNION ALL
    SELECT 'suppliers', s_name, s_nationkey, s_acctbal FROM supplier
    """,
)
def health_union(tables: Tables) -> DataFrame:
    """Common columns of two servers' check tables; a third one lacks the object."""

    def checks(table: str, prefix: str):
        return lambda spark: spark.read.parquet(tables.path(table)).select(
            F.col(f"{prefix}_name").alias("database_name"),
            F.col(f"{prefix}_nationkey").alias("replica"),
            F.col(f"{prefix}_acctbal").alias("database_size_mb"),
        )

    sources = {
        "customers": checks("customer", "c"),
        "suppliers": checks("supplier", "s"),
        "absent": lambda spark: spark.read.parquet(tables.path("no_such_table")),
    }
    return health_check_union(
        tables.spark, sources, "database_name STRING, replica INT, database_size_mb DOUBLE"
    ).data


def _event_counters(tables: Tables) -> DataFrame:
    kind = F.col("event_type")
    return tables.events.select(
        F.col("user_id").cast("string").alias("instance_fullname"),
        # Padded with blanks, as fixed-width server columns are.
        F.concat(
            F.lit("srv:"),
            F.when(kind == "view", "Buffer Manager")
            .when(kind == "click", "SQL Statistics")
            .when(kind.isin("error", "purchase"), "Databases")
            .otherwise("Plan Cache"),
            F.lit("   "),
        ).alias("object_name"),
        F.when(kind == "error", "Transactions/sec ").otherwise("Backups").alias("counter_name"),
        F.col("event_id").cast("string").alias("instance_name"),
        F.floor(F.col("value") / 20).alias("cntr_value"),
    )


@query(
    "select_counters",
    """
    SELECT CAST(user_id AS VARCHAR) AS instance_fullname,
           'srv:' || CASE event_type WHEN 'view' THEN 'Buffer Manager' WHEN 'click' THEN 'SQL Statistics'
                                     ELSE 'Databases' END AS object_name,
           CASE event_type WHEN 'error' THEN 'Transactions/sec' ELSE 'Backups' END AS counter_name,
           CAST(event_id AS VARCHAR) AS instance_name,
           CAST(floor(value / 20) AS BIGINT) AS cntr_value,
           TIMESTAMP '2024-02-01 00:01:00' AS sample_time,
           DATE '2024-02-01' AS sample_date
    FROM events
    WHERE event_type IN ('view', 'click') OR (event_type = 'error' AND floor(value / 20) <> 0)
    """,
)
def select_counters(tables: Tables) -> DataFrame:
    """Events as counters: two kept objects, per-database counters only when not zero."""
    return ingest.append_sample(_event_counters(tables), as_of="2024-02-01 00:00:30")


@query(
    "insert_new",
    """
    WITH target AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
    staged AS (
        SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
    SELECT *, 'target' AS origin FROM target
    UNION ALL
    SELECT s.o_orderkey, any_value(s.o_custkey), any_value(s.o_orderstatus), min(s.o_totalprice),
           any_value(s.o_orderdate), any_value(s.o_orderpriority), 'staged'
    FROM staged s WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.o_orderkey = s.o_orderkey)
    GROUP BY s.o_orderkey
    """,
)
def insert_new(tables: Tables) -> DataFrame:
    """Orders until 1998 loaded, then a staging set of 1998 and later that has every key twice."""
    orders = tables.orders
    target = orders.where(F.col("o_orderdate") < "1999-01-01").withColumn("origin", F.lit("target"))
    late = orders.where(F.col("o_orderdate") >= "1998-01-01")
    staged = late.unionByName(late.withColumn("o_totalprice", F.col("o_totalprice") + 1)).withColumn(
        "origin", F.lit("staged")
    )
    return ingest.insert_new(target, staged, ["o_orderkey"], order_by=["o_totalprice"])


def _customers(tables: Tables) -> DataFrame:
    return tables.customer.select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        "c_acctbal",
        "c_mktsegment",
        (F.col("c_acctbal") < 0).alias("is_dropped"),
        F.lit("2024-01-01").cast("timestamp").alias("created_on"),
        F.lit(None).cast("timestamp").alias("modified_on"),
    )


@query(
    "upsert_latest",
    """
    SELECT c_custkey, c_name, c_nationkey,
           CASE WHEN c_acctbal >= 5000 AND c_mktsegment <> 'BUILDING' THEN c_acctbal * 2
                WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_mktsegment = 'BUILDING' THEN lower(c_mktsegment)
                WHEN c_acctbal >= 5000 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
           CASE WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '2024-02-01'
                ELSE TIMESTAMP '2024-01-01' END AS created_on,
           CASE WHEN c_mktsegment <> 'BUILDING' AND c_acctbal >= 5000 THEN TIMESTAMP '2024-02-01' END AS modified_on
    FROM customer
    """,
)
def upsert_latest(tables: Tables) -> DataFrame:
    """One segment is new; rich customers of the others are refreshed, but keep their nation."""
    customers = _customers(tables).drop("is_dropped")
    target = customers.where(F.col("c_mktsegment") != "BUILDING")
    staged = (
        customers.where((F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") >= 5000))
        .withColumn("c_acctbal", F.col("c_acctbal") * 2)
        .withColumn("c_nationkey", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey")).otherwise(-1))
        .withColumn("c_mktsegment", F.lower("c_mktsegment"))
    )
    return ingest.upsert_latest(
        target, staged, ["c_custkey"], ["c_acctbal", "c_mktsegment"], as_of="2024-02-01"
    )


@query(
    "mark_dropped",
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
           CASE WHEN c_acctbal < 3000 OR c_mktsegment = 'MACHINERY' THEN FALSE
                WHEN c_mktsegment = 'BUILDING' THEN c_acctbal < 0 ELSE TRUE END AS is_dropped,
           TIMESTAMP '2024-01-01' AS created_on,
           CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-02-01'
                WHEN c_acctbal < 3000 OR c_mktsegment IN ('MACHINERY', 'BUILDING') THEN NULL
                ELSE TIMESTAMP '2024-02-01' END AS modified_on
    FROM customer
    """,
)
def mark_dropped(tables: Tables) -> DataFrame:
    """Customers missing from staging are flagged, returning ones unflagged, a silent segment left alone."""
    customers = _customers(tables)
    staged = customers.where((F.col("c_acctbal") < 3000) | (F.col("c_mktsegment") == "MACHINERY"))
    return ingest.mark_dropped(
        customers,
        staged,
        ["c_mktsegment", "c_custkey"],
        as_of="2024-02-01",
        ok_sources=["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        source_col="c_mktsegment",
    )


@query(
    "sync_database_master",
    """
    WITH c AS (
        SELECT *, c_custkey % 5 <> 0 AS known, c_custkey % 7 <> 0 AND c_mktsegment <> 'FURNITURE' AS seen,
               c_mktsegment <> 'FURNITURE' AS answered
        FROM customer)
    SELECT c_mktsegment AS instancefullname, c_name AS databasename,
           CASE WHEN known THEN c_nationkey ELSE c_nationkey + 100 END AS database_id,
           CASE WHEN NOT seen THEN 'BULK' WHEN c_acctbal > 0 THEN 'SIMPLE' ELSE 'FULL' END AS recovery_model,
           CAST(CASE WHEN seen THEN floor(c_acctbal * 2) ELSE floor(c_acctbal) END AS INTEGER) AS row_data_mb,
           CASE WHEN seen THEN FALSE WHEN answered THEN TRUE ELSE c_acctbal < 0 END AS is_dropped,
           CASE WHEN known THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS created_on,
           CASE WHEN known AND answered THEN TIMESTAMP '2024-02-01' END AS modified_on
    FROM c WHERE known OR seen
    """,
)
def sync_database_master(tables: Tables) -> DataFrame:
    """Customers as databases of one server per segment, collected from the servers that answer, some twice, and loaded."""
    path = tables.path("customer")
    recovery = F.when(F.col("c_acctbal") > 0, "SIMPLE").otherwise("FULL")

    def server(segment: str):
        def rows(spark):
            found = spark.read.parquet(path if segment != "FURNITURE" else path + ".missing")
            held = found.where((F.col("c_mktsegment") == segment) & (F.col("c_custkey") % 7 != 0)).select(
                F.col("c_name").alias("databasename"),
                (F.col("c_nationkey") + 100).alias("database_id"),
                recovery.alias("recovery_model"),
                F.floor(F.col("c_acctbal") * 2).cast("int").alias("row_data_mb"),
            )
            return held.unionByName(held.withColumn("row_data_mb", F.col("row_data_mb") + 1))

        return rows

    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    schema = "databasename STRING, database_id INT, recovery_model STRING, row_data_mb INT"
    staged = fleet_union(tables.spark, {s: server(s) for s in segments}, schema, source_col="instancefullname")
    master = tables.customer.where(F.col("c_custkey") % 5 != 0).select(
        F.col("c_mktsegment").alias("instancefullname"),
        F.col("c_name").alias("databasename"),
        F.col("c_nationkey").alias("database_id"),
        F.lit("BULK").alias("recovery_model"),
        F.floor("c_acctbal").cast("int").alias("row_data_mb"),
        (F.col("c_acctbal") < 0).alias("is_dropped"),
        F.lit("2024-01-01").cast("timestamp").alias("created_on"),
        F.lit(None).cast("timestamp").alias("modified_on"),
    )
    return ingest.sync_database_master(master, staged.data, "2024-02-01", ok_sources=staged.ok_sources)


@query(
    "sync_size_log",
    """
    WITH o AS (
        SELECT *, o_orderstatus <> 'P' AND o_custkey % 3 <> 0 AS known, o_orderdate >= TIMESTAMP '1996-01-01' AS seen FROM orders)
    SELECT o_orderstatus AS instancefullname, 'db' || o_custkey AS databasename, CAST(o_orderkey AS INTEGER) AS databaseid,
           CAST(o_orderdate AS DATE) AS log_date, 'rows' AS usagetype, 'used' AS allocationtype,
           CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS filegroupname,
           CAST(CASE WHEN seen THEN o_totalprice * 2 ELSE o_totalprice END AS DECIMAL(15,3)) AS reserved_mb,
           CAST(CASE WHEN seen THEN o_totalprice ELSE o_totalprice / 2 END AS DECIMAL(15,3)) AS used_mb,
           CASE WHEN known AND seen THEN TIMESTAMP '2024-02-01' END AS modified_on
    FROM o WHERE known OR seen
    """,
)
def sync_size_log(tables: Tables) -> DataFrame:
    """Orders as database parts, some without a file group: sizes of late ones collected twice and loaded."""

    def parts(orders: DataFrame, reserved, used) -> DataFrame:
        return orders.select(
            F.col("o_orderstatus").alias("instancefullname"),
            F.concat(F.lit("db"), F.col("o_custkey").cast("string")).alias("databasename"),
            F.col("o_orderkey").cast("int").alias("databaseid"),
            F.to_date("o_orderdate").alias("log_date"),
            F.lit("rows").alias("usagetype"),
            F.lit("used").alias("allocationtype"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("filegroupname"),
            reserved.cast("decimal(15,3)").alias("reserved_mb"),
            used.cast("decimal(15,3)").alias("used_mb"),
        )

    price, orders = F.col("o_totalprice"), tables.orders
    known = orders.where((F.col("o_orderstatus") != "P") & (F.col("o_custkey") % 3 != 0))
    log = parts(known, price, price / 2).withColumn("modified_on", F.lit(None).cast("timestamp"))
    staged = parts(orders.where(F.col("o_orderdate") >= "1996-01-01"), price * 2, price)
    return ingest.sync_size_log(log, staged.unionByName(staged), "2024-02-01")


@query(
    "retain",
    "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00'",
)
def retain(tables: Tables) -> DataFrame:
    """Events younger than ten days."""
    return ingest.retain(tables.events, "ts", 10, as_of="2024-01-30 12:00:00")


@query(
    "retain_partitions",
    "SELECT event_id, user_id, value, CAST(ts AS DATE) AS sample_date FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20'",
)
def retain_partitions(tables: Tables) -> DataFrame:
    """Events written to a log by day, in two loads, and days older than ten days dropped as whole partitions."""
    schema = "event_id BIGINT, user_id BIGINT, value DOUBLE, sample_date DATE"
    log = DatedLog(tables.spark, shared_folder(tables.spark, "dated-log"), schema)
    rows = tables.events.select("event_id", "user_id", "value", F.to_date("ts").alias("sample_date"))
    for load in (0, 1):
        log.write(rows.where(F.col("event_id") % 2 == load), load)
    log.expire(10, date(2024, 1, 30))
    return log.rows()


@query(
    "dedupe",
    """
    SELECT * EXCLUDE rn FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                     ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn
        FROM lineitem) WHERE rn = 1
    """,
)
def dedupe(tables: Tables) -> DataFrame:
    """Line items, the first shipped one per order and line."""
    return ingest.dedupe(
        tables.lineitem,
        ["l_orderkey", "l_linenumber"],
        ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"],
    )


@query(
    "derive_dim",
    """
    SELECT DISTINCT replace(o_orderpriority, '-', '\\') AS instance_full_name,
           split_part(o_orderpriority, '-', 1) AS instance_host,
           split_part(o_orderpriority, '-', 2) AS instance_name
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'
    """,
)
def derive_dim(tables: Tables) -> DataFrame:
    """Priorities as host\\instance names; one of them is listed already."""
    master = tables.orders.select(
        F.replace("o_orderpriority", F.lit("-"), F.lit("\\")).alias("instancefullname"),
        (F.col("o_orderstatus") == "P").alias("is_dropped"),
    )
    listed = (
        tables.orders.where(F.col("o_orderpriority") == "5-LOW")
        .select(F.replace("o_orderpriority", F.lit("-"), F.lit("\\")).alias("instance_full_name"))
        .distinct()
    )
    return ingest.derive_instances(master, listed)


@query(
    "integrity_history",
    """
    SELECT doc_id AS dbid, source AS messagetext, NULL AS error, 'before' AS instancefullname FROM documents
    UNION ALL
    SELECT l.doc_id, NULL, l.quality, CASE WHEN d.doc_id IS NOT NULL THEN 'node-1' END
    FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en'
    """,
)
def integrity_history(tables: Tables) -> DataFrame:
    """Labels appended to documents as check results; English documents are in scope."""
    history = tables.documents.select(
        F.col("doc_id").alias("dbid"), F.col("source").alias("messagetext"), F.lit("before").alias("instancefullname")
    )
    results = tables.labels.select(F.col("doc_id").alias("dbid"), F.col("quality").alias("error"))
    scope = tables.documents.where(F.col("lang") == "en").select(F.col("doc_id").alias("dbid"))
    return ingest.integrity_history(history, results, "node-1", scope)


def _calls(tables: Tables) -> DataFrame:
    return tables.events.select(
        F.col("event_type").alias("appname"),
        F.col("user_id").cast("string").alias("sessionuser"),
        F.col("ts").alias("logdatetime"),
        F.when(F.col("value") < 100, "OK").otherwise("Failed").alias("staustext"),
        F.col("props").alias("calldetails"),
    )


@query(
    "notification_log",
    """
    SELECT CAST(strftime(ts, '%Y%m%d%H%M%S') || lpad(CAST((epoch_us(ts) % 1000000) // 10 AS VARCHAR), 5, '0') AS BIGINT)
               AS sessionid,
           event_type AS appname, CAST(user_id AS VARCHAR) AS sessionuser, ts AS logdatetime,
           CASE WHEN value < 100 THEN 'OK' ELSE 'Failed' END AS staustext, props AS calldetails
    FROM events WHERE ts > TIMESTAMP '2024-01-10'
    """,
)
def notification_log(tables: Tables) -> DataFrame:
    """Events as notification calls, those of the last year kept."""
    return ingest.notification_log(None, _calls(tables), as_of="2025-01-09")


@query(
    "notification_status",
    """
    SELECT event_type AS appname, CASE WHEN value < 100 THEN 'OK' ELSE 'Failed' END AS staustext,
           count(*) AS calls, max(ts) AS last_call
    FROM events WHERE ts > TIMESTAMP '2024-01-10' GROUP BY 1, 2
    """,
)
def notification_status(tables: Tables) -> DataFrame:
    """Calls per application and status in the retained log."""
    return ingest.notification_status(ingest.notification_log(None, _calls(tables), as_of="2025-01-09"))
