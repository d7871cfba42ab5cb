"""Report and catalog operators over line items, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import decode
from fleetloom.functions.text import xml_escape
from fleetloom.operators import reports
from fleetloom.plans.registry import Tables, query
from fleetloom.plans.views import binary_key, case_sql


@query(
    "execution_log",
    f"""
    WITH c AS (SELECT * FROM part WHERE p_type <> 'ECONOMY'),
    e AS (SELECT *, CAST(l_quantity AS INTEGER) AS act,
                 CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 7 END AS req FROM lineitem)
    SELECT l_orderkey AS logentryid, 'user' || l_suppkey AS username,
           coalesce(CASE WHEN act = 11 THEN CASE WHEN l_linestatus = 'O' THEN '/s&<' || l_suppkey END
                         ELSE '/' || p_brand || '/' || p_name END, 'Unknown') AS itempath,
           CAST(p_partkey AS VARCHAR) AS itemid, CASE WHEN p_partkey IS NULL THEN 1 ELSE 0 END AS isitemdeleted,
           coalesce(p_name, 'Deleted') AS itemname, p_size AS itemtype,
           {case_sql("p_size", decode.CATALOG_TYPE)} AS itemtypedesc,
           {case_sql("req", decode.REQUEST_TYPE)} AS requesttype,
           {case_sql("act", decode.REPORT_ACTION)} AS itemaction,
           {case_sql("l_linenumber + 1", decode.EXECUTION_SOURCE)} AS source,
           l_shipdate AS timestart
    FROM e LEFT JOIN c ON l_partkey = p_partkey
    WHERE 'user' || l_suppkey NOT LIKE 'user1%'
    """,
)
def execution_log(tables: Tables) -> DataFrame:
    """Line items as report executions, parts of most types as the catalog."""
    flag, number = F.col("l_returnflag"), F.lit(None).cast("int")
    uri = F.when(
        F.col("l_linestatus") == "O",
        F.concat(
            F.lit("<AdditionalInfo><SourceReportUri>"),
            xml_escape(F.concat(F.lit("/s&<"), "l_suppkey")),
            F.lit("</SourceReportUri><SourceReportUri>second</SourceReportUri></AdditionalInfo>"),
        ),
    ).otherwise("<AdditionalInfo><Other>1</Other></AdditionalInfo>")
    log = tables.lineitem.select(
        F.col("l_orderkey").alias("logentryid"),
        F.lit("node-1").alias("instancename"),
        F.col("l_partkey").cast("string").alias("reportid"),
        F.concat(F.lit("user"), "l_suppkey").alias("username"),
        F.lit(None).cast("string").alias("executionid"),
        F.when(flag == "A", 0).when(flag == "N", 2).otherwise(7).alias("requesttype"),
        *[F.lit(None).cast("string").alias(c) for c in ("format", "parameters", "status")],
        F.col("l_quantity").cast("int").alias("reportaction"),
        F.col("l_shipdate").alias("timestart"),
        F.col("l_shipdate").alias("timeend"),
        *[number.alias(c) for c in ("timedataretrieval", "timeprocessing", "timerendering", "bytecount", "rowcount")],
        (F.col("l_linenumber") + 1).alias("source"),
        uri.alias("additionalinfo"),
    )
    catalog = tables.part.where(F.col("p_type") != "ECONOMY").select(
        F.col("p_partkey").cast("string").alias("itemid"),
        F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_name").alias("path"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("type"),
    )
    return reports.execution_log(log, catalog, exclude_user_like="user1%").select(
        "logentryid",
        "username",
        "itempath",
        "itemid",
        "isitemdeleted",
        "itemname",
        "itemtype",
        "itemtypedesc",
        "requesttype",
        "itemaction",
        "source",
        "timestart",
    )


def order_executions(tables: Tables) -> DataFrame:
    """Orders as executions of one item per customer and status."""
    status = F.col("o_orderstatus")
    return tables.orders.select(
        F.col("o_custkey").alias("itemid"),
        F.when(F.col("o_totalprice") >= 100000, F.concat(F.lit("user"), F.substring("o_orderpriority", 1, 1))).alias("username"),
        F.when(status == "F", 13).otherwise(2).alias("itemtype"),
        F.when(status == "P", F.concat(F.lit("/"), "o_custkey"))
        .otherwise(F.concat(F.lit("/folder"), status, F.lit("/"), "o_custkey"))
        .alias("itempath"),
        F.concat(F.lit("item"), "o_custkey").alias("itemname"),
        F.when(status == "O", "DataRefresh").otherwise("Render").alias("itemaction"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("executionid"),
        F.floor("o_totalprice").cast("int").alias("timeprocessing"),
        F.floor(F.col("o_totalprice") / 7).cast("int").alias("timerendering"),
        F.col("o_orderkey").alias("bytecount"),
        F.col("o_orderdate").alias("timestart"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey"))).alias("timeend"),
    )


def stats_sql(user: str, users: str) -> str:
    return f"""
    WITH e AS (
        SELECT o_custkey AS itemid, CASE WHEN o_orderstatus = 'F' THEN 13 ELSE 2 END AS itemtype,
               CASE WHEN o_totalprice >= 100000 THEN 'user' || substr(o_orderpriority, 1, 1) END AS username,
               CASE WHEN o_orderstatus = 'P' THEN '/' || o_custkey
                    ELSE '/folder' || o_orderstatus || '/' || o_custkey END AS itempath,
               CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'folder' || o_orderstatus END AS parentfolder,
               o_orderstatus = 'O' AS refresh, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey END AS executionid,
               CAST(floor(o_totalprice) AS BIGINT) AS p, CAST(floor(o_totalprice / 7) AS BIGINT) AS r,
               o_orderkey, o_orderdate, o_orderdate + to_seconds(o_orderkey) AS timeend
        FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-15 06:00:00')
    SELECT itemid, {user} itempath, 'item' || itemid AS itemname, strftime(o_orderdate, '%Y%m') AS periodmonth,
           parentfolder, 'http://baseurl' || CASE itemtype WHEN 13 THEN '' ELSE '/BI/report' END || itempath AS reporturl,
           count(DISTINCT {users}) AS distinct_users, sum(p)::DOUBLE / 1000 AS total_timeprocessing,
           sum(r)::DOUBLE / 1000 AS total_timerendering, CAST(sum(o_orderkey) AS BIGINT) AS total_bytecount,
           count(executionid) AS total_executions, max(timeend) AS lastaccessed,
           CAST(datediff('day', min(timeend), max(timeend)) AS INTEGER) AS statsperiod_days,
           CAST(sum(CASE WHEN refresh THEN o_orderkey END) // count(CASE WHEN refresh THEN 1 END) AS BIGINT)
               AS avgmodelrefresh_sec
    FROM e GROUP BY ALL
    """


def _stats(tables: Tables, by_user: bool) -> DataFrame:
    stats = reports.execution_stats(order_executions(tables), as_of="2009-03-15 06:00:00", by_user=by_user)
    return stats.withColumns(
        {c: F.col(c).cast("double") for c in ("total_timeprocessing", "total_timerendering")}
    )


@query("execution_stats", stats_sql("username,", "username"))
def execution_stats(tables: Tables) -> DataFrame:
    """Order statistics per customer, user and month."""
    return _stats(tables, by_user=True)


@query("execution_stats_by_item", stats_sql("", "username"))
def execution_stats_by_item(tables: Tables) -> DataFrame:
    """Order statistics per customer and month over all users."""
    return _stats(tables, by_user=False)


@query(
    "subscriptions",
    """
    SELECT CAST(n_nationkey AS VARCHAR) AS reportitemid, n_name AS reportname, '/r' || n_regionkey AS reportlocation,
           s_name AS subscriptiontitle, s_suppkey AS eventtype
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0
    """,
)
def subscriptions(tables: Tables) -> DataFrame:
    """Suppliers as subscriptions to nations; nations of one region are gone from the catalog."""
    subs = tables.supplier.select(
        F.col("s_nationkey").cast("string").alias("report_oid"),
        F.col("s_name").alias("description"),
        F.col("s_suppkey").alias("eventtype"),
        F.lit(None).cast("timestamp").alias("lastruntime"),
        F.lit(None).cast("string").alias("laststatus"),
    )
    catalog = tables.nation.where(F.col("n_regionkey") != 0).select(
        F.col("n_nationkey").cast("string").alias("itemid"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("/r"), "n_regionkey").alias("path"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("timestamp").alias("creationdate"),
    )
    return reports.subscriptions(subs, catalog).select(
        "reportitemid", "reportname", "reportlocation", "subscriptiontitle", "eventtype"
    )


@query(
    "report_catalog",
    f"""
    WITH c AS (
        SELECT *, CASE p_brand WHEN 'Brand#1' THEN '/WorkSpace/Subscriptions and Notifications/'
                               WHEN 'Brand#2' THEN '/area/HYPERLINKS/Subscriptions and Notifications/'
                               WHEN 'Brand#3' THEN '/longer-area/WorkSpace/subscriptions and notifications/'
                               ELSE '/' || p_brand || '/' END || p_name AS path
        FROM part WHERE p_size NOT IN (1, 3, 5, 8))
    SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS slnum, p_partkey AS reportitemid, p_name AS reportname,
           path AS reportlocation,
           CASE p_brand WHEN 'Brand#1' THEN 'WorkSpace' WHEN 'Brand#2' THEN 'URL Ref.' WHEN 'Brand#3' THEN 'Subscriptions'
                        ELSE 'LIVE' END AS reportstage,
           {case_sql("p_size", decode.CATALOG_TYPE)} AS reporttype, p_type AS reportdescription,
           CAST(DATE '2024-01-01' + p_size AS DATE) AS createdon, CAST(DATE '2024-03-01' + p_size AS DATE) AS modifiedon
    FROM c
    """,
)
def report_catalog(tables: Tables) -> DataFrame:
    """Parts as reports, numbered by name."""
    brand = F.col("p_brand")
    folder = (
        F.when(brand == "Brand#1", "/WorkSpace/Subscriptions and Notifications/")
        .when(brand == "Brand#2", "/area/HYPERLINKS/Subscriptions and Notifications/")
        .when(brand == "Brand#3", "/longer-area/WorkSpace/subscriptions and notifications/")
        .otherwise(F.concat(F.lit("/"), brand, F.lit("/")))
    )
    catalog = tables.part.select(
        F.col("p_partkey").alias("itemid"),
        F.col("p_name").alias("name"),
        F.concat(folder, "p_name").alias("path"),
        F.col("p_size").alias("type"),
        F.col("p_type").alias("description"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("timestamp").alias("creationdate"),
        F.date_add(F.lit("2024-03-01").cast("date"), F.col("p_size")).cast("timestamp").alias("modifieddate"),
    )
    return reports.report_catalog(catalog)


@query(
    "report_sources",
    """
    SELECT '/' || p_brand || '/' || p_name AS source_uri, count(*) AS executions,
           TIMESTAMP '2024-01-01' + to_days(CAST(max(p_size) AS INTEGER)) AS last_access
    FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1
    """,
)
def report_sources(tables: Tables) -> DataFrame:
    """Parts as executions whose XML names a URI; one type has XML without it."""
    uri = xml_escape(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_name"))
    info = F.when(
        F.col("p_type") != "ECONOMY",
        F.concat(F.lit("<AdditionalInfo><SourceReportUri>"), uri, F.lit("</SourceReportUri></AdditionalInfo>")),
    ).otherwise(F.concat(F.lit("<AdditionalInfo>"), uri, F.lit("</AdditionalInfo>")))
    log = tables.part.select(
        info.alias("additionalinfo"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("timestamp").alias("timeend"),
    )
    return reports.report_sources(log)


@query(
    "classifications",
    """
    SELECT d.doc_id AS object_id, CASE WHEN d.lang <> 'de' THEN 'schema-' || d.lang END AS schema_name,
           d.source AS table_name, 'text' AS column_name,
           CASE WHEN n_chars > 1000 THEN d.lang END AS information_type,
           CAST(l.quality AS VARCHAR) AS sensitivity_label, b.text AS usage_type
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id
    WHERE n_chars > 1000 OR l.doc_id IS NOT NULL OR b.item_id IS NOT NULL
    """,
)
def classifications(tables: Tables) -> DataFrame:
    """Languages, labels and benchmark passages as three kinds of classification of documents."""
    node = [F.lit("node-1").alias("instance_fullname"), F.lit(1).alias("database_id")]

    def prop(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
        return df.select(
            *node,
            F.col(key).alias("major_id"),
            F.lit(1).alias("minor_id"),
            F.lit(name).alias("name"),
            F.col(value).cast("string").alias("value"),
        )

    documents = tables.documents
    props = (
        prop(documents.where(F.col("n_chars") > 1000), "doc_id", reports.INFORMATION_TYPE, "lang")
        .unionByName(prop(tables.labels, "doc_id", reports.SENSITIVITY_LABEL, "quality"))
        .unionByName(prop(tables.benchmark, "item_id", reports.USAGE_TYPE, "text"))
    )
    objects = documents.select(
        *node, F.col("doc_id").alias("object_id"), F.col("lang").alias("schema_id"), F.col("source").alias("name")
    )
    schemas = (
        documents.where(F.col("lang") != "de")
        .select(*node, F.col("lang").alias("schema_id"), F.concat(F.lit("schema-"), "lang").alias("name"))
        .distinct()
    )
    columns = documents.select(
        *node, F.col("doc_id").alias("object_id"), F.lit(1).alias("column_id"), F.lit("text").alias("name")
    )
    return reports.classifications(props, objects, schemas, columns).drop("instance_fullname", "database_id")


@query(
    "orphans",
    """
    SELECT o_orderkey AS name, o_custkey AS principal_id, CASE o_orderstatus WHEN 'F' THEN 'S' ELSE 'U' END AS type
    FROM orders WHERE o_custkey > 5 AND o_orderstatus <> 'P'
      AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
    """,
)
def orphans(tables: Tables) -> DataFrame:
    """Orders as database users without a line item as login."""
    status = F.col("o_orderstatus")
    users = tables.orders.select(
        F.lit("node-1").alias("instance_fullname"),
        F.col("o_orderkey").alias("name"),
        F.col("o_custkey").alias("principal_id"),
        F.when(status == "F", "S").when(status == "O", "U").otherwise("R").alias("type"),
        binary_key("o_orderkey").alias("sid"),
    )
    logins = tables.lineitem.select(F.lit("node-1").alias("instance_fullname"), binary_key("l_orderkey").alias("sid"))
    return reports.orphaned_users(users, logins).select("name", "principal_id", "type")


@query(
    "database_catalog",
    """
    WITH m AS (SELECT 'db' || o_custkey AS databasename, 'host' || substr(o_orderpriority, 1, 1) AS inst,
                      o_orderstatus AS application_name, o_orderdate AS created_on,
                      CASE o_orderpriority WHEN '5-LOW' THEN 0 ELSE 1 END AS joined,
                      CASE WHEN o_totalprice > 200000 THEN 'FULL' ELSE 'SIMPLE' END AS recovery_model
               FROM orders WHERE o_orderstatus <> 'P' AND (o_totalprice > 100000 OR o_orderpriority = '5-LOW')),
    db AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY databasename
             ORDER BY application_name DESC, created_on DESC, inst DESC, joined DESC, recovery_model DESC) = 1),
    prim AS (SELECT databasename, max(inst) AS instance_fullname FROM m GROUP BY 1),
    s AS (SELECT 'db' || l_suppkey AS databasename, 'host' || l_linenumber AS inst, l_returnflag, l_linestatus,
                 CAST(l_extendedprice * 100 AS BIGINT) AS reserved, CAST(l_quantity AS BIGINT) AS used
          FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'
          QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag, l_linestatus
             ORDER BY l_shipdate DESC, l_shipdate + to_seconds(l_orderkey) DESC, reserved DESC, used DESC) = 1),
    z AS (SELECT databasename, inst, CAST(sum(reserved) AS BIGINT) AS reserved_mb, CAST(sum(used) AS BIGINT) AS used_mb
          FROM s GROUP BY 1, 2)
    SELECT db.databasename, prim.instance_fullname, joined AS is_joined_availabilitygroups, recovery_model,
           application_name, reserved_mb, used_mb
    FROM db JOIN prim USING (databasename)
    LEFT JOIN z ON z.databasename = db.databasename AND z.inst = prim.instance_fullname
    """,
)
def database_catalog(tables: Tables) -> DataFrame:
    """Orders as the database list of a fleet, line items as its size log."""
    master = tables.orders.select(
        F.concat(F.lit("db"), "o_custkey").alias("databasename"),
        F.concat(F.lit("host"), F.substring("o_orderpriority", 1, 1)).alias("instancefullname"),
        F.col("o_orderstatus").alias("application_name"),
        F.col("o_orderdate").alias("created_on"),
        (F.col("o_orderstatus") == "P").alias("is_dropped"),
        (F.col("o_totalprice") > 100000).alias("is_ag_primary"),
        F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(1).alias("is_joined_availabilitygroups"),
        F.when(F.col("o_totalprice") > 200000, "FULL").otherwise("SIMPLE").alias("recovery_model"),
    )
    sizes = tables.lineitem.select(
        F.concat(F.lit("db"), "l_suppkey").alias("databasename"),
        F.concat(F.lit("host"), "l_linenumber").alias("instancefullname"),
        F.col("l_returnflag").alias("usagetype"),
        F.col("l_linestatus").alias("allocationtype"),
        F.lit(None).cast("string").alias("filegroupname"),
        F.to_date("l_shipdate").alias("log_date"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=F.col("l_orderkey"))).alias("modified_on"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("reserved_mb"),
        F.col("l_quantity").cast("bigint").alias("used_mb"),
    )
    return reports.database_catalog(master, sizes, as_of="2001-01-11").select(
        "databasename",
        "instance_fullname",
        "is_joined_availabilitygroups",
        "recovery_model",
        "application_name",
        "reserved_mb",
        "used_mb",
    )
