"""XML round trips: events and customers written as documents, then read back into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.text import xml_escape
from fleetloom.operators import xmlevents
from fleetloom.plans.registry import Tables, query

# Events per document: consecutive ids, so a document never has more than that.
PER_DOCUMENT = 16


def server() -> Column:
    """Two servers, by day."""
    return F.concat(F.lit("node-"), (F.dayofmonth("ts") % 2).cast("string"))


def documents_of(events: DataFrame, text: Column, before: str, after: str) -> DataFrame:
    """Event texts joined to documents of one server with at most ``PER_DOCUMENT`` events each."""
    parts = F.sort_array(F.collect_list(F.struct("event_id", text.alias("text"))))
    return events.groupBy(
        server().alias("instance_fullname"), F.floor(F.col("event_id") / PER_DOCUMENT).alias("document")
    ).agg(
        F.concat(F.lit(before), F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), F.lit(after)).alias("textdata")
    )


def element(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'<data name="{name}"><value>'), value, F.lit("</value></data>"))


def utc_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


@query(
    "xe_events",
    """
    SELECT 'node-' || day(ts) % 2 AS servername, event_type AS name, 'sqlserver' AS package, ts AS timestamp, user_id AS cpu_time,
           CAST(floor(value) AS BIGINT) AS duration, CASE WHEN value >= 10 THEN event_id END AS physical_reads,
           repeat('a<b & ', 20) || props || repeat('x', 60) AS batch_text,
           CASE WHEN value < 50 THEN 'select ' || event_id END AS statement
    FROM events WHERE ts >= TIMESTAMP '2024-01-11 09:30:00' AND event_type <> 'error'
    """,
)
def xe_events(tables: Tables) -> DataFrame:
    """Events through ring-buffer documents; one type has no text, some lack single values."""
    events, kind = tables.events, F.col("event_type")
    body = xml_escape(F.concat(F.repeat(F.lit("a<b & "), F.lit(20)), "props", F.repeat(F.lit("x"), F.lit(60))))
    text = F.concat(
        F.lit('<event name="'),
        kind,
        F.lit('" package="sqlserver" timestamp="'),
        utc_text(F.col("ts")),
        F.lit('">'),
        element("cpu_time", F.col("user_id").cast("string")),
        element("duration", F.floor("value").cast("string")),
        F.when(F.col("value") >= 10, element("physical_reads", F.col("event_id").cast("string"))).otherwise(""),
        F.when(kind != "error", element("batch_text", body)).otherwise(""),
        F.when(F.col("value") < 50, element("Statement", F.concat(F.lit("select "), "event_id"))).otherwise(""),
        F.lit("</event>"),
    )
    buffers = documents_of(events, text, "<RingBufferTarget>", "</RingBufferTarget>").select(
        "instance_fullname", F.col("textdata").alias("targetdata")
    )
    return xmlevents.long_running_queries(buffers, as_of="2024-01-31 09:30:00", days=20)


def with_reports(tables: Tables) -> DataFrame:
    """Events with the report of a blocked user as XML; one type names no loop, small users no blocker."""
    spid = F.col("user_id") + 1
    by = F.floor(spid / 3)
    blocker = F.when(by > 0, F.concat(F.lit('<process spid="'), by.cast("string"), F.lit('" ecid="0"/>'))).otherwise("<process/>")
    loop = F.when(F.col("event_type") == "view", "").otherwise(
        F.concat(F.lit(' monitorLoop="'), F.date_format("ts", "dd"), F.lit('"'))
    )
    report = F.concat(
        F.lit("<blocked-process-report"),
        loop,
        F.lit('><blocked-process><process id="p" spid="'),
        spid.cast("string"),
        F.lit('" ecid="'),
        F.col("event_id").cast("string"),
        F.lit('"><inputbuf>a &lt; b\n'),
        xml_escape(F.col("props")),
        F.lit("</inputbuf></process></blocked-process><blocking-process>"),
        blocker,
        F.lit("</blocking-process></blocked-process-report>"),
    )
    return tables.events.withColumn("report", report)


def reports_sql(loop: str, endtime: str, duration: str = "NULL::BIGINT", database: str = "NULL::VARCHAR", where: str = "true") -> str:
    return f"""
    WITH e AS (SELECT *, '<blocked-process-report' || CASE WHEN event_type = 'view' THEN ''
            ELSE ' monitorLoop="' || strftime(ts, '%d') || '"' END
          || '><blocked-process><process id="p" spid="' || (user_id + 1) || '" ecid="' || event_id || '"><inputbuf>a &lt; b'
          || chr(10) || replace(props, '"', '&quot;') || '</inputbuf></process></blocked-process><blocking-process><process spid="'
          || ((user_id + 1) // 3) || '" ecid="0"/></blocking-process></blocked-process-report>' AS report FROM events)
    SELECT 'node-' || day(ts) % 2 AS instance_fullname,
           CASE WHEN event_type <> 'view' THEN strftime(ts, '%d') ELSE {loop} END AS monitorloop, {database} AS databasename,
           {endtime} AS endtime, {duration} AS duration, CAST((user_id + 1) // 3 AS INTEGER) AS blocking_spid, 0 AS blocking_ecid,
           CAST(user_id + 1 AS INTEGER) AS blocked_spid, CAST(event_id AS INTEGER) AS blocked_ecid, report AS report_xml
    FROM e WHERE user_id >= 2 AND {where}
    """


SECONDS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query(
    "blocked_reports_trace",
    reports_sql(
        f"CASE WHEN value < 20 THEN sha256(report) ELSE {SECONDS} END",
        "CASE WHEN value >= 20 THEN ts END",
        where="event_type <> 'signup'",
    ),
)
def blocked_reports_trace(tables: Tables) -> DataFrame:
    """Reports as trace rows; another event class is ignored, some rows have no time."""
    rows = with_reports(tables).select(
        server().alias("instance_fullname"),
        F.when(F.col("event_type") == "signup", 12).otherwise(xmlevents.REPORT_EVENT_CLASS).alias("eventclass"),
        F.when(F.col("value") >= 20, F.col("ts")).alias("endtime"),
        F.col("report").alias("textdata"),
    )
    return xmlevents.shred_blocked_reports(rows, "trace")


def report_event(kind: Column) -> Column:
    return F.concat(
        F.lit('<event name="'),
        kind,
        F.lit('" package="sqlserver" timestamp="'),
        utc_text(F.col("ts")),
        F.lit('">'),
        element("duration", (F.col("event_id") * 500).cast("string")),
        element("database_name", F.col("event_type")),
        element("blocked_process", F.col("report")),
        F.lit("</event>"),
    )


@query("blocked_reports_event_file", reports_sql(SECONDS, "ts", "event_id * 500 // 1000", "event_type"))
def blocked_reports_event_file(tables: Tables) -> DataFrame:
    """Reports as event documents, one per row."""
    rows = with_reports(tables).select(
        server().alias("instance_fullname"), report_event(F.lit(xmlevents.REPORT_EVENT)).alias("textdata")
    )
    return xmlevents.shred_blocked_reports(rows, "event_file")


@query("blocked_reports_ring_buffer", reports_sql(SECONDS, "ts", where="event_type <> 'signup'"))
def blocked_reports_ring_buffer(tables: Tables) -> DataFrame:
    """Reports in ring-buffer documents among events of another name, some of them without content."""
    kind = F.when(F.col("event_type") == "signup", "sql_batch_completed").otherwise(xmlevents.REPORT_EVENT)
    empty = F.when(F.col("event_id") % 3 == 0, '<event name="a/b > c" package="sqlserver"/>').otherwise("")
    text = F.concat(empty, report_event(kind))
    documents = documents_of(with_reports(tables), text, "<RingBufferTarget>", "</RingBufferTarget>")
    return xmlevents.shred_blocked_reports(documents, "ring_buffer")


@query(
    "blocked_reports_xml_file",
    reports_sql(
        f"CASE WHEN value < 20 THEN 'unknown' ELSE {SECONDS} END",
        "CASE WHEN value >= 20 THEN date_trunc('second', ts) END",
        where="event_type <> 'signup'",
    ),
)
def blocked_reports_xml_file(tables: Tables) -> DataFrame:
    """Reports as escaped text in exported trace documents with a namespace."""
    kind = F.when(F.col("event_type") == "signup", "SQL:BatchCompleted").otherwise(xmlevents.TRACE_REPORT_EVENT)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.concat(
        F.lit('<Event id="137" name="'),
        kind,
        F.lit('"><Column id="15" name="EndTime">'),
        F.when(F.col("value") >= 20, stamp).otherwise("none"),
        F.lit('</Column><Column id="1" name="TextData">'),
        xml_escape(F.col("report")),
        F.lit("</Column></Event>"),
    )
    documents = documents_of(
        with_reports(tables),
        text,
        '<?xml version="1.0"?><TraceData xmlns="http://tempuri.org/TracePersistence.xsd"><Events>',
        "</Events></TraceData>",
    )
    return xmlevents.shred_blocked_reports(documents, "xml_file")


@query(
    "xml_names",
    """
    SELECT CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name || ' ' || c_mktsegment || ' & Sons' END AS full_name
    FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_nationkey <> 7
    UNION ALL
    SELECT c_name || ' Second' FROM customer
    """,
)
def xml_names(tables: Tables) -> DataFrame:
    """Customers as two person results each; one segment lacks a last name, one nation is unreadable."""
    last = F.when(F.col("c_nationkey") == 7, "a??b").otherwise(xml_escape(F.concat("c_mktsegment", F.lit(" & Sons"))))
    payload = F.concat(
        F.lit("<user><results><gender>x</gender><name><title>Dr</title><first>"),
        "c_name",
        F.lit("</first>"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("<last>"), last, F.lit("</last>"))).otherwise(""),
        F.lit("</name></results><results><name><first>"),
        "c_name",
        F.lit("</first><last>Second</last></name></results></user>"),
    )
    return xmlevents.xml_person_names(tables.customer.select(payload.alias("payload")))
