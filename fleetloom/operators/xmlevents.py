"""XML events to rows: slow queries, blocked-process reports in four shapes, person names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import times
from fleetloom.functions.times import AsOf

# Names and layouts of the event documents.
VALUES = "ARRAY<STRUCT<_name: STRING, value: STRING>>"
EVENT = f"_name STRING, _package STRING, _timestamp STRING, data {VALUES}"
RING_BUFFER = f"event ARRAY<STRUCT<_name: STRING, _package: STRING, _timestamp: STRING, data: {VALUES}>>"
PROCESS = "STRUCT<process: STRUCT<_spid: INT, _ecid: INT>>"
REPORT = f"_monitorLoop STRING, `blocked-process` {PROCESS}, `blocking-process` {PROCESS}"
TRACE_EVENT = "_name STRING, Column ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>"
TRACE_FILE = "Events STRUCT<Event: ARRAY<STRUCT<_name: STRING, Column: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>>>>"
PERSON = "results ARRAY<STRUCT<name: STRUCT<first: STRING, last: STRING>>>"
REPORT_TEXT = r"(?s)<blocked-process-report\b.*?</blocked-process-report>"
# One event: its start tag, in which quoted values may hold any character, then either the end of a
# tag without content or all up to the end tag.
EVENT_TEXT = r"""(?s)<event(?=[\s/>])(?:"[^"]*"|'[^']*'|[^"'>/]+)*+(?:/>|>.*?</event\s*>)"""
REPORT_EVENT = "blocked_process_report"
REPORT_EVENT_CLASS = 137
TRACE_REPORT_EVENT = "Blocked process report"
UNREADABLE = "??"
# End of the fixed values.

IGNORE_NAMESPACE = {"ignoreNamespace": "true"}


def _named(pairs: Column, name: str, value: str = "value") -> Column:
    """Value of the first entry of that name; NULL without one."""
    hit = F.filter(pairs, lambda d: d["_name"] == name)
    return F.try_element_at(hit, F.lit(1))[value]


def _cut(text: Column, length: int | None) -> Column:
    return text if length is None else F.left(text, F.lit(length))


def long_running_queries(
    buffers: DataFrame,
    as_of: AsOf,
    days: int = 1,
    first_only: bool = False,
    name_length: int | None = None,
    text_length: int | None = None,
) -> DataFrame:
    """Slow-query events of the last days from ring-buffer documents, one row per event with a text.

    Names and statements are whole unless a length is given (the original report has 50 and 150).

    ``first_only`` gives one row per document, made of the first value of each kind found in it.
    """
    parsed = buffers.withColumn("_events", F.from_xml("targetdata", RING_BUFFER)["event"])
    if first_only:
        first = F.try_element_at("_events", F.lit(1))
        pairs = F.flatten(F.transform("_events", lambda e: F.coalesce(e["data"], F.array())))
        events = parsed.select(
            "instance_fullname", *[first[c].alias(c) for c in ("_name", "_package", "_timestamp")], pairs.alias("data")
        )
    else:
        events = parsed.select("instance_fullname", F.inline("_events"))
    pairs = F.col("data")
    rows = events.select(
        F.col("instance_fullname").alias("servername"),
        _cut(F.col("_name"), name_length).alias("name"),
        _cut(F.col("_package"), name_length).alias("package"),
        F.col("_timestamp").try_cast("timestamp").alias("timestamp"),
        *[_named(pairs, name).try_cast("bigint").alias(name) for name in ("cpu_time", "duration", "physical_reads")],
        _cut(_named(pairs, "batch_text"), text_length).alias("batch_text"),
        _cut(_named(pairs, "Statement"), text_length).alias("statement"),
    )
    return rows.where((F.col("timestamp") >= times.days_before(as_of, days)) & F.col("batch_text").isNotNull())


def parsed_once(rows: DataFrame, column: str, schema: str, options: dict | None = None) -> DataFrame:
    """The rows with the fields of an XML column beside them, all NULL where it is no proper XML.

    Parsed by a generator, not an expression: filters on the fields stay above it, so that a document
    is read once however many of its fields are used.
    """
    return rows.select("*", F.inline(F.array(F.from_xml(column, schema, options))))


def _reports(rows: DataFrame, unknown_loop: Column | None = None) -> DataFrame:
    """Rows with ``instance_fullname``, ``report_xml``, ``endtime``, ``duration``, ``databasename`` to the common layout."""
    parsed = parsed_once(rows, "report_xml", REPORT)

    def process(kind: str, attribute: str) -> Column:
        return F.col(f"`{kind}-process`")["process"][attribute]

    loop = F.coalesce(
        F.col("_monitorLoop"),
        F.date_format("endtime", "yyyy-MM-dd HH:mm:ss"),
        # A report without loop and time is a loop of its own, the same one in every run.
        unknown_loop if unknown_loop is not None else F.sha2(F.col("report_xml"), 256),
    )
    return parsed.select(
        "instance_fullname",
        loop.alias("monitorloop"),
        "databasename",
        "endtime",
        "duration",
        process("blocking", "_spid").alias("blocking_spid"),
        F.coalesce(process("blocking", "_ecid"), F.lit(0)).alias("blocking_ecid"),
        process("blocked", "_spid").alias("blocked_spid"),
        F.coalesce(process("blocked", "_ecid"), F.lit(0)).alias("blocked_ecid"),
        "report_xml",
    ).where(F.col("blocking_spid").isNotNull() & F.col("blocked_spid").isNotNull())


def _without_measures(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"duration": F.lit(None).cast("bigint"), "databasename": F.lit(None).cast("string")}
    )


def _report_text(event_text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(event_text, F.lit(REPORT_TEXT), F.lit(0)), F.lit(1))


def trace_rows(rows: DataFrame) -> DataFrame:
    """Trace table or trace file rows: the event class tells reports, the text is the report."""
    reports = rows.where(F.col("eventclass") == REPORT_EVENT_CLASS).select(
        "instance_fullname", "endtime", F.col("textdata").alias("report_xml")
    )
    return _reports(_without_measures(reports))


def event_files(rows: DataFrame) -> DataFrame:
    """One event document per row: time, duration (microseconds to whole milliseconds), database, report."""
    parsed = parsed_once(rows.select("instance_fullname", "textdata"), "textdata", EVENT)
    pairs = F.when(F.col("_name") == REPORT_EVENT, F.col("data"))
    return _reports(
        parsed.select(
            "instance_fullname",
            _report_text(F.col("textdata")).alias("report_xml"),
            F.col("_timestamp").try_cast("timestamp").alias("endtime"),
            _named(pairs, "duration").try_cast("bigint").alias("_micros"),
            _named(pairs, "database_name").alias("databasename"),
        ).withColumn("duration", F.expr("_micros div 1000"))
    )


def ring_buffers(rows: DataFrame) -> DataFrame:
    """Ring-buffer documents of many events."""
    texts = F.explode(F.regexp_extract_all("textdata", F.lit(EVENT_TEXT), F.lit(0)))
    events = rows.select("instance_fullname", texts.alias("_text"))
    parsed = parsed_once(events, "_text", EVENT).where(F.col("_name") == REPORT_EVENT)
    return _reports(
        _without_measures(
            parsed.select(
                "instance_fullname",
                F.col("_timestamp").try_cast("timestamp").alias("endtime"),
                _report_text(F.col("_text")).alias("report_xml"),
            )
        )
    )


def trace_events(events: DataFrame) -> DataFrame:
    """Events of exported trace files, one per row, the report as escaped text in a column element."""
    columns = F.col("Column")
    reports = events.where(F.col("_name") == TRACE_REPORT_EVENT).select(
        "instance_fullname",
        F.left(_named(columns, "EndTime", "_VALUE"), F.lit(19)).try_cast("timestamp").alias("endtime"),
        _named(columns, "TextData", "_VALUE").alias("report_xml"),
    )
    return _reports(_without_measures(reports), unknown_loop=F.lit("unknown"))


def trace_documents(rows: DataFrame) -> DataFrame:
    """Whole exported trace files, one per row; for large files read their events instead."""
    events = F.from_xml("textdata", TRACE_FILE, IGNORE_NAMESPACE)["Events"]["Event"]
    return trace_events(rows.select("instance_fullname", events.alias("_events")).select("instance_fullname", F.inline("_events")))


SHAPES = {
    "trace": trace_rows,
    "event_file": event_files,
    "ring_buffer": ring_buffers,
    "xml_file": trace_documents,
}


def shred_blocked_reports(rows: DataFrame, shape: str) -> DataFrame:
    """Blocked-process reports of any of the four shapes in one layout."""
    if shape not in SHAPES:
        raise ValueError(f"unknown shape {shape!r}, expected one of {sorted(SHAPES)}")
    return SHAPES[shape](rows)


def xml_person_names(payloads: DataFrame, length: int | None = None) -> DataFrame:
    """First and last name of every result in the documents; unreadable names are left out.

    A result without one of the two names gives NULL. Names are whole unless a length is given (the
    original has 50 for each of the two).
    """
    results = payloads.select(F.inline(F.from_xml("payload", PERSON)["results"]))
    first, last = (_cut(F.col("name")[part], length) for part in ("first", "last"))
    return results.select(F.concat(first, F.lit(" "), last).alias("full_name")).where(
        ~F.coalesce(F.contains("full_name", F.lit(UNREADABLE)), F.lit(False))
    )
