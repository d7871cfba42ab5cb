import hashlib

import pytest

from fleetloom.operators import xmlevents
from fleetloom.sources import readers, schemas
from tests.conftest import at, tuples


def event(name="sql_batch", t="2024-01-01T10:00:00.5Z", **data):
    inner = "".join(f'<data name="{k}"><value>{v}</value></data>' for k, v in data.items())
    return f'<event name="{name}" package="sqlserver" timestamp="{t}">{inner}</event>'


def buffers(table, *docs):
    return table(schemas.XE_RING_BUFFER, [dict(instance_fullname="n1", targetdata=d) for d in docs])


def test_long_running_queries(table):
    doc = "<RingBufferTarget truncated='0'>" + event(cpu_time=5, duration=7, batch_text="a &lt; b") + event(
        t="2023-12-31T11:59:59Z", batch_text="old") + event(cpu_time=1) + event(cpu_time="x", batch_text="y" * 200, Statement="z") + "</RingBufferTarget>"
    got = xmlevents.long_running_queries(buffers(table, doc, "<broken", None, "<RingBufferTarget/>"), "2024-01-01 12:00")
    assert tuples(got, "timestamp", "cpu_time", "duration", "physical_reads", "batch_text", "statement") == [
        (at("2024-01-01 10:00:00.500"), None, None, None, "y" * 200, "z"), (at("2024-01-01 10:00:00.500"), 5, 7, None, "a < b", None)]


def test_first_only_mixes_events(table):
    doc = "<RingBufferTarget>" + event(cpu_time=5) + event(duration=9, batch_text="second") + "</RingBufferTarget>"
    got = xmlevents.long_running_queries(buffers(table, doc), "2024-01-01 12:00", first_only=True)
    assert tuples(got, "cpu_time", "duration", "batch_text") == [(5, 9, "second")]


def report(loop="7", blocked=52, blocking=51, ecid=0):
    attr = f' monitorLoop="{loop}"' if loop else ""
    by = f'<process spid="{blocking}" ecid="0"/>' if blocking else "<process/>"
    return (f'<blocked-process-report{attr}><blocked-process><process id="p" spid="{blocked}" ecid="{ecid}"><inputbuf>x &lt; y</inputbuf>'
            f"</process></blocked-process><blocking-process>{by}</blocking-process></blocked-process-report>")


def raw(table, *rows):
    return table(schemas.BLOCKED_REPORTS_RAW, [dict(instance_fullname="n1", textdata=x, eventclass=c, endtime=at(t) if t else None) for x, c, t in rows])


COLS = ("monitorloop", "databasename", "endtime", "duration", "blocking_spid", "blocked_spid", "blocked_ecid", "report_xml")


def test_trace_rows(table):
    lost = report(loop=None)
    df = raw(table, (report(ecid=3), 137, "2024-01-01 10:00"), (report(), 10, "2024-01-01"), (report(blocking=None), 137, "2024-01-01"),
             (report(loop=None, blocked=60), 137, "2024-01-01 10:00:01.7"), (lost, 137, None), ("<oops", 137, "2024-01-01"))
    got = xmlevents.shred_blocked_reports(df, "trace")
    assert got.columns == [c.split()[0] for c in schemas.BLOCKED_REPORTS.split(", ")]
    assert tuples(got, *COLS) == sorted([
        ("7", None, at("2024-01-01 10:00"), None, 51, 52, 3, report(ecid=3)),
        ("2024-01-01 10:00:01", None, at("2024-01-01 10:00:01.700"), None, 51, 60, 0, report(loop=None, blocked=60)),
        (hashlib.sha256(lost.encode()).hexdigest(), None, None, None, 51, 52, 0, lost)], key=lambda r: [(v is not None, str(v)) for v in r])


def test_event_files(table):
    one = event("blocked_process_report", duration=1999999, database_name="db1", blocked_process=report())
    other = event("some_other", duration=5000, database_name="db2", blocked_process=report(loop=None, blocked=70))
    none = event("blocked_process_report", duration=5)
    got = xmlevents.shred_blocked_reports(raw(table, (one, None, None), (other, None, None), (none, None, None)), "event_file")
    assert tuples(got, *COLS) == [
        ("2024-01-01 10:00:00", None, at("2024-01-01 10:00:00.500"), None, 51, 70, 0, report(loop=None, blocked=70)),
        ("7", "db1", at("2024-01-01 10:00:00.500"), 1999, 51, 52, 0, report())]


def test_ring_buffer(table):
    doc = "<RingBufferTarget>\n" + event("blocked_process_report", blocked_process=report()) + event("x", blocked_process=report(blocked=99)) + event(
        "blocked_process_report", t="2024-01-02T00:00:00Z", duration=9000, blocked_process=report(loop=None, blocked=53)) + "</RingBufferTarget>"
    got = xmlevents.shred_blocked_reports(raw(table, (doc, None, None)), "ring_buffer")
    assert tuples(got, *COLS[:-1]) == [
        ("2024-01-02 00:00:00", None, at("2024-01-02"), None, 51, 53, 0), ("7", None, at("2024-01-01 10:00:00.500"), None, 51, 52, 0)]


def test_ring_buffer_with_events_without_content(table):
    full = event("blocked_process_report", blocked_process=report())
    doc = f'<RingBufferTarget eventCount="4"><event name="a/b &gt; > c" package="p"/>{full}<event/>{full}<event name="x"></event></RingBufferTarget>'
    got = xmlevents.shred_blocked_reports(raw(table, (doc, None, None)), "ring_buffer")
    assert tuples(got, "instance_fullname", "monitorloop", "blocking_spid", "blocked_spid") == [("n1", "7", 51, 52)] * 2


def trace_event(text, end="2024-01-01T10:00:00.123", name="Blocked process report", prefix=""):
    escaped = text.replace("&", "&amp;").replace("<", "&lt;")
    p = prefix
    return (f'<{p}Event id="137" name="{name}"><{p}Column id="1" name="TextData">{escaped}</{p}Column>'
            f'<{p}Column id="15" name="EndTime">{end}</{p}Column></{p}Event>')


def trace_file(events, prefix=""):
    p, ns = prefix, f'xmlns{":" + prefix[:-1] if prefix else ""}="http://tempuri.org/TracePersistence.xsd"'
    return f'<?xml version="1.0" encoding="utf-8"?>\n<{p}TraceData {ns}><{p}Events>{"".join(events)}</{p}Events></{p}TraceData>'


@pytest.mark.parametrize("prefix", ["", "MY:"])
def test_trace_documents(table, prefix):
    doc = trace_file([trace_event(report(), prefix=prefix), trace_event(report(loop=None, blocked=60), "never", prefix=prefix),
                      trace_event(report(), name="Other", prefix=prefix)], prefix)
    got = xmlevents.shred_blocked_reports(raw(table, (doc, None, None)), "xml_file")
    assert tuples(got, *COLS) == [
        ("7", None, at("2024-01-01 10:00:00"), None, 51, 52, 0, report()),
        ("unknown", None, None, None, 51, 60, 0, report(loop=None, blocked=60))]


def test_trace_files_read_event_by_event(spark, tmp_path):
    path = tmp_path / "trace.xml"
    path.write_text(trace_file([trace_event(report(blocked=100 + i)) for i in range(50)]))
    got = xmlevents.trace_events(readers.read_trace_events(spark, str(path), "n1"))
    assert tuples(got, "blocked_spid") == sorted([(100 + i,) for i in range(50)])
    whole = readers.read_documents(spark, str(path), instance="n1")
    assert tuples(xmlevents.trace_documents(whole)) == tuples(got)


def test_unknown_shape(table):
    with pytest.raises(ValueError, match="unknown shape"):
        xmlevents.shred_blocked_reports(raw(table), "csv")


def test_person_names(table):
    def person(first, last):
        return f"<results><name><first>{first}</first>{f'<last>{last}</last>' if last else ''}</name></results>"

    docs = ["<user>" + person("Ann", "Bee") + person("a??b", "Cee") + person("Solo", None) + person("x" * 60, "y") + "</user>", "<user/>", "<bad"]
    df = table(schemas.PERSON_XML, [dict(payload=d) for d in docs])
    assert tuples(xmlevents.xml_person_names(df)) == [(None,), ("Ann Bee",), ("x" * 60 + " y",)]
    assert tuples(xmlevents.xml_person_names(df, length=50))[-1] == ("x" * 50 + " y",)
