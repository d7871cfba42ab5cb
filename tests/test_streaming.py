import os
import random
from datetime import timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetloom import plans
from fleetloom.operators import series
from fleetloom.operators.ingest import dedupe
from fleetloom.streaming import streams
from tests.conftest import at, tuples


@pytest.fixture()
def slices(spark, tmp_path):
    """Write rows as one file per slice, in order, and read them as a stream of one file per batch."""

    def write(rows, ddl):
        for rows_of_file in rows:
            spark.createDataFrame(rows_of_file, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return write


CPU = "hostname STRING, sql_instance_name STRING, event_time TIMESTAMP, cpu_percent_sql_server INT, cpu_percent_others INT"


def test_cpu_utilization_of_closed_minutes(spark, slices, tmp_path):
    rng = random.Random(2)
    base = at("2024-01-01 23:30:00")
    rows = [("h", rng.choice(["i", None]), base + timedelta(seconds=rng.randrange(3600)), rng.randrange(100), 1) for _ in range(600)]
    rows.sort(key=lambda r: r[2])
    late = ("h", "i", at("2024-01-01 20:00:00"), 50, 1)
    stream = slices([rows[:200], rows[200:400], rows[400:] + [late]], CPU)
    got = streams.stream_cpu_utilization(stream, delay="5 minutes")
    streams.start_files(got, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.schema(got.schema).parquet(str(tmp_path / "out"))
    batch = series.cpu_utilization(spark.createDataFrame(rows, CPU), "2024-01-02 12:00:00")
    closed = F.lit(rows[-1][2] - timedelta(minutes=5))
    want = batch.where(F.col("event_datetime") + F.expr("interval 30 seconds") <= closed)
    assert want.count() > 20
    assert tuples(out, *want.columns) == tuples(want)


SAMPLE = streams.SAMPLE


def sample_rows(n=900):
    rng = random.Random(4)
    base = at("2024-01-01 00:00:00")
    names = ["hot"] * 6 + ["a", "b"]
    return [("n1", "o", rng.choice(names), None, base + timedelta(seconds=i * 20), rng.randrange(1000)) for i in range(n)]


def as_samples(rows):
    return [(a, b, c, d, t, v) for a, b, c, d, t, v in rows]


def test_counter_rates_in_batches_equal_one_batch(spark, slices, tmp_path):
    rows = sample_rows()
    # Out of order within the delay, across files.
    shuffled = rows[:]
    rng = random.Random(9)
    for i in range(0, len(shuffled), 20):
        part = shuffled[i : i + 20]
        rng.shuffle(part)
        shuffled[i : i + 20] = part
    files = [shuffled[i : i + 215] for i in range(0, 900, 215)]
    job = streams.CounterRates(spark, str(tmp_path / "state"), delay=timedelta(minutes=10))
    query = streams.start_batches(slices([as_samples(f) for f in files], SAMPLE), job, str(tmp_path / "cp"))
    query.awaitTermination()
    df = spark.createDataFrame(rows, SAMPLE)
    limit = F.lit(rows[-1][4] - timedelta(minutes=10))
    want = series.counter_rates(df, object_suffix=None).where(F.col("sample_time") <= limit)
    assert job.rates.batches() == list(range(len(files)))
    assert tuples(job.rates.appended(), *want.columns) == tuples(want)
    # Only the state that a retry may need is kept.
    assert len(job.last.batches()) == 2


def test_counter_rates_drop_what_is_too_late(spark, tmp_path):
    job = streams.CounterRates(spark, str(tmp_path), delay=timedelta(seconds=0))
    make = lambda *r: spark.createDataFrame([("n", "o", "c", None, at(f"2024-01-01 {t}"), v) for t, v in r], SAMPLE)
    job(make(("10:00:00", 10), ("10:00:10", 30)), 0)
    job(make(("10:00:05", 999), ("10:00:20", 80)), 1)
    assert [(str(r.sample_time)[-8:], str(r.counter_value)) for r in job.rates.appended().orderBy("sample_time").collect()] == [
        ("10:00:00", "0.00"), ("10:00:10", "2.00"), ("10:00:20", "5.00")]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    job = streams.CounterRates(spark, str(tmp_path), delay=timedelta(minutes=1))
    rows = sample_rows(60)
    first, second = spark.createDataFrame(rows[:30], SAMPLE), spark.createDataFrame(rows[30:], SAMPLE)
    job(first, 0)
    job(second, 1)
    before = tuples(job.rates.appended()), tuples(job.last.latest()), tuples(job.waiting.latest())
    job(second, 1)
    assert (tuples(job.rates.appended()), tuples(job.last.latest()), tuples(job.waiting.latest())) == before


def test_empty_first_batch(spark, tmp_path):
    job = streams.CounterRates(spark, str(tmp_path))
    job(spark.createDataFrame([], SAMPLE), 0)
    job(spark.createDataFrame(as_samples(sample_rows(100)), SAMPLE), 1)
    assert job.rates.appended().count() == 70


LOG = "k STRING, t TIMESTAMP, v INT, sample_date DATE"


def log_rows(rows):
    return [(k, at(t), v, at(t).date()) for k, t, v in rows]


def test_insert_new_across_batches(spark, slices, tmp_path):
    files = [
        [("a", "2024-01-01 10:00", 1), ("a", "2024-01-01 10:00", 0), ("b", "2024-01-01 10:00", 5)],
        [("a", "2024-01-01 10:00", 9), ("a", "2024-01-02 10:00", 2)],
        [("a", "2024-01-02 10:00", 1), ("c", "2024-01-01 10:00", 7), (None, "2024-01-01 10:00", 3)],
        [(None, "2024-01-01 10:00", 4)],
    ]
    job = streams.InsertNew(spark, str(tmp_path / "log"), LOG, ["k", "t"], ["v"], "sample_date")
    streams.start_batches(slices([log_rows(f) for f in files], LOG), job, str(tmp_path / "cp")).awaitTermination()
    assert tuples(job.log.rows(), "k", "t", "v") == [
        (None, at("2024-01-01 10:00"), 3), ("a", at("2024-01-01 10:00"), 0), ("a", at("2024-01-02 10:00"), 2),
        ("b", at("2024-01-01 10:00"), 5), ("c", at("2024-01-01 10:00"), 7)]
    # A repeat of an earlier batch finds what later ones wrote irrelevant.
    job(spark.createDataFrame(log_rows(files[1]), LOG), 1)
    assert job.log.rows().count() == 5


STATE = "k STRING, v INT, fixed INT, created_on TIMESTAMP, modified_on TIMESTAMP"


def test_upsert_across_batches(spark, slices, tmp_path):
    ddl = "k STRING, v INT, fixed INT, t TIMESTAMP"
    files = [
        [("a", 1, 1, at("2024-01-01")), ("b", 2, 2, at("2024-01-01")), ("b", 3, 9, at("2024-01-02"))],
        [("a", 5, 7, at("2024-01-03")), ("c", 4, 4, at("2024-01-03"))],
        [("a", 6, 8, at("2024-01-04"))],
    ]
    job = streams.Upsert(spark, str(tmp_path / "t"), STATE, ["k"], ["v"], [F.desc("t"), "v"], F.col("s.t"))
    streams.start_batches(slices(files, ddl), job, str(tmp_path / "cp")).awaitTermination()
    want = [("a", 6, 1, at("2024-01-01"), at("2024-01-04")), ("b", 3, 9, at("2024-01-02"), None), ("c", 4, 4, at("2024-01-03"), None)]
    assert tuples(job.table.current()) == want
    job(spark.createDataFrame(files[2], ddl), 2)
    assert tuples(job.table.current()) == want


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    ddl = "k STRING, v INT, fixed INT, t TIMESTAMP"
    job = streams.Upsert(spark, str(tmp_path / "t"), STATE, ["k"], ["v"], ["t"], F.col("s.t"), buckets=16)
    job(spark.createDataFrame([(f"k{i}", i, 0, at("2024-01-01")) for i in range(200)], ddl), 0)
    for batch in range(1, 5):
        job(spark.createDataFrame([("k7", batch * 100, 0, at("2024-01-02")), (None, batch, 0, at("2024-01-02"))], ddl), batch)
    changed = [b for b in range(16) if job.table._loads(b) != [0]]
    assert 1 <= len(changed) <= 2
    # The two states before the last load are kept, in case it has to be repeated.
    assert all(job.table._loads(b)[-3:] == [2, 3, 4] for b in changed)
    got = {r.k: r.v for r in job.table.current().collect()}
    assert len(got) == 201 and got["k7"] == 400 and got[None] == 4 and got["k8"] == 8


def test_upsert_of_an_empty_batch(spark, tmp_path):
    ddl = "k STRING, v INT, fixed INT, t TIMESTAMP"
    job = streams.Upsert(spark, str(tmp_path / "t"), STATE, ["k"], ["v"], ["t"], F.col("s.t"))
    job(spark.createDataFrame([("a", 1, 1, at("2024-01-01"))], ddl), 0)
    job(spark.createDataFrame([], ddl), 1)
    assert job.table.current().count() == 1


def test_restart_continues(spark, tmp_path):
    def run():
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        job = streams.InsertNew(spark, str(tmp_path / "log"), LOG, ["k", "t"], ["v"], "sample_date")
        streams.start_batches(stream, job, str(tmp_path / "cp")).awaitTermination()
        return job.log.rows()

    first, second = log_rows([("a", "2024-01-01", 1)]), log_rows([("a", "2024-01-01", 2), ("b", "2024-01-01", 3)])
    spark.createDataFrame(first, LOG).write.mode("append").parquet(str(tmp_path / "in"))
    assert run().count() == 1
    spark.createDataFrame(second, LOG).write.mode("append").parquet(str(tmp_path / "in"))
    got = run()
    assert tuples(got, "k", "v") == tuples(dedupe(spark.createDataFrame(first + second, LOG), ["k", "t"], ["v"]), "k", "v")


EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@pytest.fixture(scope="module")
def shuffled_events(spark, tmp_path_factory):
    """Events once as one file and once as 140 files, of which a batch reads 64, the oldest events in the last ones."""
    rng = random.Random(6)
    base, root = at("2024-01-01 22:00:00"), tmp_path_factory.mktemp("events")
    rows = [
        (i, base + timedelta(seconds=20 * i), rng.choice([3, 7, 40, 400 + i % 150]), rng.choice(["click", "view"]), rng.randrange(9000) / 100, None)
        for i in range(700)
    ]
    files = [rows[i : i + 5] for i in range(0, 700, 5)]
    files = rng.sample(files[12:], 128) + rng.sample(files[:12], 12)
    for name, parts in (("one", [rows]), ("many", files)):
        folder = root / name / "events.parquet"
        folder.mkdir(parents=True)
        for n, part in enumerate(parts):
            events = dict(zip(("event_id", "ts", "user_id", "event_type", "value", "props"), zip(*part, strict=True), strict=True))
            types = (pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.float64(), pa.string())
            file = folder / f"part-{n:03}.parquet"
            pq.write_table(pa.table({k: pa.array(v, t) for (k, v), t in zip(events.items(), types, strict=True)}), file)
            os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))
    return root


@pytest.mark.parametrize("name", ["stream_counter_rates", "stream_cpu_utilization", "stream_insert_new", "stream_upsert"])
def test_results_do_not_depend_on_the_order_of_files(spark, shuffled_events, name):
    one, many = (tuples(plans.QUERIES[name](spark, str(shuffled_events / folder))) for folder in ("one", "many"))
    assert len(one) > 100
    assert many == one


def test_upsert_runs_compare_with_what_is_stored(spark, tmp_path):
    ddl = "k STRING, v INT, fixed INT, t TIMESTAMP"
    job = streams.UpsertRuns(
        spark, str(tmp_path), STATE, ddl, keys=["k"], update_cols=["v"], order_by=[F.desc("t")], as_of=F.col("s.t"), buckets=4
    )
    runs = [
        [[("a", 2, 2, at("2024-01-02"))], [("a", 1, 1, at("2024-01-01")), ("b", 5, 5, at("2024-01-05"))]],
        [[("a", 3, 3, at("2024-01-03"))], [("b", 4, 4, at("2024-01-04"))]],
    ]
    for run, batches in enumerate(runs):
        for n, rows in enumerate(batches):
            job(spark.createDataFrame(rows, ddl), 2 * run + n)
        job.finish()
    job.finish()
    assert tuples(job.table.current()) == [
        ("a", 3, 2, at("2024-01-02"), at("2024-01-03")), ("b", 5, 5, at("2024-01-05"), None)]
