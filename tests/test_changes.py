"""Streams that append changes, and streams that drop copies by a bounded state."""

import random

import pytest

from fleetloom.streaming import changes, streams
from tests.conftest import at, tuples

ROW = "k INT, v STRING, t TIMESTAMP, n BIGINT"


def plain_state(rows):
    state = {}
    for k in {r[0] for r in rows}:
        alive = [r for r in rows if r[0] == k and r[1] != "gone"]
        gone = [r[3] for r in rows if r[0] == k and r[1] == "gone"]
        if alive:
            last = max(alive, key=lambda r: r[3])
            state[k] = (*last, max(gone, default=-1) > last[3])
    return sorted(state.values(), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_change_log_does_not_depend_on_the_order_of_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["a", "b", "gone"]), at(f"2024-01-{1 + i // 10:02}"), i) for i in range(200)]
    rows.append((9, "gone", at("2024-01-05"), 1000))
    for i, part in enumerate(rng.sample([rows[i::7] for i in range(7)], 7)):
        spark.createDataFrame(part, ROW).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    log = changes.ChangeLog(spark, f"{tmp_path}/log", ROW, ["k"], "n", "t", "v = 'gone'")
    assert log.current().count() == 0
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    streams.start_batches(source, log, f"{tmp_path}/checkpoint").awaitTermination()
    want = plain_state(rows)
    assert sorted(map(tuple, log.current().collect()), key=repr) == want
    assert log.changes().select("batch").distinct().count() > 1
    before = log.changes().count()
    log(spark.createDataFrame(rows[:20], ROW), 0)
    log(spark.createDataFrame(rows[:20], ROW), 0)
    removed = log.compact("2024-01-15")
    assert removed > 0 and log.changes().count() < before
    assert sorted(map(tuple, log.current().collect()), key=repr) == want
    assert log.compact("2023-01-01") == 0
    # Late changes of compacted days count by their order.
    log(spark.createDataFrame([(1, "new", at("2024-01-02"), 5000), (2, "old", at("2024-01-02"), -1)], ROW), 90)
    got = {r.k: (r.v, r.is_dropped) for r in log.current().collect()}
    assert got[1] == ("new", False) and got[2] == {r[0]: (r[1], r[4]) for r in want}[2]


def test_copies_within_the_delay_leave_one_and_state_stays_small(spark, tmp_path):
    for i in range(12):
        hour = f"2024-01-01 {i:02}"
        part = [(k, at(f"{hour}:{m:02}"), "x") for k in range(i * 50, i * 50 + 50) for m in (0, 10)]
        spark.createDataFrame(part, "k INT, t TIMESTAMP, v STRING").coalesce(1).write.parquet(f"{tmp_path}/in/{i:02}")
    late = spark.createDataFrame([(1, at("2024-01-01 00:05"), "late"), (5000, at("2024-01-01 00:06"), "late")], "k INT, t TIMESTAMP, v STRING")
    schema = "k INT, t TIMESTAMP, v STRING"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    once = changes.first_within(rows, ["k"], "t", "30 minutes")
    streams.start_files(once, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    late.coalesce(1).write.parquet(f"{tmp_path}/in/99")
    query = streams.start_files(once, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out")
    assert tuples(got, "k") == sorted([(k,) for k in range(600)], key=lambda r: str(r[0]))
    assert changes.late_rows(query) == 2
    held = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert max(held) <= 150
