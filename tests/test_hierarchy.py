import random

from pyspark.sql import functions as F

from fleetloom.operators import hierarchy
from fleetloom.sources import schemas
from tests.conftest import at, tuples

GROUP = ["instance_fullname", "sample_time"]


def processes(short, edges, inst="n1", t="2024-01-01 10:00"):
    return short(
        "instance_fullname STRING, sample_time TIMESTAMP, spid INT, blocked INT, cpu INT, sql_text STRING",
        [(inst, at(t), s, b, 0, f"q{s}") for s, b in edges])


def test_tree_text_and_order(short):
    df = processes(short, [(51, 0), (52, 51), (53, 51), (60, 52), (9000, 60), (70, 0), (80, 80), (81, 80)])
    got = hierarchy.blocking_tree(df)
    lines = [r.blocking_tree for r in got.orderBy("path_key").collect()]
    assert lines == [
        "    HEAD -  51 q51",
        "    |         |------  52 q52",
        "    |         |         |------  60 q60",
        "    |         |         |         |------  9000 q9000",
        "    |         |------  53 q53",
        "    HEAD -  80 q80",
        "    |         |------  81 q81",
    ]
    assert tuples(got, "spid", "depth")[0] == (51, 0)


def test_groups_do_not_mix(short):
    df = processes(short, [(1, 0), (2, 1)]).unionByName(processes(short, [(2, 0), (3, 2)], inst="n2")).unionByName(
        processes(short, [(2, 1)], t="2024-01-01 10:01"))
    got = hierarchy.blocking_tree(df)
    assert tuples(got, "instance_fullname", "spid", "depth") == [("n1", 1, 0), ("n1", 2, 1), ("n2", 2, 0), ("n2", 3, 1)]
    assert tuples(hierarchy.unreached(df), "sample_time", "spid") == [(at("2024-01-01 10:01"), 2)]


def test_cycles_are_not_in_a_tree_but_reported(short):
    df = processes(short, [(1, 2), (2, 1), (3, 1), (4, 3), (10, 0), (11, 10), (20, 99), (21, 20)])
    assert tuples(hierarchy.blocking_tree(df), "spid") == [(10,), (11,)]
    assert tuples(hierarchy.unreached(df), "spid") == [(1,), (2,), (20,), (21,), (3,), (4,)]


def test_rows_per_thread_count_once(short):
    df = processes(short, [(1, 0), (1, 0), (2, 0), (2, 1), (2, 1)])
    assert tuples(hierarchy.blocking_tree(df), "spid", "blocked", "depth") == [(1, 0, 0), (2, 1, 1)]


def test_every_blocker_of_a_process_counts(short):
    df = processes(short, [(52, 0), (70, 0), (60, 52), (60, 70), (61, 60)])
    assert tuples(hierarchy.blocking_tree(df), "path_key") == [
        (f"{52:010d}",), (f"{52:010d}/{60:010d}",), (f"{52:010d}/{60:010d}/{61:010d}",),
        (f"{70:010d}",), (f"{70:010d}/{60:010d}",), (f"{70:010d}/{60:010d}/{61:010d}",)]
    assert hierarchy.unreached(df).count() == 0


def test_thread_that_waits_for_its_own_process(short):
    df = processes(short, [(52, 0), (60, 60), (60, 52), (61, 60)])
    assert tuples(hierarchy.blocking_tree(df), "spid", "blocked", "depth") == [
        (52, 0, 0), (60, 52, 1), (60, 60, 0), (61, 60, 1), (61, 60, 2)]


def test_cycle_below_a_head(short):
    df = processes(short, [(1, 0), (2, 1), (2, 3), (3, 2)])
    assert tuples(hierarchy.blocking_tree(df), "spid", "blocked", "depth") == [(1, 0, 0), (2, 1, 1), (3, 2, 2)]
    assert tuples(hierarchy.unreached(df), "spid", "blocked") == [(2, 3)]


def test_ids_of_seven_digits(short):
    df = processes(short, [(1000001, 0), (1000002, 1000001), (1000003, 1000001)])
    assert len(set(tuples(hierarchy.blocking_tree(df), "path_key"))) == 3


def test_newlines_and_missing_text(short):
    df = processes(short, [(1, 0), (2, 1)]).withColumn(
        "sql_text", F.when(F.col("spid") == 1, "a\r\nb"))
    assert tuples(hierarchy.blocking_tree(df), "spid", "blocking_tree") == [(1, "    HEAD -  1 a  b"), (2, None)]


def test_nothing_blocked(short):
    df = processes(short, [(1, 0), (2, 0)])
    assert hierarchy.blocking_tree(df).count() == 0 and hierarchy.unreached(df).count() == 0


def test_deep_chain_and_many_children_match_a_walk(short):
    rng = random.Random(5)
    # A chain of 300, then most processes blocked by one hot blocker, the rest at random.
    parents = {1: 0, **{i: i - 1 for i in range(2, 301)}}
    for i in range(301, 1200):
        parents[i] = 150 if rng.random() < 0.6 else rng.randrange(1, i)
    got = {r.spid: (r.depth, r.path_key) for r in hierarchy.blocking_tree(processes(short, list(parents.items()))).collect()}

    def path(i):
        return path(parents[i]) + [i] if parents[i] else [i]

    import sys
    sys.setrecursionlimit(5000)
    assert len(got) == 1199
    assert all(got[i] == (len(path(i)) - 1, "/".join(f"{n:010d}" for n in path(i))) for i in parents)


def reports(table, rows, inst="n1"):
    return table(schemas.BLOCKED_REPORTS, [
        dict(instance_fullname=inst, monitorloop=loop, blocking_spid=a, blocking_ecid=ae, blocked_spid=b, blocked_ecid=be, endtime=at("2024-01-01 10:00:01"),
             duration=5, databasename="d", report_xml="<r/>") for loop, a, ae, b, be in rows])


def test_blocked_hierarchy(table):
    df = reports(table, [("1", 9, 0, 10, 0), ("1", 9, 0, 11, 2), ("1", 10, 0, 12, 0), ("1", 9, 0, 10, 0), ("2", 10, 0, 9, 0),
                         ("3", 1, 0, 2, 0), ("3", 2, 0, 1, 0)])
    assert tuples(hierarchy.block_heads(df)) == [("n1", "1", 9, 0), ("n1", "2", 10, 0)]
    got = hierarchy.blocked_hierarchy(df).orderBy("monitorloop", "chain").collect()
    assert [(r.monitorloop, r.tracetime, r.blockingtree, r.level) for r in got] == [
        ("1", "Lead", "9", 0), ("1", "2024-01-01 10:00:01", "    10", 1), ("1", "2024-01-01 10:00:01", "        12", 2),
        ("1", "2024-01-01 10:00:01", "    11(2)", 1), ("2", "Lead", "10", 0), ("2", "2024-01-01 10:00:01", "    9", 1)]
    assert got[0].report_xml is None and got[1].duration == 5


def test_chain_orders_numbers_as_numbers(table):
    got = hierarchy.blocked_hierarchy(reports(table, [("1", 5, 0, 10, 0), ("1", 5, 0, 9, 0)])).orderBy("chain").collect()
    assert [r.blockingtree.strip() for r in got] == ["5", "9", "10"]


def test_worker_is_part_of_the_identity(table):
    got = hierarchy.blocked_hierarchy(reports(table, [("1", 5, 0, 6, 1), ("1", 6, 0, 7, 0)]))
    assert tuples(got, "blockingtree", "level") == [("    6(1)", 1), ("    7", 1), ("5", 0), ("6", 0)]


def test_servers_have_their_own_loops(table):
    df = reports(table, [("1", 5, 0, 6, 0)]).unionByName(reports(table, [("1", 4, 0, 5, 0)], inst="n2"))
    assert tuples(hierarchy.block_heads(df)) == [("n1", "1", 5, 0), ("n2", "1", 4, 0)]
    assert tuples(hierarchy.blocked_hierarchy(df), "instance_fullname", "blockingtree") == [
        ("n1", "    6"), ("n1", "5"), ("n2", "    5"), ("n2", "4")]


def test_reports_of_one_process_by_two_blockers(table):
    got = hierarchy.blocked_hierarchy(reports(table, [("unknown", 5, 0, 7, 0), ("unknown", 6, 0, 7, 0), ("unknown", 7, 0, 8, 0)]))
    assert sorted(r.blockingtree for r in got.collect()) == ["        8", "        8", "    7", "    7", "5", "6"]


def test_paths_are_counted_without_listing_them(short):
    # Thirty levels of two, each blocked by both above: 2^29 paths to each of the last.
    edges = [(1, 0), (2, 0)] + [(2 * n + a, 2 * n - 2 + b) for n in range(1, 30) for a in (1, 2) for b in (1, 2)]
    got = hierarchy.blocking_edges(processes(short, edges))
    assert got.count() == len(edges)
    last = got.where("spid = 60").orderBy("blocked").collect()
    assert [(r.blocked, r.n_paths, r.shallowest, r.deepest, r.looped) for r in last] == [(b, 2**28, 29, 29, False) for b in (57, 58)]


def test_path_counts_are_bounded(short):
    edges = [(1, 0), (2, 0)] + [(2 * n + a, 2 * n - 2 + b) for n in range(1, 70) for a in (1, 2) for b in (1, 2)]
    counts = {(r.spid, r.blocked): r.n_paths for r in hierarchy.blocking_edges(processes(short, edges)).collect()}
    assert counts[41, 39] == 2**19 and counts[139, 137] == hierarchy.MOST_PATHS


def test_counted_paths_are_those_of_the_tree(short):
    rng = random.Random(5)
    for _ in range(3):
        edges = {(n, rng.choice([0, 0, *range(1, n), 99]) if n > 1 else 0) for n in range(1, 16) for _ in range(3)}
        df = processes(short, sorted(edges)).unionByName(processes(short, [(2, 1), (1, 0)], inst="n2"))
        tree = hierarchy.blocking_tree(df).groupBy("instance_fullname", "spid", "blocked").agg(
            F.count("*"), F.min("depth"), F.max("depth"))
        # A head that also waits has one row for each; the tree shows the same.
        got = hierarchy.blocking_edges(df)
        assert tuples(got, "instance_fullname", "spid", "blocked", "n_paths", "shallowest", "deepest") == tuples(tree)


def test_paths_at_cycles_are_not_counted(short):
    df = processes(short, [(1, 0), (2, 1), (2, 3), (3, 2), (4, 3), (5, 1), (8, 9), (9, 8), (10, 99)])
    got = hierarchy.blocking_edges(df)
    assert tuples(got, "spid", "blocked", "n_paths", "shallowest", "deepest", "looped") == [
        (1, 0, 1, 0, 0, False), (2, 1, 1, 1, 1, False), (2, 3, None, 3, None, True), (3, 2, None, 2, None, True),
        (4, 3, None, 3, None, True), (5, 1, 1, 1, 1, False)]
    empty = processes(short, [])
    assert hierarchy.blocking_edges(empty).count() == 0


def test_report_edges_count_the_rows_of_the_hierarchy(short):
    rows = [("n", "1", s, 0, b, 0) for s, b in [(2, 1), (3, 1), (4, 2), (4, 3), (4, 3), (5, 4)]]
    reports = short("instance_fullname STRING, monitorloop STRING, blocked_spid INT, blocked_ecid INT, blocking_spid INT, blocking_ecid INT, duration BIGINT",
        [(*r, i) for i, r in enumerate(rows)])
    got = hierarchy.blocked_edges(reports)
    assert tuples(got, "blocked_spid", "blocking_spid", "n_paths", "shallowest", "deepest") == [
        (1, None, 1, 0, 0), (2, 1, 1, 1, 1), (3, 1, 1, 1, 1), (4, 2, 1, 2, 2), (4, 3, 1, 2, 2), (5, 4, 2, 3, 3)]


def test_a_short_cycle_does_not_add_rounds_for_every_other_node(spark, monkeypatch):
    """Rounds follow the depth and what is below the cycle, not the number of processes of the snapshot."""
    edges = [(1, n, None if n == 10 else 10) for n in range(10, 4000)] + [(1, 2, 3), (1, 3, 2), (1, 4, 3), (1, 3, 10)]
    edges += [(2, n, n - 1 if n else None) for n in range(9)]
    written = []
    keep = hierarchy.durable
    monkeypatch.setattr(hierarchy, "durable", lambda df: written.append(1) or keep(df))
    got = hierarchy.path_counts(spark.createDataFrame(edges, "g int, node int, parent int"), ["g"]).collect()
    found = {(r.g, r.node): (r.n_paths, r.shallowest, r.deepest, r.looped) for r in got}
    assert len(found) == 3990 + 3 + 9 and found[1, 10] == (1, 0, 0, False) and found[1, 3999] == (1, 1, 1, False)
    assert {n: found[1, n] for n in (2, 3, 4)} == {2: (None, 2, None, True), 3: (None, 1, None, True), 4: (None, 2, None, True)}
    assert all(found[2, n] == (1, n, n, False) for n in range(9))
    assert len(written) <= 2 + 2 * 6
