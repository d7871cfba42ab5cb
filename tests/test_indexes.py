from pyspark.sql import functions as F

from fleetloom.operators import indexes
from fleetloom.sources import schemas
from tests.conftest import at, dec, tuples

BASE = dict(instance_fullname="n1", database_id=5)


def ix(obj, i, name="ix", kind=2, pk=False, db=5, **kw):
    return dict(BASE, object_id=obj, index_id=i, name=name, type=kind, is_primary_key=pk, type_desc="NC", database_id=db, **kw)


def use(obj, i, seeks=0, scans=0, lookups=0, updates=0, db=5, **kw):
    zero = dict(system_seeks=1, system_scans=2, system_lookups=3)
    return dict(BASE, object_id=obj, index_id=i, user_seeks=seeks, user_scans=scans, user_lookups=lookups, user_updates=updates,
                **zero, **dict(kw, database_id=db))


def test_index_usage(table):
    def part(obj, i, pages, rows, n=1, db=5):
        return dict(BASE, object_id=obj, index_id=i, partition_number=n, used_page_count=pages, row_count=rows, database_id=db)

    stats = table(schemas.PARTITION_STATS, [
        part(300, 0, 128, 10), part(301, 1, 256, 20), part(301, 2, 64, 20), part(250, 1, 999, 1), part(301, 1, 512, 7, n=2),
        part(300, 0, 128, 11, db=6)])
    named = table(schemas.INDEXES, [ix(300, 0, None), ix(301, 1), ix(301, 2), ix(250, 1), ix(300, 0, "other", db=6)])
    usage = table(schemas.INDEX_USAGE_STATS, [
        use(301, 1, seeks=1, scans=2, updates=1, last_user_scan=at("2024-01-01"), last_user_seek=at("2024-02-01")),
        use(301, 2), use(300, 0, seeks=8, db=6)])
    got = indexes.index_usage(stats, named, usage)
    cols = ("database_id", "object_id", "index_id", "partition_number", "rowscount", "rowdata_mb", "cluindex_mb", "ncluindex_mb",
            "user_reads", "sys_reads", "write_percent", "read_percent", "lastread_user")
    assert tuples(got, *cols) == [
        (5, 300, 0, 1, 10, 1.0, None, None, None, None, None, None, None),
        (5, 301, 1, 1, 20, None, 2.0, None, 3, 6, 25.0, 75.0, at("2024-01-01")),
        (5, 301, 1, 2, 7, None, 4.0, None, 3, 6, 25.0, 75.0, at("2024-01-01")),
        (5, 301, 2, 1, 20, None, None, 0.5, 0, 6, None, None, None),
        (6, 300, 0, 1, 11, 1.0, None, None, 8, 6, 0.0, 100.0, None)]


def test_unused_indexes(table):
    named = table(schemas.INDEXES, [ix(o, 2) for o in (1, 2, 3, 4)] + [ix(5, 2, pk=True), ix(6, 2, kind=1)])
    busy = dict(seeks=500)
    usage = table(schemas.INDEX_USAGE_STATS, [
        use(1, 2, seeks=200, last_user_seek=at("2024-02-01")), use(2, 2, **busy, last_user_seek=at("2024-01-31")),
        # Read by a seek today, but its last scan is old: the first kind known counts by default.
        use(3, 2, **busy, last_user_scan=at("2024-01-01"), last_user_seek=at("2024-03-01")),
        use(4, 2), use(5, 2), use(6, 2)])
    partitions = table(schemas.PARTITIONS, [dict(BASE, object_id=o, index_id=2, partition_id=o * 10, rows=o) for o in range(1, 7)])
    alloc = table(schemas.ALLOCATION_UNITS, [dict(BASE, container_id=o * 10, total_pages=499 if o == 4 else 500) for o in range(1, 7)])
    got = indexes.unused_indexes(usage, named, partitions, alloc, "2024-03-01 12:00:00")
    assert tuples(got, "object_id", "totalreads_user") == [(1, 200), (3, 500)]
    late = indexes.unused_indexes(usage, named, partitions, alloc, "2024-03-02 00:00:00")
    assert tuples(late, "object_id") == [(1,), (2,), (3,)]
    latest = indexes.unused_indexes(usage, named, partitions, alloc, "2024-03-01", last_used="greatest")
    assert tuples(latest, "object_id") == [(1,)]


def fleet(table):
    place = dict(BASE, index_id=2, partition_number=1)
    frag = {1: (2.0, 5000), 2: (29.99, 991), 3: (30.0, 991), 4: (30.01, 991), 5: (50.0, 990), 6: (50.0, 900), 7: (50.0, 2000), 8: (50.0, 2000)}
    physical = table(schemas.INDEX_PHYSICAL_STATS, [
        dict(place, object_id=o, hobt_id=o, avg_fragmentation_in_percent=f, page_count=p) for o, (f, p) in frag.items()])
    named = table(schemas.INDEXES, [
        ix(o, 2, None if o == 7 else f"ix{o}", kind=6 if o == 8 else 2, pk=o == 4, fill_factor=None if o == 2 else 80) for o in frag])
    objects = table(schemas.OBJECTS, [dict(BASE, object_id=o, schema_id=1, name=f"t{o}") for o in frag])
    schemata = table(schemas.SCHEMAS, [dict(BASE, schema_id=1, name="dbo")])
    operational = table(schemas.INDEX_OPERATIONAL_STATS, [
        dict(place, object_id=o, hobt_id=o, leaf_allocation_count=4, nonleaf_allocation_count=1, leaf_insert_count=0 if o == 3 else 8,
             nonleaf_insert_count=0, leaf_update_count=0 if o == 3 else 2, nonleaf_update_count=0, leaf_delete_count=1, nonleaf_delete_count=1,
             row_lock_count=7, row_lock_wait_count=0 if o == 3 else 3, row_lock_wait_in_ms=10, page_lock_count=1, page_lock_wait_count=2,
             page_lock_wait_in_ms=5, page_latch_wait_count=0, page_latch_wait_in_ms=9) for o in frag if o != 4])
    usage = table(schemas.INDEX_USAGE_STATS, [use(o, 2, seeks=3, updates=1) for o in frag if o != 2] + [use(2, 2, db=6)])
    return dict(physical=physical, indexes=named, objects=objects, schemas=schemata, operational=operational, usage=usage)


def test_fragmentation(table):
    got = indexes.fragmentation(**fleet(table))
    assert tuples(got, "object_id", "index_name", "schema_name", "user_reads", "write_percent", "page_splits_total",
                  "row_lock_avg_wait_ms", "page_lock_avg_wait_ms", "page_latch_avg_wait_ms") == [
        (2, "ix2", "dbo", None, None, 5, 3, 2, 9), (3, "ix3", "dbo", 3, 25.0, 5, 10, 2, 9), (8, "ix8", "dbo", 3, 25.0, 5, 3, 2, 9)]


def test_index_scope(table):
    got = indexes.index_scope(**fleet(table))
    assert tuples(got, "object_id", "write_percent", "read_percent", "pagesplit_percent", "total_inserts", "action", "online") == [
        (3, 25.0, 75.0, 0.0, 0, "REORGANIZE", None), (4, 25.0, 75.0, 0.0, 0, "REBUILD", False),
        (5, 25.0, 75.0, 50.0, 8, "REBUILD", False), (8, 25.0, 75.0, 50.0, 8, "SKIP", None)]
    assert tuples(got.where("object_id = 5"), "size_mb") == [(dec("7.73"),)]
    strict = indexes.index_scope(**fleet(table), strict=True)
    assert tuples(strict, "write_percent", "read_percent") == [(0.0, 0.0)] * 4


def test_recommended_action(short):
    df = short("avg_fragmentation_in_percent DOUBLE, type INT, is_primary_key BOOLEAN, page_count BIGINT", [
        (29.99, 2, False, 1), (30.0, 2, False, 2), (30.0, 1, True, 3), (90.0, 5, False, 4), (90.0, 6, False, 5), (30.01, 2, False, 6)])
    got = indexes.recommend_index_action(df)
    assert tuples(got, "page_count", "action", "online") == [
        (1, "REORGANIZE", None), (2, "REBUILD", True), (3, "REBUILD", False), (4, "SKIP", None), (5, "SKIP", None), (6, "REBUILD", True)]
    assert got.where("action = 'REBUILD'").count() == 3
    assert indexes.recommend_index_action(df, inclusive=False).where("action = 'REBUILD'").count() == 1
    assert tuples(indexes.index_action_summary(got), "action", "online", "indexes", "pages") == [
        ("REBUILD", False, 1, 3), ("REBUILD", True, 2, 8), ("REORGANIZE", None, 1, 1), ("SKIP", None, 2, 9)]


def rowgroup_inputs(table):
    def rg(obj, total, deleted=0, state=3, n=1):
        return dict(BASE, object_id=obj, index_id=1, partition_number=n, state=state, total_rows=total, deleted_rows=deleted)

    groups = table(schemas.ROW_GROUPS, [
        rg(1, 1000, 100), rg(2, 1000, 101), rg(3, 60000), rg(3, 60001), rg(4, 60000), rg(4, 60000), rg(5, 0), rg(6, 50000, 50000, state=1),
        rg(7, 60000, 60000)])
    parts = table(schemas.PARTITIONS, [dict(BASE, object_id=o, index_id=1, partition_number=1, hobt_id=o * 10) for o in range(1, 8)])
    dicts = table(schemas.CS_DICTIONARIES, [
        dict(BASE, hobt_id=o * 10, on_disk_size=16_000_000 if o == 4 else 15_999_999, entry_count=o) for o in range(1, 8)
    ] + [dict(BASE, hobt_id=30, on_disk_size=5, entry_count=99)])
    named = table(schemas.INDEXES, [ix(o, 1, kind=1 if o == 7 else 5) for o in range(1, 8)])
    return groups, dicts, parts, named


def test_rowgroup_quality(table):
    got = indexes.rowgroup_quality(*rowgroup_inputs(table))
    assert tuples(got, "object_id", "count_rowgroups", "totalrows", "avgrowsperrg", "underquality_rowgroups", "underquality_percent",
                  "maxdictionary_size", "maxdictionary_entrycount") == [
        (2, 1, 1000, 1000, 1, dec("100.00"), 15_999_999, 2), (3, 2, 120001, 60000, 2, dec("100.00"), 15_999_999, 99)]
    assert [round(r[0], 6) for r in tuples(got, "deletedrowspercent")] == [0.0, 10.1]
    strict = indexes.rowgroup_quality(*rowgroup_inputs(table), strict=True)
    assert tuples(strict, "underquality_percent") == [(dec("0.01"),), (dec("0.01"),)]


def test_same_index_ids_of_two_databases_do_not_mix(table):
    stats = table(schemas.PARTITION_STATS, [
        dict(BASE, object_id=300, index_id=1, partition_number=1, used_page_count=1, row_count=1, database_id=d) for d in (5, 6)])
    named = table(schemas.INDEXES, [ix(300, 1, f"ix{d}", db=d) for d in (5, 6)])
    usage = table(schemas.INDEX_USAGE_STATS, [use(300, 1, seeks=d, db=d) for d in (5, 6)])
    got = indexes.index_usage(stats, named, usage)
    assert tuples(got, "database_id", "indexname", "user_reads") == [(5, "ix5", 5), (6, "ix6", 6)]
    assert got.agg(F.count("*")).first()[0] == 2
