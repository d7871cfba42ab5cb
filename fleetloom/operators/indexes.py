"""Index health: usage, unused indexes, fragmentation, scope report, row groups, recommended action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import times
from fleetloom.functions.times import AsOf

DATABASE = ["instance_fullname", "database_id"]
INDEX = [*DATABASE, "object_id", "index_id"]
COLUMNSTORE_TYPES = [5, 6]


def _total(*names: str) -> Column:
    total = F.col(names[0])
    for name in names[1:]:
        total = total + F.col(name)
    return total


USER_READS = ("user_scans", "user_seeks", "user_lookups")
SYSTEM_READS = ("system_scans", "system_seeks", "system_lookups")


def _share(part: Column, whole: Column) -> Column:
    """Percentage, NULL of nothing."""
    return F.try_divide(part.cast("double"), whole) * 100


def _last_read(kind: str, pick: str = "first") -> Column:
    """Time of the last scan, or seek, or lookup: the first one known, or with ``greatest`` the latest."""
    times_of = [f"last_{kind}_{action}" for action in ("scan", "seek", "lookup")]
    return F.greatest(*times_of) if pick == "greatest" else F.coalesce(*times_of)


def _last_used(pick: str = "first") -> Column:
    names = [
        "last_user_scan",
        "last_user_seek",
        "last_user_lookup",
        "last_user_update",
        "last_system_scan",
        "last_system_seek",
        "last_system_lookup",
    ]
    return F.greatest(*names) if pick == "greatest" else F.coalesce(*names)


def index_usage(part_stats: DataFrame, indexes: DataFrame, usage: DataFrame) -> DataFrame:
    """Size, reads, writes and last use of every index partition of user tables."""
    mb = F.col("used_page_count") * 8 / 1024
    sizes = (
        part_stats.where(F.col("object_id") > 250)
        .groupBy(*INDEX, "partition_number")
        .agg(
            F.sum(F.when(F.col("index_id") == 0, mb)).alias("rowdata_mb"),
            F.sum(F.when(F.col("index_id") == 1, mb)).alias("cluindex_mb"),
            F.sum(F.when(F.col("index_id") > 1, mb)).alias("ncluindex_mb"),
            F.max("row_count").alias("rowscount"),
        )
    )
    named = indexes.select(*INDEX, F.col("name").alias("indexname"), F.col("type_desc").alias("indextype"))
    reads, writes = _total(*USER_READS), F.col("user_updates")
    return (
        sizes.join(named, INDEX)
        .join(usage, INDEX, "left")
        .select(
            *INDEX,
            "partition_number",
            "indexname",
            "indextype",
            "rowscount",
            "rowdata_mb",
            "cluindex_mb",
            "ncluindex_mb",
            reads.alias("user_reads"),
            _total(*SYSTEM_READS).alias("sys_reads"),
            writes.alias("writes"),
            _share(writes, reads + writes).alias("write_percent"),
            _share(reads, reads + writes).alias("read_percent"),
            _last_read("user").alias("lastread_user"),
            _last_read("system").alias("lastread_sys"),
            F.col("last_user_update").alias("lastwrite_user"),
            _last_used().alias("lastused"),
        )
    )


def unused_indexes(
    usage: DataFrame,
    indexes: DataFrame,
    partitions: DataFrame,
    alloc: DataFrame,
    as_of: AsOf,
    max_reads: int = 200,
    idle_days: int = 30,
    min_pages: int = 500,
    last_used: str = "first",
) -> DataFrame:
    """Secondary indexes of some size that are hardly read, or were not read for long.

    ``last_used='greatest'`` judges by the latest read instead of the first kind of read known.
    """
    reads, last_read = _total(*USER_READS), _last_read("user", last_used)
    idle = F.datediff(F.to_date(times.as_of_time(as_of)), F.to_date(last_read)) > idle_days
    secondary = indexes.where(~F.col("is_primary_key") & (F.col("type") > 1)).select(
        *INDEX, F.col("name").alias("indexname")
    )
    spans = partitions.select(*INDEX, F.col("partition_id").alias("container_id"), F.col("rows").alias("total_rows"))
    pages = alloc.where(F.col("total_pages") >= min_pages).select(*DATABASE, "container_id", "total_pages")
    return (
        usage.where((reads <= max_reads) | idle)
        .join(secondary, INDEX)
        .join(spans, INDEX)
        .join(pages, [*DATABASE, "container_id"])
        .select(
            *INDEX,
            "indexname",
            reads.alias("totalreads_user"),
            _total(*SYSTEM_READS).alias("totalreads_sys"),
            F.col("user_updates").alias("totalwrites_user"),
            last_read.alias("lastread_user"),
            _last_read("system", last_used).alias("lastread_sys"),
            F.col("last_user_update").alias("lastwrite_user"),
            _last_used(last_used).alias("lastused"),
            "total_pages",
            "total_rows",
        )
    )


def _candidates(
    physical: DataFrame, indexes: DataFrame, objects: DataFrame, schemas: DataFrame, min_pages: int, min_frag: float
) -> DataFrame:
    """Named, large and fragmented indexes with their table and schema."""
    tables = objects.select(*DATABASE, "object_id", "schema_id", F.col("name").alias("table_name")).join(
        schemas.select(*DATABASE, "schema_id", F.col("name").alias("schema_name")), [*DATABASE, "schema_id"]
    )
    named = indexes.where(F.col("name").isNotNull()).select(
        *INDEX, F.col("name").alias("index_name"), "type", "is_primary_key", "fill_factor"
    )
    return (
        physical.where((F.col("avg_fragmentation_in_percent") > min_frag) & (F.col("page_count") > min_pages))
        .join(named, INDEX)
        .join(tables.drop("schema_id"), [*DATABASE, "object_id"])
    )


def _mean_wait(kind: str) -> Column:
    """Whole milliseconds per wait."""
    return F.expr(f"{kind}_wait_in_ms div if({kind}_wait_count = 0, 1, {kind}_wait_count)")


def fragmentation(
    physical: DataFrame,
    indexes: DataFrame,
    objects: DataFrame,
    schemas: DataFrame,
    operational: DataFrame,
    usage: DataFrame,
    min_pages: int = 990,
    min_frag: float = 2,
) -> DataFrame:
    """Fragmented indexes with their use, page splits and mean lock and latch waits.

    Operational statistics taken several times are added up first, so a candidate meets one row of its partition.
    """
    reads, writes = _total(*USER_READS), F.col("user_updates")
    place = [*INDEX, "partition_number", "hobt_id"]
    counted = [
        "leaf_allocation_count", "nonleaf_allocation_count",
        *[f"{kind}{what}" for kind in ("row_lock", "page_lock") for what in ("_count", "_wait_count", "_wait_in_ms")],
        "page_latch_wait_count", "page_latch_wait_in_ms",
    ]
    operational = operational.groupBy(*place).agg(*[F.sum(c).alias(c) for c in counted])
    return (
        _candidates(physical, indexes, objects, schemas, min_pages, min_frag)
        .join(operational, place)
        .join(usage, INDEX, "left")
        .select(
            *INDEX,
            "partition_number",
            "schema_name",
            "table_name",
            "index_name",
            "avg_fragmentation_in_percent",
            "type",
            "is_primary_key",
            "fill_factor",
            "page_count",
            reads.alias("user_reads"),
            _total(*SYSTEM_READS).alias("system_reads"),
            _share(writes, reads + writes).alias("write_percent"),
            _share(reads, reads + writes).alias("read_percent"),
            _total("leaf_allocation_count", "nonleaf_allocation_count").alias("page_splits_total"),
            "row_lock_count",
            _mean_wait("row_lock").alias("row_lock_avg_wait_ms"),
            "page_lock_count",
            _mean_wait("page_lock").alias("page_lock_avg_wait_ms"),
            _mean_wait("page_latch").alias("page_latch_avg_wait_ms"),
        )
    )


def index_scope(
    physical: DataFrame,
    indexes: DataFrame,
    objects: DataFrame,
    schemas: DataFrame,
    usage: DataFrame,
    operational: DataFrame,
    min_pages: int = 900,
    min_frag: float = 2,
    strict: bool = False,
) -> DataFrame:
    """Maintenance scope: fragmented indexes in use, their read, write and page-split shares, and the action.

    ``strict`` computes the shares the way whole-number arithmetic does: each becomes 0 or 100.
    """

    def known(names: tuple[str, ...]) -> Column:
        return sum((F.coalesce(F.col(n), F.lit(0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0)))

    reads, writes = known(USER_READS), F.coalesce(F.col("user_updates"), F.lit(0))

    def share(part: Column, rounded: bool) -> Column:
        fraction = F.coalesce(F.try_divide(part.cast("double"), reads + writes), F.lit(0.0))
        if strict:
            fraction = F.round(fraction) if rounded else F.floor(fraction)
        return (fraction * 100).cast("double")

    inserts = _total("leaf_insert_count", "nonleaf_insert_count")
    updates = _total("leaf_update_count", "nonleaf_update_count")
    splits = known(("leaf_allocation_count", "nonleaf_allocation_count"))
    place = [*INDEX, "partition_number"]
    counted = ("leaf_insert", "nonleaf_insert", "leaf_update", "nonleaf_update", "leaf_delete", "nonleaf_delete", "leaf_allocation", "nonleaf_allocation")
    # One row per index partition, however often its statistics were taken: a candidate meets at most one.
    summed = operational.groupBy(*place).agg(*[F.sum(f"{c}_count").alias(f"{c}_count") for c in counted])
    activity = summed.select(
        *place,
        splits.alias("total_pagesplits"),
        (F.coalesce(F.try_divide(splits.cast("double"), inserts + updates), F.lit(0.0)) * 100).alias("pagesplit_percent"),
        inserts.alias("total_inserts"),
        updates.alias("total_updates"),
        _total("leaf_delete_count", "nonleaf_delete_count").alias("total_deletes"),
    )
    measured = ["total_pagesplits", "pagesplit_percent", "total_inserts", "total_updates", "total_deletes"]
    scoped = (
        _candidates(physical, indexes, objects, schemas, min_pages, min_frag)
        .join(usage, INDEX)
        .join(activity, place, "left")
        .select(
            *place,
            "schema_name",
            "table_name",
            "index_name",
            (F.col("page_count") * 8 / 1024.0).cast("decimal(18,2)").alias("size_mb"),
            "avg_fragmentation_in_percent",
            "type",
            "is_primary_key",
            F.coalesce("fill_factor", F.lit(0)).alias("fill_factor"),
            "page_count",
            reads.alias("user_reads"),
            known(SYSTEM_READS).alias("system_reads"),
            share(writes, rounded=True).alias("write_percent"),
            share(reads, rounded=False).alias("read_percent"),
            *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measured],
        )
    )
    return recommend_index_action(scoped, inclusive=False, online_allowed=False)


def recommend_index_action(
    candidates: DataFrame, threshold: float = 30, inclusive: bool = True, online_allowed: bool = True
) -> DataFrame:
    """Rebuild heavily fragmented indexes, reorganize the others, leave columnstore alone.

    ``online`` tells whether a rebuild may run online (not for primary keys); NULL for other actions.
    """
    fragmented = F.col("avg_fragmentation_in_percent")
    heavy = fragmented >= threshold if inclusive else fragmented > threshold
    action = (
        F.when(F.col("type").isin(COLUMNSTORE_TYPES), "SKIP").when(heavy, "REBUILD").otherwise("REORGANIZE")
    )
    return candidates.withColumn("action", action).withColumn(
        "online", F.when(F.col("action") == "REBUILD", ~F.col("is_primary_key") & F.lit(online_allowed))
    )


def index_action_summary(recommended: DataFrame) -> DataFrame:
    """Number of indexes and pages per action."""
    return recommended.groupBy("action", "online").agg(
        F.count(F.lit(1)).alias("indexes"), F.sum("page_count").alias("pages")
    )


def rowgroup_quality(
    rowgroups: DataFrame,
    dictionaries: DataFrame,
    partitions: DataFrame,
    indexes: DataFrame,
    quality: int = 100420,
    deleted_pct: float = 10,
    max_dictionary: int = 16_000_000,
    strict: bool = False,
) -> DataFrame:
    """Columnstore partitions worth rebuilding: many deleted rows, or small row groups without need.

    ``strict`` divides the share of small row groups by a hundred instead of multiplying.
    """
    small = F.count_if(F.col("total_rows") < quality)
    groups = F.count(F.lit(1))
    under = small / (groups * 100) if strict else small * 100 / groups
    place = [*DATABASE, "object_id", "partition_number"]
    stats = (
        rowgroups.where(F.col("state") == 3)
        .groupBy(*place, "index_id")
        .agg(
            groups.alias("count_rowgroups"),
            F.sum("total_rows").alias("totalrows"),
            F.expr("sum(total_rows) div count(total_rows)").alias("avgrowsperrg"),
            small.alias("underquality_rowgroups"),
            under.cast("decimal(5,2)").alias("underquality_percent"),
            (F.try_divide(F.sum("deleted_rows").cast("double"), F.sum("total_rows")) * 100).alias("deletedrowspercent"),
            F.count_if(F.col("deleted_rows") > 0).alias("rowgroupswithdeletedrows"),
        )
    )
    # Reduced per storage unit first, so the join and the second sum see one row each.
    biggest = (
        dictionaries.groupBy(*DATABASE, "hobt_id")
        .agg(F.max("on_disk_size").alias("_size"), F.max("entry_count").alias("_entries"))
        .join(partitions.select(*place, "hobt_id"), [*DATABASE, "hobt_id"])
        .groupBy(*place)
        .agg(
            F.max("_size").alias("maxdictionary_size"),
            F.max("_entries").alias("maxdictionary_entrycount"),
            F.max("partition_number").alias("maxpartition_number"),
        )
    )
    columnstore = indexes.where(F.col("type").isin(COLUMNSTORE_TYPES)).select(
        *INDEX, F.col("name").alias("indexname")
    )
    poor = (F.col("deletedrowspercent") > deleted_pct) | (
        (F.col("avgrowsperrg") < quality)
        & (F.col("totalrows") > quality)
        & (F.col("maxdictionary_size") < max_dictionary)
    )
    return stats.join(biggest, place).where(poor).join(columnstore, INDEX)
