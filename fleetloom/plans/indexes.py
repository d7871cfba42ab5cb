"""Index operators over line items, orders, customers, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.operators import indexes
from fleetloom.plans.registry import Tables, query

def node() -> list[Column]:
    return [F.lit("node-1").alias("instance_fullname"), F.lit(1).alias("database_id")]


def day(base: str, days: Column) -> Column:
    return F.date_add(F.lit(base).cast("date"), days.cast("int")).cast("timestamp")


def part_usage(tables: Tables) -> DataFrame:
    """Parts as usage rows of index 2 of each table."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    zero, never = F.lit(0).cast("bigint"), F.lit(None).cast("timestamp")
    return tables.part.select(
        *node(),
        F.col("p_partkey").alias("object_id"),
        F.lit(2).alias("index_id"),
        (size * 10).cast("bigint").alias("user_seeks"),
        F.when(F.col("p_type") == "ECONOMY", 0).otherwise(size).cast("bigint").alias("user_scans"),
        zero.alias("user_lookups"),
        F.floor(price).alias("user_updates"),
        zero.alias("system_seeks"),
        size.cast("bigint").alias("system_scans"),
        zero.alias("system_lookups"),
        day("2024-01-01", size).alias("last_user_seek"),
        F.when(F.col("p_brand") != "Brand#2", day("2023-12-20", size)).alias("last_user_scan"),
        never.alias("last_user_lookup"),
        day("2024-01-05", size).alias("last_user_update"),
        never.alias("last_system_seek"),
        day("2023-06-01", size).alias("last_system_scan"),
        never.alias("last_system_lookup"),
    )


@query(
    "index_usage",
    """
    WITH s AS (
        SELECT l_partkey + 200 AS object_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS index_id,
               l_linenumber AS partition_number, sum(l_quantity) * 8 / 1024 AS mb, max(l_orderkey) AS rowscount
        FROM lineitem WHERE l_partkey + 200 > 250 GROUP BY ALL),
    u AS (SELECT s_suppkey * 3 + 251 AS object_id, s_nationkey * 3 AS reads,
                 CAST(floor(abs(s_acctbal) / 1000) AS BIGINT) AS writes,
                 CASE WHEN s_nationkey < 10 THEN TIMESTAMP '2024-01-01' + to_days(s_nationkey) END AS scan,
                 CASE WHEN s_nationkey >= 5 THEN TIMESTAMP '2024-02-01' + to_days(s_nationkey) END AS seek
          FROM supplier)
    SELECT object_id, s.index_id, partition_number, 'ix_' || p_name || s.index_id AS indexname,
           p_type AS indextype, rowscount, CASE WHEN s.index_id = 0 THEN mb END AS rowdata_mb,
           CASE WHEN s.index_id = 1 THEN mb END AS cluindex_mb, CASE WHEN s.index_id > 1 THEN mb END AS ncluindex_mb,
           CAST(reads AS BIGINT) AS user_reads, CASE WHEN reads IS NOT NULL THEN 7 END AS sys_reads, writes,
           round(writes * 100.0::DOUBLE / nullif(reads + writes, 0), 4) AS write_percent,
           round(reads * 100.0::DOUBLE / nullif(reads + writes, 0), 4) AS read_percent,
           coalesce(scan, seek) AS lastread_user, NULL::TIMESTAMP AS lastread_sys,
           CASE WHEN reads IS NOT NULL THEN TIMESTAMP '2024-03-01' END AS lastwrite_user,
           coalesce(scan, seek, CASE WHEN reads IS NOT NULL THEN TIMESTAMP '2024-03-01' END) AS lastused
    FROM s JOIN part ON p_partkey + 200 = object_id LEFT JOIN u USING (object_id)
    WHERE s.index_id < 2 AND (s.index_id = 1 OR reads IS NULL)
    UNION ALL
    SELECT object_id, s.index_id, partition_number, 'ix_' || p_name || s.index_id, p_type, rowscount, mb, NULL, NULL,
           NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM s JOIN part ON p_partkey + 200 = object_id JOIN u USING (object_id) WHERE s.index_id = 0
    """,
)
def index_usage(tables: Tables) -> DataFrame:
    """Line items as partition sizes, parts with two indexes each, suppliers as usage of some."""
    flag, nation = F.col("l_returnflag"), F.col("s_nationkey")
    stats = tables.lineitem.select(
        *node(),
        (F.col("l_partkey") + 200).alias("object_id"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("index_id"),
        F.col("l_linenumber").alias("partition_number"),
        F.col("l_quantity").cast("bigint").alias("used_page_count"),
        F.col("l_orderkey").alias("row_count"),
    )
    named = tables.part.select(
        *node(),
        (F.col("p_partkey") + 200).alias("object_id"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("index_id"),
        "p_name",
        F.col("p_type").alias("type_desc"),
    ).withColumn("name", F.concat(F.lit("ix_"), "p_name", "index_id"))
    never = F.lit(None).cast("timestamp")
    usage = tables.supplier.select(
        *node(),
        (F.col("s_suppkey") * 3 + 251).alias("object_id"),
        F.lit(1).alias("index_id"),
        nation.cast("bigint").alias("user_seeks"),
        (nation * 2).cast("bigint").alias("user_scans"),
        F.lit(0).cast("bigint").alias("user_lookups"),
        F.floor(F.abs("s_acctbal") / 1000).alias("user_updates"),
        F.lit(1).alias("system_seeks"),
        F.lit(2).alias("system_scans"),
        F.lit(4).alias("system_lookups"),
        F.when(nation >= 5, day("2024-02-01", nation)).alias("last_user_seek"),
        F.when(nation < 10, day("2024-01-01", nation)).alias("last_user_scan"),
        never.alias("last_user_lookup"),
        F.lit("2024-03-01").cast("timestamp").alias("last_user_update"),
        *[never.alias(f"last_system_{kind}") for kind in ("seek", "scan", "lookup")],
    )
    return (
        indexes.index_usage(stats, named, usage)
        .drop("instance_fullname", "database_id")
        .withColumns({c: F.round(c, 4) for c in ("write_percent", "read_percent")})
    )


@query(
    "unused_indexes",
    """
    WITH u AS (SELECT p_partkey, p_name, p_size, p_size * 10 + CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE p_size END AS reads,
                      floor(p_retailprice) AS writes,
                      CASE WHEN p_brand <> 'Brand#2' THEN TIMESTAMP '2023-12-20' ELSE TIMESTAMP '2024-01-01' END
                          + to_days(p_size) AS last_read
               FROM part WHERE p_brand <> 'Brand#1' AND p_size > 5)
    SELECT p_partkey AS object_id, p_name AS indexname, CAST(reads AS BIGINT) AS totalreads_user,
           CAST(p_size AS BIGINT) AS totalreads_sys, CAST(writes AS BIGINT) AS totalwrites_user,
           last_read AS lastread_user, TIMESTAMP '2023-06-01' + to_days(p_size) AS lastread_sys,
           TIMESTAMP '2024-01-05' + to_days(p_size) AS lastwrite_user, last_read AS lastused,
           CAST(l_quantity * 20 AS BIGINT) AS total_pages, CAST(floor(o_totalprice) AS BIGINT) AS total_rows
    FROM u JOIN orders ON o_custkey = p_partkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_quantity * 20 >= 500 AND (reads <= 200 OR date_diff('day', last_read, TIMESTAMP '2024-02-20 08:00:00') > 30)
    """,
)
def unused_indexes(tables: Tables) -> DataFrame:
    """Parts as indexes and usage, orders as their partitions, line items as allocation units."""
    named = tables.part.select(
        *node(),
        F.col("p_partkey").alias("object_id"),
        F.lit(2).alias("index_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 5, 2).otherwise(1).alias("type"),
        (F.col("p_brand") == "Brand#1").alias("is_primary_key"),
    )
    partitions = tables.orders.select(
        *node(),
        F.col("o_custkey").alias("object_id"),
        F.lit(2).alias("index_id"),
        F.col("o_orderkey").alias("partition_id"),
        F.floor("o_totalprice").alias("rows"),
    )
    alloc = tables.lineitem.select(
        *node(), F.col("l_orderkey").alias("container_id"), (F.col("l_quantity") * 20).cast("bigint").alias("total_pages")
    )
    return indexes.unused_indexes(
        part_usage(tables), named, partitions, alloc, as_of="2024-02-20 08:00:00"
    ).drop("instance_fullname", "database_id", "index_id")


def index_fleet(tables: Tables) -> dict[str, DataFrame]:
    """Orders as physical statistics, customers as tables with five indexes, nations as schemas."""
    place = [
        *node(),
        F.col("o_custkey").alias("object_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("index_id"),
        F.lit(1).alias("partition_number"),
    ]
    physical = tables.orders.select(
        *place,
        F.col("o_orderkey").alias("hobt_id"),
        (F.floor("o_totalprice") / 5000).alias("avg_fragmentation_in_percent"),
        F.floor(F.col("o_totalprice") / 250).alias("page_count"),
    )
    index_id, nation = F.col("index_id"), F.col("c_nationkey")
    per_index = tables.customer.withColumn("index_id", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])))
    named = per_index.select(
        *node(),
        F.col("c_custkey").alias("object_id"),
        "index_id",
        F.when(index_id != 5, F.concat(F.lit("ix"), index_id)).alias("name"),
        (index_id + 2).alias("type"),
        (index_id == 1).alias("is_primary_key"),
        F.when(nation != 3, nation).alias("fill_factor"),
    )
    objects = tables.customer.select(
        *node(), F.col("c_custkey").alias("object_id"), nation.alias("schema_id"), F.col("c_name").alias("name")
    )
    schemas = tables.nation.where(F.col("n_nationkey") != 0).select(
        *node(), F.col("n_nationkey").alias("schema_id"), F.col("n_name").alias("name")
    )
    never = F.lit(None).cast("timestamp")
    usage = per_index.where(F.col("c_mktsegment") != "BUILDING").select(
        *node(),
        F.col("c_custkey").alias("object_id"),
        "index_id",
        nation.cast("bigint").alias("user_seeks"),
        F.lit(0).cast("bigint").alias("user_scans"),
        F.lit(0).cast("bigint").alias("user_lookups"),
        (nation * (index_id - 1)).cast("bigint").alias("user_updates"),
        index_id.cast("bigint").alias("system_seeks"),
        F.lit(0).cast("bigint").alias("system_scans"),
        F.lit(0).cast("bigint").alias("system_lookups"),
        *[never.alias(f"last_{who}_{kind}") for who in ("user", "system") for kind in ("seek", "scan", "lookup")],
        never.alias("last_user_update"),
    )
    quantity, waits = F.sum("l_quantity").cast("bigint"), F.count_if(F.col("l_returnflag") == "R")
    per_order = tables.lineitem.groupBy("l_orderkey").agg(
        quantity.alias("q"), waits.alias("w"), F.count_if(F.col("l_linestatus") == "O").alias("o")
    )
    number = F.lit(0).cast("bigint")
    operational = (
        tables.orders.select(*place, F.col("o_orderkey").alias("hobt_id"))
        .join(per_order, F.col("hobt_id") == F.col("l_orderkey"))
        .select(
            "instance_fullname",
            "database_id",
            "object_id",
            "index_id",
            "partition_number",
            "hobt_id",
            F.col("q").alias("leaf_allocation_count"),
            F.col("w").alias("nonleaf_allocation_count"),
            F.col("w").alias("leaf_insert_count"),
            number.alias("nonleaf_insert_count"),
            F.col("o").alias("leaf_update_count"),
            number.alias("nonleaf_update_count"),
            F.col("o").alias("leaf_delete_count"),
            F.col("w").alias("nonleaf_delete_count"),
            F.col("q").alias("row_lock_count"),
            F.col("w").alias("row_lock_wait_count"),
            F.col("q").alias("row_lock_wait_in_ms"),
            F.col("w").alias("page_lock_count"),
            F.col("o").alias("page_lock_wait_count"),
            F.col("q").alias("page_lock_wait_in_ms"),
            number.alias("page_latch_wait_count"),
            F.col("q").alias("page_latch_wait_in_ms"),
        )
    )
    return {
        "physical": physical,
        "indexes": named,
        "objects": objects,
        "schemas": schemas,
        "usage": usage,
        "operational": operational,
    }


INDEX_FLEET_SQL = """
    p AS (SELECT o_orderkey, o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS ix,
                 floor(o_totalprice) / 5000 AS frag, CAST(floor(o_totalprice / 250) AS BIGINT) AS pages FROM orders),
    o AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) FILTER (l_returnflag = 'R') AS w,
                 count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1),
    t AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> 0)
"""


@query(
    "fragmentation",
    f"""
    WITH {INDEX_FLEET_SQL}
    SELECT o_custkey AS object_id, ix AS index_id, n_name AS schema_name, c_name AS table_name, 'ix' || ix AS index_name,
           frag AS avg_fragmentation_in_percent, ix + 2 AS type, ix = 1 AS is_primary_key,
           CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS fill_factor, pages AS page_count,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS BIGINT) END AS user_reads,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(ix AS BIGINT) END AS system_reads,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN round((ix - 1) * 100.0::DOUBLE / ix, 4) END AS write_percent,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN round(100.0::DOUBLE / ix, 4) END AS read_percent,
           q + w AS page_splits_total, q AS row_lock_count,
           q // CASE w WHEN 0 THEN 1 ELSE w END AS row_lock_avg_wait_ms, w AS page_lock_count,
           q // CASE o.o WHEN 0 THEN 1 ELSE o.o END AS page_lock_avg_wait_ms, q AS page_latch_avg_wait_ms
    FROM p JOIN t ON o_custkey = c_custkey JOIN o ON l_orderkey = o_orderkey
    WHERE ix <> 5 AND frag > 2 AND pages > 990
    """,
)
def fragmentation(tables: Tables) -> DataFrame:
    """Fragmented order 'indexes' with waits taken from their line items."""
    fleet = index_fleet(tables)
    return (
        indexes.fragmentation(**fleet)
        .drop("instance_fullname", "database_id", "partition_number")
        .withColumns({c: F.round(c, 4) for c in ("write_percent", "read_percent")})
    )


def scope_sql(write: str, read: str) -> str:
    return f"""
    WITH {INDEX_FLEET_SQL},
    a AS (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS ix,
                 CAST(sum(q + w) AS BIGINT) AS splits,
                 coalesce(round(sum(q + w) * 100.0::DOUBLE / nullif(sum(w + o.o), 0), 4), 0) AS split_pct,
                 CAST(sum(w) AS BIGINT) AS ins, CAST(sum(o.o) AS BIGINT) AS upd, CAST(sum(o.o + w) AS BIGINT) AS del
          FROM orders JOIN o ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT p.o_custkey AS object_id, p.ix AS index_id, n_name AS schema_name, c_name AS table_name,
           'ix' || p.ix AS index_name, round(pages * 8 / 1024.0::DOUBLE, 2) AS size_mb, frag AS avg_fragmentation_in_percent,
           p.ix + 2 AS type, p.ix = 1 AS is_primary_key, CASE WHEN c_nationkey <> 3 THEN c_nationkey ELSE 0 END AS fill_factor,
           pages AS page_count, CAST(c_nationkey AS BIGINT) AS user_reads, CAST(p.ix AS BIGINT) AS system_reads,
           {write} AS write_percent, {read} AS read_percent, coalesce(splits, 0) AS total_pagesplits,
           coalesce(split_pct, 0) AS pagesplit_percent, coalesce(ins, 0) AS total_inserts, coalesce(upd, 0) AS total_updates,
           coalesce(del, 0) AS total_deletes,
           CASE WHEN p.ix = 3 THEN 'SKIP' WHEN p.ix + 2 IN (5, 6) THEN 'SKIP' WHEN frag > 30 THEN 'REBUILD' ELSE 'REORGANIZE' END
               AS action,
           CASE WHEN p.ix + 2 NOT IN (5, 6) AND frag > 30 THEN FALSE END AS online
    FROM p JOIN t ON p.o_custkey = c_custkey LEFT JOIN a ON a.o_custkey = p.o_custkey AND a.ix = p.ix
    WHERE p.ix <> 5 AND frag > 2 AND pages > 900 AND c_mktsegment <> 'BUILDING'
    """


def _scope(tables: Tables, strict: bool) -> DataFrame:
    fleet = index_fleet(tables)
    return (
        indexes.index_scope(**fleet, strict=strict)
        .drop("instance_fullname", "database_id", "partition_number")
        .withColumns({c: F.round(c, 4) for c in ("write_percent", "read_percent", "pagesplit_percent")})
        .withColumn("size_mb", F.col("size_mb").cast("double"))
    )


@query("index_scope", scope_sql("round((p.ix - 1) * 100.0::DOUBLE / p.ix, 4)", "round(100.0::DOUBLE / p.ix, 4)"))
def index_scope(tables: Tables) -> DataFrame:
    """Maintenance scope over the order 'indexes'."""
    return _scope(tables, strict=False)


@query(
    "index_scope_strict",
    scope_sql("CASE WHEN p.ix = 1 THEN 0.0 ELSE 100.0 END::DOUBLE", "CASE WHEN p.ix = 1 THEN 100.0 ELSE 0.0 END::DOUBLE"),
)
def index_scope_strict(tables: Tables) -> DataFrame:
    """The same scope with whole-number shares."""
    return _scope(tables, strict=True)


def line_candidates(tables: Tables) -> DataFrame:
    return tables.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(F.col("l_discount") * 500).alias("avg_fragmentation_in_percent"),
        F.col("l_linenumber").alias("type"),
        (F.col("l_returnflag") == "R").alias("is_primary_key"),
        F.col("l_quantity").cast("bigint").alias("page_count"),
    )


INDEX_ACTION_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 500) AS avg_fragmentation_in_percent,
           l_linenumber AS type, l_returnflag = 'R' AS is_primary_key, CAST(l_quantity AS BIGINT) AS page_count,
           CASE WHEN l_linenumber IN (5, 6) THEN 'SKIP' WHEN round(l_discount * 500) >= 30 THEN 'REBUILD'
                ELSE 'REORGANIZE' END AS action,
           CASE WHEN l_linenumber NOT IN (5, 6) AND round(l_discount * 500) >= 30 THEN l_returnflag <> 'R' END AS online
    FROM lineitem
"""


@query("index_action", INDEX_ACTION_SQL)
def index_action(tables: Tables) -> DataFrame:
    """Recommended action per line item, discount standing for fragmentation."""
    return indexes.recommend_index_action(line_candidates(tables))


@query(
    "index_action_summary",
    f"SELECT action, online, count(*) AS indexes, CAST(sum(page_count) AS BIGINT) AS pages FROM ({INDEX_ACTION_SQL}) GROUP BY ALL",
)
def index_action_summary(tables: Tables) -> DataFrame:
    """Recommended actions counted."""
    return indexes.index_action_summary(indexes.recommend_index_action(line_candidates(tables)))


def rowgroup_sql(under: str) -> str:
    return f"""
    WITH a AS (
        SELECT l_partkey, l_linenumber, count(*) AS n, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS total,
               count(*) FILTER (floor(l_extendedprice) < 50000) AS small, CAST(sum(l_quantity * 100) AS BIGINT) AS deleted,
               count(*) FILTER (l_quantity > 0) AS touched
        FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
    d AS (
        SELECT l_partkey, l_linenumber, CAST(max(floor(o_totalprice * 100)) AS BIGINT) AS size, max(o_custkey) AS entries
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT l_partkey AS object_id, l_linenumber AS partition_number, p_name AS indexname, n AS count_rowgroups,
           total AS totalrows, total // n AS avgrowsperrg, small AS underquality_rowgroups,
           {under} AS underquality_percent, round(deleted * 100.0::DOUBLE / total, 4) AS deletedrowspercent,
           touched AS rowgroupswithdeletedrows, size AS maxdictionary_size, entries AS maxdictionary_entrycount
    FROM a JOIN d USING (l_partkey, l_linenumber) JOIN part ON p_partkey = l_partkey
    WHERE p_size BETWEEN 5 AND 6
      AND (deleted * 100.0::DOUBLE / total > 10 OR (total // n < 50000 AND total > 50000 AND size < 16000000))
    """


def _rowgroups(tables: Tables, strict: bool) -> DataFrame:
    place = [*node(), F.col("l_partkey").alias("object_id"), F.col("l_linenumber").alias("partition_number")]
    rowgroups = tables.lineitem.select(
        *place,
        F.lit(1).alias("index_id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(3).alias("state"),
        F.floor("l_extendedprice").alias("total_rows"),
        (F.col("l_quantity") * 100).cast("bigint").alias("deleted_rows"),
    )
    dictionaries = tables.orders.select(
        *node(),
        F.col("o_orderkey").alias("hobt_id"),
        F.floor(F.col("o_totalprice") * 100).alias("on_disk_size"),
        F.col("o_custkey").alias("entry_count"),
    )
    partitions = tables.lineitem.select(*place, F.col("l_orderkey").alias("hobt_id"))
    named = tables.part.select(
        *node(),
        F.col("p_partkey").alias("object_id"),
        F.lit(1).alias("index_id"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("type"),
    )
    return (
        indexes.rowgroup_quality(rowgroups, dictionaries, partitions, named, quality=50000, strict=strict)
        .drop("instance_fullname", "database_id", "index_id", "maxpartition_number")
        .withColumn("underquality_percent", F.col("underquality_percent").cast("double"))
        .withColumn("deletedrowspercent", F.round("deletedrowspercent", 4))
    )


@query("rowgroup_quality", rowgroup_sql("round(small * 100.0::DOUBLE / n, 2)"))
def rowgroup_quality(tables: Tables) -> DataFrame:
    """Line items as row groups of parts, orders as dictionaries."""
    return _rowgroups(tables, strict=False)


@query("rowgroup_quality_strict", rowgroup_sql("round(small / (n * 100.0::DOUBLE), 2)"))
def rowgroup_quality_strict(tables: Tables) -> DataFrame:
    """The same with the share of small groups divided by a hundred."""
    return _rowgroups(tables, strict=True)
