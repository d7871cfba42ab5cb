"""Blocking trees over events: a user is blocked by the user at a third of its number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators import hierarchy
from fleetloom.plans.registry import Tables, query

# Process ids begin above this number: they have seven digits.
BIG = 1_000_000


def event_processes(tables: Tables) -> DataFrame:
    """One snapshot per event type and day; users seen that day are its processes, each with two threads.

    The second thread waits for nobody, for itself, for the first process or, like the first, for the
    user at a third of its number.
    """
    spid = F.col("user_id") + 1
    # User 4 of three and user 13 of four block each other: a cycle without a head.
    by = F.when(spid == 5, 14).when(spid == 14, 5).otherwise(F.floor(spid / 3))
    also = F.when(spid % 4 == 0, 0).when(spid % 4 == 1, spid).when(spid % 4 == 2, F.when(spid > 1, 1).otherwise(0)).otherwise(by)
    big = lambda c: F.when(c > 0, c + BIG).otherwise(0)
    return tables.events.select(
        F.col("event_type").alias("instance_fullname"),
        F.date_trunc("day", "ts").alias("sample_time"),
        big(spid).alias("spid"),
        F.explode(F.array(big(by), big(also))).alias("blocked"),
        F.col("event_id").alias("cpu"),
        F.concat(F.lit("select\n"), F.col("event_id").cast("string")).alias("sql_text"),
    )


# One row per process and blocker: the row of the smallest event, and no blocker before itself.
TREE_SQL = f"""
    WITH RECURSIVE seen AS (
        SELECT event_type AS instance_fullname, date_trunc('day', ts) AS sample_time, user_id + 1 AS id, event_id AS cpu,
               CASE user_id + 1 WHEN 5 THEN 14 WHEN 14 THEN 5 ELSE (user_id + 1) // 3 END AS blocker
        FROM events),
    threads AS (
        SELECT instance_fullname, sample_time, id, cpu, blocker FROM seen
        UNION ALL
        SELECT instance_fullname, sample_time, id, cpu,
               CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN id WHEN 2 THEN CASE WHEN id > 1 THEN 1 ELSE 0 END ELSE blocker END FROM seen),
    p AS (
        SELECT instance_fullname, sample_time, id + {BIG} AS spid, CASE WHEN max(blocker) > 0 THEN max(blocker) + {BIG} ELSE 0 END AS blocked,
               CASE WHEN blocker = id OR blocker = 0 THEN 0 ELSE blocker + {BIG} END AS waits,
               arg_min(cpu, (-blocker, cpu)) AS cpu
        FROM threads GROUP BY instance_fullname, sample_time, id, waits),
    tree AS (
        SELECT *, [spid] AS path FROM p h
        WHERE waits = 0 AND EXISTS (SELECT 1 FROM p c WHERE c.instance_fullname = h.instance_fullname
                                      AND c.sample_time = h.sample_time AND c.waits = h.spid)
        UNION ALL
        SELECT c.*, list_append(t.path, c.spid)
        FROM p c JOIN tree t ON c.instance_fullname = t.instance_fullname AND c.sample_time = t.sample_time
                            AND c.waits = t.spid
        WHERE c.waits > 0 AND NOT list_contains(t.path, c.spid))
"""


@query(
    "blocking_tree",
    TREE_SQL
    + """
    SELECT instance_fullname, sample_time, spid, blocked, cpu, 'select' || chr(10) || cpu AS sql_text,
           CAST(len(path) - 1 AS INTEGER) AS depth,
           array_to_string([lpad(CAST(n AS VARCHAR), 10, '0') for n in path], '/') AS path_key,
           '    ' || repeat('|         ', len(path) - 1) || CASE len(path) WHEN 1 THEN 'HEAD -  ' ELSE '|------  ' END || spid
             || ' select ' || cpu AS blocking_tree
    FROM tree
    """,
)
def blocking_tree(tables: Tables) -> DataFrame:
    """Blocking trees per event type and day."""
    return hierarchy.blocking_tree(event_processes(tables))


@query(
    "blocking_unreached",
    TREE_SQL
    + """
    SELECT instance_fullname, sample_time, spid, blocked, cpu, 'select' || chr(10) || cpu AS sql_text FROM p
    WHERE waits > 0 AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.instance_fullname = p.instance_fullname
                                      AND t.sample_time = p.sample_time AND t.spid = p.spid AND t.waits = p.waits)
    """,
)
def blocking_unreached(tables: Tables) -> DataFrame:
    """Blocked users in no tree: the cycle, what hangs below it, and blockers not seen that day."""
    return hierarchy.unreached(event_processes(tables))


# Pairs of a node and one above it; what is above itself is on a cycle.
LOOPED_SQL = """
    reach AS (
        SELECT {group}, {parent} AS above, {node} AS node FROM {edges}
        UNION
        SELECT {pairs}, r.above, e.{node} FROM {edges} e JOIN reach r ON {same} AND e.{parent} = r.node),
    looped AS (SELECT DISTINCT {group}, node FROM reach WHERE above IN (
        SELECT node FROM reach c WHERE c.node = c.above AND {of_reach}))
"""


def looped_sql(group: tuple[str, str], edges: str, node: str, parent: str) -> str:
    """Nodes on or below a cycle, as ``looped``."""
    same = lambda a, b: " AND ".join(f"{a}.{g} = {b}.{g}" for g in group)
    return LOOPED_SQL.format(
        group=", ".join(group), pairs=", ".join(f"e.{g}" for g in group), edges=edges, node=node, parent=parent,
        same=same("e", "r"), of_reach=same("c", "reach"),
    )


@query(
    "blocking_edges",
    TREE_SQL
    + ", waiting AS (SELECT * FROM p WHERE waits > 0), "
    + looped_sql(("instance_fullname", "sample_time"), "waiting", "spid", "waits")
    + """
    SELECT t.instance_fullname, t.sample_time, t.spid, t.blocked, t.cpu, 'select' || chr(10) || t.cpu AS sql_text,
           CASE WHEN max(l.node) IS NULL THEN count(*) END AS n_paths, CAST(min(len(path) - 1) AS BIGINT) AS shallowest,
           CASE WHEN max(l.node) IS NULL THEN CAST(max(len(path) - 1) AS BIGINT) END AS deepest, max(l.node) IS NOT NULL AS looped
    FROM (SELECT * FROM tree
          -- Into a cycle from below: no path without repeats, but the blocker has one.
          UNION ALL
          SELECT p.*, list_append(t.path, p.spid) FROM p JOIN tree t ON p.instance_fullname = t.instance_fullname
            AND p.sample_time = t.sample_time AND p.waits = t.spid WHERE p.waits > 0 AND list_contains(t.path, p.spid)) t
    LEFT JOIN looped l ON l.instance_fullname = t.instance_fullname AND l.sample_time = t.sample_time AND l.node = t.waits
    GROUP BY ALL
    """,
)
def blocking_edges(tables: Tables) -> DataFrame:
    """The trees' rows once per process and blocker, with the number of paths."""
    return hierarchy.blocking_edges(event_processes(tables))


def event_reports(tables: Tables) -> DataFrame:
    """Reports of blocked users; servers have the same loops, the days, and workers alternate.

    Users of the first two numbers wait for nobody and have no report. The others wait for the user at a
    third of their number, or, at every fourth event, at half of it.
    """
    spid = (F.col("user_id") + 1).cast("int")
    by = F.when(F.col("event_id") % 4 == 0, F.floor(spid / 2)).otherwise(F.floor(spid / 3)).cast("int")
    return tables.events.where(spid >= 3).select(
        F.concat(F.lit("node-"), (F.col("event_id") % 2).cast("string")).alias("instance_fullname"),
        F.date_format("ts", "yyyyMMdd").alias("monitorloop"),
        F.col("event_type").alias("databasename"),
        F.col("ts").alias("endtime"),
        F.col("event_id").alias("duration"),
        by.alias("blocking_spid"),
        (by % 2).alias("blocking_ecid"),
        spid.alias("blocked_spid"),
        (spid % 2).alias("blocked_ecid"),
        F.col("props").alias("report_xml"),
    )


REPORTS_SQL = """
    r AS (
        SELECT 'node-' || event_id % 2 AS instance_fullname, strftime(ts, '%Y%m%d') AS monitorloop,
               event_type AS databasename, ts AS endtime, event_id AS duration,
               CAST(CASE event_id % 4 WHEN 0 THEN (user_id + 1) // 2 ELSE (user_id + 1) // 3 END AS INTEGER) AS by_spid, CAST(user_id + 1 AS INTEGER) AS spid, props AS report_xml
        FROM events WHERE user_id >= 2)
"""


@query(
    "block_heads",
    f"""
    WITH {REPORTS_SQL}
    SELECT instance_fullname, monitorloop, by_spid AS spid, by_spid % 2 AS ecid FROM r
    EXCEPT
    SELECT instance_fullname, monitorloop, spid, spid % 2 FROM r
    """,
)
def block_heads(tables: Tables) -> DataFrame:
    """Blockers of each day that are not blocked that day."""
    return hierarchy.block_heads(event_reports(tables))


@query(
    "blocked_hierarchy",
    f"""
    WITH RECURSIVE {REPORTS_SQL},
    u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY instance_fullname, monitorloop, spid, by_spid
                                                     ORDER BY databasename, endtime, duration) = 1),
    h AS (SELECT instance_fullname, monitorloop, by_spid AS spid FROM u EXCEPT SELECT instance_fullname, monitorloop, spid FROM u),
    t AS (
        SELECT instance_fullname, monitorloop, spid, CAST(NULL AS INTEGER) AS by_spid, [spid] AS path FROM h
        UNION ALL
        SELECT u.instance_fullname, u.monitorloop, u.spid, u.by_spid, list_append(t.path, u.spid)
        FROM u JOIN t ON u.instance_fullname = t.instance_fullname AND u.monitorloop = t.monitorloop AND u.by_spid = t.spid
        WHERE NOT list_contains(t.path, u.spid))
    SELECT t.instance_fullname, t.monitorloop, coalesce(strftime(endtime, '%Y-%m-%d %H:%M:%S'), 'Lead') AS tracetime,
           duration, databasename,
           repeat(' ', 4 * (len(path) - 1)) || t.spid || CASE t.spid % 2 WHEN 0 THEN '' ELSE '(1)' END AS blockingtree, report_xml,
           CAST(len(path) - 1 AS INTEGER) AS level,
           '/' || array_to_string([lpad(CAST(n AS VARCHAR), 10, '0') || '.'
             || lpad(CAST(n % 2 AS VARCHAR), 10, '0') for n in path], '/') || '/' AS chain
    FROM t LEFT JOIN u ON u.instance_fullname = t.instance_fullname AND u.monitorloop = t.monitorloop AND u.spid = t.spid
                      AND u.by_spid = t.by_spid
    """,
)
def blocked_hierarchy(tables: Tables) -> DataFrame:
    """Report trees per server and day."""
    return hierarchy.blocked_hierarchy(event_reports(tables))


@query(
    "blocked_edges",
    f"""
    WITH RECURSIVE {REPORTS_SQL},
    u AS (SELECT DISTINCT instance_fullname, monitorloop, spid, by_spid FROM r),
    h AS (SELECT instance_fullname, monitorloop, by_spid AS spid FROM u EXCEPT SELECT instance_fullname, monitorloop, spid FROM u),
    t AS (
        SELECT instance_fullname, monitorloop, spid, CAST(NULL AS INTEGER) AS by_spid, 0 AS level FROM h
        UNION ALL
        SELECT u.instance_fullname, u.monitorloop, u.spid, u.by_spid, level + 1
        FROM u JOIN t ON u.instance_fullname = t.instance_fullname AND u.monitorloop = t.monitorloop AND u.by_spid = t.spid)
    SELECT instance_fullname, monitorloop, spid AS blocked_spid, spid % 2 AS blocked_ecid, by_spid AS blocking_spid,
           by_spid % 2 AS blocking_ecid, count(*) AS n_paths, CAST(min(level) AS BIGINT) AS shallowest,
           CAST(max(level) AS BIGINT) AS deepest, false AS looped
    FROM t GROUP BY ALL
    """,
)
def blocked_edges(tables: Tables) -> DataFrame:
    """Who blocks whom per server and day, with the number of paths. Blockers have smaller numbers, so there are no cycles."""
    return hierarchy.blocked_edges(event_reports(tables))
