"""Who blocks whom: trees of blocked processes, of any depth and any number of snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.durable import discard, durable
from fleetloom.functions.ordered import first_per_key
from fleetloom.functions.text import one_line

# Pieces of the tree text.
TREE_MARGIN = "    "
TREE_STEP = "|         "
TREE_HEAD = "HEAD -  "
TREE_BRANCH = "|------  "
# End of the fixed values.

# Digits of the largest 32-bit process id: ids are padded to that, longer ones stay as they are.
ID_WIDTH = 10


def _padded(number: Column) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(ID_WIDTH), F.length(text)), F.lit("0"))


# Path counts stop here: so many stands for so many or more.
MOST_PATHS = 10**18

# Loop numbers count per server.
LOOP = ("instance_fullname", "monitorloop")


def paths_from_root(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every path from a root to a node, as ``node`` and ``path``.

    ``edges`` has ``node`` and ``parent`` (NULL for roots), each pair once within ``group``; a node may have
    several parents, and has a path by each. Each round joins a path with all that lead to the node it begins
    below, so paths double in length per round and the number of rounds is the logarithm of the depth. A path
    that meets itself is left out, and one below a missing node finds nothing to join: what lies only on or
    below a cycle or a missing node has no result row. A round writes only the paths it made longer.
    """
    above = F.col("_above")
    latest = durable(edges.select(*group, "node", F.col("parent").alias("_above"), F.array("node").alias("path")))
    finished, unfinished = [latest.where(above.isNull())], latest.where(above.isNotNull())
    while not unfinished.isEmpty():
        known = reduce(DataFrame.unionByName, [*finished, unfinished])
        upper = known.select(*group, F.col("node").alias("_above"), F.col("path").alias("_upper"), above.alias("_next"))
        # A blocker with very many blocked nodes is a hot key on one side only: the run-time skew
        # split of the join applies.
        longer = unfinished.join(upper, [*group, "_above"]).where(~F.arrays_overlap("_upper", "path"))
        latest = durable(
            longer.select(*group, "node", F.col("_next").alias("_above"), F.concat("_upper", "path").alias("path"))
        )
        finished.append(latest.where(above.isNull()))
        unfinished = latest.where(above.isNotNull())
    return reduce(DataFrame.unionByName, finished).select(*group, "node", "path")


def _bounded_sum(*counts: str) -> Column:
    """Sum over a group of products of path counts, up to MOST_PATHS; products of two of them fit a decimal."""
    product = reduce(lambda a, b: a * b, [F.col(c).cast("decimal(19,0)") for c in counts])
    most = F.lit(MOST_PATHS).cast("decimal(19,0)")
    return F.least(F.sum(F.least(product, most).cast("decimal(19,0)")), most).cast("bigint")


def path_counts(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """How many paths lead from roots to each node, without listing them: ``node, n_paths, shallowest, deepest, looped``.

    ``edges`` is that of :func:`paths_from_root`. A node without a path from a root has no row. For one on or below a cycle that has
    (``looped``) paths and greatest depth are not counted and NULL. 10^18 paths stand for that many or more.

    Walks of 2^k edges between two nodes are counted from those of half the length, so there are as many rounds as the
    logarithm of the depth, or of the walks that are left in a group, if it has a cycle. A node of a tree has one ancestor at any
    distance, so tables of walks are not larger than that of edges there; elsewhere they have a row per node and ancestor at that distance.
    """
    keys = [*group, "node"]
    roots = edges.where(F.col("parent").isNull()).select(*keys).distinct()
    reached = roots.select(
        *keys, F.lit(1).cast("bigint").alias("n_paths"), F.lit(0).cast("bigint").alias("shallowest"), F.lit(0).cast("bigint").alias("deepest")
    )
    reached = durable(reached)
    present = edges.select(*group, F.col("node").alias("parent")).distinct()
    steps = edges.where(F.col("parent").isNotNull()).join(present, [*group, "parent"], "left_semi")
    walks = durable(steps.select(*group, F.col("parent").alias("above"), "node", F.lit(1).cast("bigint").alias("walks")))
    length, least = 1, None
    while True:
        most = walks.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        # What lies at this length or beyond on a longer walk ends one of this length, of which a group has so many at most:
        # with more edges than that on top, a walk has been on a cycle.
        least = length + most if least is None else min(least, length + most)
        if not most or length >= least:
            break
        further = reached.withColumnRenamed("node", "above").join(walks, [*group, "above"])
        longer = further.groupBy(*keys).agg(
            _bounded_sum("n_paths", "walks").alias("n_paths"),
            (F.min("shallowest") + length).alias("shallowest"),
            (F.max("deepest") + length).alias("deepest"),
        )
        both = reached.unionByName(longer).groupBy(*keys)
        grown = durable(
            both.agg(_bounded_sum("n_paths").alias("n_paths"), F.min("shallowest").alias("shallowest"), F.max("deepest").alias("deepest"))
        )
        first = walks.select(*group, "above", F.col("node").alias("_middle"), F.col("walks").alias("_walks"))
        second = walks.withColumnRenamed("above", "_middle")
        doubled = durable(
            first.join(second, [*group, "_middle"]).groupBy(*group, "above", "node").agg(_bounded_sum("_walks", "walks").alias("walks"))
        )
        discard(reached)
        discard(walks)
        reached, walks, length = grown, doubled, 2 * length
    looped = walks.select(*keys).distinct().withColumn("looped", F.lit(True))
    counted = reached.join(looped, keys, "left").withColumn("looped", F.coalesce("looped", F.lit(False)))
    return counted.withColumns({c: F.when(~F.col("looped"), F.col(c)) for c in ("n_paths", "deepest")})


def _edge_counts(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """``node, parent`` and what :func:`path_counts` says of the paths that end with this edge, for reached edges."""
    counted = path_counts(edges, group)
    above = counted.withColumnRenamed("node", "parent")
    below = edges.where(F.col("parent").isNotNull()).join(above, [*group, "parent"])
    heads = edges.where(F.col("parent").isNull()).select(
        *edges.columns, *[F.lit(n).cast("bigint").alias(c) for c, n in (("n_paths", 1), ("shallowest", 0), ("deepest", 0))],
        F.lit(False).alias("looped"),
    )
    further = below.withColumns({c: F.col(c) + 1 for c in ("shallowest", "deepest")})
    return heads.unionByName(further.select(*heads.columns))


def _blocking_edges(processes: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of processes that block or are blocked, one per process and blocker, and the edges between them.

    ``_parent`` is the blocker, 0 for a row that waits for nobody; such rows count only if they block others.
    """
    is_blocked = (F.col("blocked") > 0) & (F.col("blocked") != F.col("spid"))
    blocked = processes.where(is_blocked)
    free = processes.where((F.col("blocked") == 0) | (F.col("blocked") == F.col("spid")))
    blockers = blocked.select(*group, F.col("blocked").alias("spid")).distinct()
    # Most processes of a log have no part in any blocking: they leave before the rows are ranked.
    concerned = blocked.unionByName(free.join(blockers, [*group, "spid"], "left_semi")).withColumn(
        "_parent", F.when(is_blocked, F.col("blocked")).otherwise(0)
    )
    rest = [c for c in processes.columns if c not in {*group, "spid", "blocked"}]
    involved = durable(first_per_key(concerned, [*group, "spid", "_parent"], [F.desc("blocked"), *rest]))
    parent = F.when(F.col("_parent") != 0, F.col("_parent")).cast(processes.schema["spid"].dataType)
    return involved, involved.select(*group, F.col("spid").alias("node"), parent.alias("parent"))


def _parent_in(path: str) -> Column:
    """Second last element of a path; NULL for a root."""
    return F.try_element_at(path, F.lit(-2))


def blocking_tree(
    processes: DataFrame, group: Sequence[str] = ("instance_fullname", "sample_time"), text_col: str = "sql_text"
) -> DataFrame:
    """Blocking trees of every snapshot: head blockers, whom they block, and so on.

    Adds ``depth``, ``path_key`` (sorts a tree in reading order) and ``blocking_tree`` (indented text).
    Rows are reduced to one per snapshot, process and blocker first. A process whose threads wait for
    several blockers stands below each of them, with all that it blocks; one that also has a thread that
    waits for nobody is a head besides.
    """
    involved, edges = _blocking_edges(processes, group)
    placed = paths_from_root(edges, group).select(
        *group,
        F.col("node").alias("spid"),
        F.coalesce(_parent_in("path"), F.lit(0)).alias("_parent"),
        (F.size("path") - 1).alias("depth"),
        F.concat_ws("/", F.transform("path", _padded)).alias("path_key"),
    )
    line = F.concat(
        F.lit(TREE_MARGIN),
        F.repeat(F.lit(TREE_STEP), F.col("depth")),
        F.when(F.col("depth") == 0, TREE_HEAD).otherwise(TREE_BRANCH),
        F.col("spid").cast("string"),
        F.lit(" "),
        one_line(F.col(text_col)),
    )
    return involved.join(placed, [*group, "spid", "_parent"]).drop("_parent").withColumn("blocking_tree", line)


def blocking_edges(processes: DataFrame, group: Sequence[str] = ("instance_fullname", "sample_time")) -> DataFrame:
    """The rows of :func:`blocking_tree` without repeats: one per process and blocker, however many paths lead there.

    Adds ``n_paths`` (rows the process has in the tree below this blocker), ``shallowest`` and ``deepest`` (their depths) and ``looped``
    (the blocker is on or below a cycle, so paths and greatest depth are NULL). Where processes wait for several others, paths
    can double with every level; these rows cannot.
    """
    involved, edges = _blocking_edges(processes, group)
    placed = _edge_counts(edges, group).select(
        *group, F.col("node").alias("spid"), F.coalesce("parent", F.lit(0)).alias("_parent"), "n_paths", "shallowest", "deepest", "looped"
    )
    return involved.join(placed, [*group, "spid", "_parent"]).drop("_parent")


def unreached(
    processes: DataFrame, group: Sequence[str] = ("instance_fullname", "sample_time")
) -> DataFrame:
    """Blocked rows in no tree: part of a cycle (deadlock), below one, or below a process not sampled."""
    involved, edges = _blocking_edges(processes, group)
    reached = paths_from_root(edges, group).select(
        *group, F.col("node").alias("spid"), F.coalesce(_parent_in("path"), F.lit(0)).alias("_parent")
    )
    return involved.where(F.col("_parent") != 0).join(reached, [*group, "spid", "_parent"], "left_anti").drop("_parent")


def _identity(kind: str) -> Column:
    return F.struct(F.col(f"{kind}_spid").alias("spid"), F.col(f"{kind}_ecid").alias("ecid"))


def block_heads(reports: DataFrame) -> DataFrame:
    """Blockers of each server's monitor loops that are not blocked themselves in the loop."""
    blocker = reports.select(*LOOP, F.col("blocking_spid").alias("spid"), F.col("blocking_ecid").alias("ecid")).distinct()
    blocked = reports.select(*LOOP, F.col("blocked_spid").alias("spid"), F.col("blocked_ecid").alias("ecid"))
    return blocker.join(blocked, [*LOOP, "spid", "ecid"], "left_anti")


def _report_edges(reports: DataFrame, ends: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One report per blocked and blocking process of a loop, and the edges between processes, those of heads included."""
    rest = [c for c in reports.columns if c not in {*LOOP, *ends}]
    once = durable(first_per_key(reports, [*LOOP, *ends], rest))
    edges = once.select(*LOOP, _identity("blocked").alias("node"), _identity("blocking").alias("parent"))
    heads = block_heads(once).select(
        *LOOP,
        F.struct("spid", "ecid").alias("node"),
        F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"),
    )
    return once, edges.unionByName(heads)


def blocked_edges(reports: DataFrame) -> DataFrame:
    """Who blocks whom in each server's monitor loops, one row per blocked and blocking process, heads with blocker NULL.

    ``n_paths`` is how often the row stands in :func:`blocked_hierarchy`, ``shallowest`` and ``deepest`` at which levels;
    ``looped`` as in :func:`blocking_edges`.
    """
    _, edges = _report_edges(reports, ["blocked_spid", "blocked_ecid", "blocking_spid", "blocking_ecid"])
    both = [F.col(f"{end}.{part}").alias(f"{kind}_{part}") for end, kind in (("node", "blocked"), ("parent", "blocking")) for part in ("spid", "ecid")]
    return _edge_counts(edges, LOOP).select(*LOOP, *both, "n_paths", "shallowest", "deepest", "looped")


def blocked_hierarchy(reports: DataFrame) -> DataFrame:
    """Blocked-process reports as trees per server and monitor loop, head blockers included as 'Lead' rows.

    One report per blocked and blocking process of a loop counts; who is blocked by several stands below
    each. ``chain`` orders a loop's rows; its numbers are padded, so it orders them as numbers.
    """
    ends = ["blocked_spid", "blocked_ecid", "blocking_spid", "blocking_ecid"]
    once, edges = _report_edges(reports, ends)
    step = lambda p: F.concat_ws(".", _padded(p["spid"]), _padded(p["ecid"]))
    placed = paths_from_root(edges, LOOP).select(
        *LOOP,
        F.col("node.spid").alias("blocked_spid"),
        F.col("node.ecid").alias("blocked_ecid"),
        _parent_in("path")["spid"].alias("blocking_spid"),
        _parent_in("path")["ecid"].alias("blocking_ecid"),
        (F.size("path") - 1).alias("level"),
        F.concat(F.lit("/"), F.concat_ws("/", F.transform("path", step)), F.lit("/")).alias("chain"),
    )
    report = once.select(*LOOP, *ends, "endtime", "duration", "databasename", "report_xml")
    spid, ecid = F.col("blocked_spid"), F.col("blocked_ecid")
    worker = F.when(ecid == 0, "").otherwise(F.concat(F.lit("("), ecid.cast("string"), F.lit(")")))
    # A head has no blocker, and so meets no report.
    return placed.join(report, [*LOOP, *ends], "left").select(
        *LOOP,
        F.coalesce(F.date_format("endtime", "yyyy-MM-dd HH:mm:ss"), F.lit("Lead")).alias("tracetime"),
        "duration",
        "databasename",
        F.concat(F.repeat(F.lit(" "), F.col("level") * 4), spid.cast("string"), worker).alias("blockingtree"),
        "report_xml",
        "level",
        "chain",
    )
