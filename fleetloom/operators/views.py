"""Report views: predicates, scopes, projections, session views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import decode, text, times
from fleetloom.functions.ordered import as_of_join
from fleetloom.functions.times import AsOf


def primary_only(databases: DataFrame, replica_states: DataFrame) -> DataFrame:
    """Databases outside availability groups, and those whose local replica is the primary."""
    primaries = (
        replica_states.where(F.col("is_local") & F.col("is_primary_replica"))
        .select("instance_fullname", "group_database_id")
        .distinct()
        .withColumn("_primary", F.lit(True))
    )
    return (
        databases.join(primaries, ["instance_fullname", "group_database_id"], "left")
        .where(F.col("group_database_id").isNull() | F.col("_primary"))
        .select(*databases.columns)
    )


def live_primary(df: DataFrame) -> DataFrame:
    """Rows of a latest-state table that are not dropped and primary, or outside a group."""
    return df.where(
        ~F.col("is_dropped") & (F.col("is_ag_primary") | (F.col("is_joined_availabilitygroups") == 0))
    )


Scope = str | Sequence[str] | DataFrame | None


def resolve_scope(
    df: DataFrame,
    col: str,
    include: Scope = None,
    exclude: Scope = None,
    sep: str = ",",
    always_exclude: bool = False,
    case_insensitive: bool = False,
) -> DataFrame:
    """Rows whose ``col`` is in scope.

    Lists come as separated text, as names or as a one-column DataFrame of any size. None means no
    restriction. The include list wins: with one, the exclude list only counts if ``always_exclude``.
    ``case_insensitive`` compares names like a server with such a collation does; lists then do not reach the scan.
    """
    scoped = _listed(df, col, include, sep, "left_semi", case_insensitive)
    return _listed(scoped, col, exclude, sep, "left_anti", case_insensitive) if include is None or always_exclude else scoped


def _listed(df: DataFrame, col: str, names: Scope, sep: str, how: str, case_insensitive: bool) -> DataFrame:
    if names is None:
        return df
    name = text.collated(F.col(col), case_insensitive)
    if isinstance(names, DataFrame):
        listed = names.select(text.collated(F.trim(F.col(names.columns[0])), case_insensitive).alias("_listed")).distinct()
        return df.join(listed, name == F.col("_listed"), how)
    parts = names.split(sep) if isinstance(names, str) else names
    wanted = name.isin([text.collated(F.lit(p.strip()), case_insensitive) for p in parts if p.strip()])
    # A NULL name is in no list.
    return df.where(wanted if how == "left_semi" else ~F.coalesce(wanted, F.lit(False)))


def missing_indexes(df: DataFrame, min_impact: float = 50, min_requests: int = 500) -> DataFrame:
    """Suggested indexes that would pay off and were not acted on, with server and database keys.

    A default instance has no instance name, so both keys are NULL for it. Database ids of three and
    more digits are written out.
    """
    return df.where(
        (F.col("impact_reduced") > min_impact)
        & (F.col("user_requests") > min_requests)
        & F.col("optimized_on").isNull()
    ).select(
        "hostname",
        "sql_instance",
        F.concat("hostname", F.lit("\\"), "sql_instance").alias("server_fullname"),
        "database_name",
        "idx_table",
        "index_handle",
        "idx_columns",
        "idx_columns_include",
        "user_requests",
        "impact_reduced",
        F.concat("hostname", F.lit("-"), "sql_instance", F.lit("-"), F.col("databaseid").cast("string")).alias(
            "database_key"
        ),
    )


def size_log(df: DataFrame, as_of: AsOf, days: int = 60, name_length: int | None = None) -> DataFrame:
    """File sizes of the last days on primary replicas, with host, instance and month parts.

    The instance name is cut to ``name_length`` if given; for a default instance it is the host name.
    """
    full = F.col("instancefullname")
    return df.where(
        F.col("ag_isprimary").isin(1, 2) & (F.col("db_logdate") >= times.days_before(as_of, days))
    ).select(
        full.alias("sqlinstancefullname"),
        text.host_name(full).alias("host_name"),
        F.substring(full, F.instr(full, "\\") + 1, F.length(full) if name_length is None else F.lit(name_length)).alias("instancename"),
        F.month("db_logdate").alias("monthnum"),
        F.year("db_logdate").alias("yearnum"),
        "db_logdate",
        "databasename",
        "ag_isjoined",
        "ag_isprimary",
        "db_filetype",
        F.col("filesize_gb").alias("db_filesizegb"),
        F.col("filesize_mb").alias("db_filesizemb"),
    )


def server_hosts(instances: DataFrame) -> DataFrame:
    return instances.select(F.col("instance_host").alias("hostname")).distinct()


def sql_servers(instances: DataFrame) -> DataFrame:
    """Distinct instances in service."""
    return (
        instances.where(~F.col("is_deleted"))
        .select(
            F.col("instance_host").alias("hostname"),
            F.col("instance_full_name").alias("instance_fullname"),
            "instance_name",
            F.col("environment").alias("environ"),
            "dc",
        )
        .distinct()
    )


def storage(df: DataFrame) -> DataFrame:
    """Volumes with the share in use; NULL for a volume of no size."""
    used = F.col("total_size_mb") - F.col("available_mb")
    return df.select(
        "hostname",
        "drive",
        "logical_name",
        "available_mb",
        "total_size_mb",
        F.try_divide(used * F.lit(100.0), F.col("total_size_mb")).alias("used_pct"),
    )


def _of_their_time(processes: DataFrame, settings: DataFrame, values: list[str]) -> DataFrame:
    """Processes with the newest settings sampled at or before them. Process ids are used again for other sessions.

    Settings without a sample time hold for all samples.
    """
    timed = lambda df: df if "sample_time" in df.columns else df.withColumn("sample_time", F.lit(None).cast("timestamp"))
    met = as_of_join(timed(processes), timed(settings), ["instance_fullname", "spid"], "sample_time", values)
    return met.select(*processes.columns, *values)


def _statements(sql_text: DataFrame) -> DataFrame:
    """Texts by handle, once each: a handle stands for one text, however often it was sampled."""
    return sql_text.groupBy("instance_fullname", "sql_handle").agg(F.max("text").alias("text"))


def active_sessions(processes: DataFrame, connections: DataFrame, sql_text: DataFrame) -> DataFrame:
    """Processes with a client connection and a statement, client protocol spelled out.

    Of a log of samples, each process has the connection of its own time.
    """
    protocol = F.shiftrightunsigned(F.col("protocol_version"), 24).bitwiseAND(F.lit(255))
    wires = connections.select(
        "instance_fullname",
        *[c for c in ["sample_time"] if c in connections.columns],
        F.col("session_id").cast(processes.schema["spid"].dataType).alias("spid"),
        "encrypt_option",
        "client_net_address",
        "client_tcp_port",
        protocol.alias("client_protocol"),
        decode.decode(protocol, decode.CLIENT_PROTOCOL, "Unknown driver").alias("client_protocol_version"),
    )
    statements = _statements(sql_text).withColumnRenamed("text", "sql_text")
    values = ["encrypt_option", "client_net_address", "client_tcp_port", "client_protocol", "client_protocol_version"]
    return (
        _of_their_time(processes, wires, values)
        .join(statements, ["instance_fullname", "sql_handle"])
        .withColumnRenamed("cmd", "command_type")
    )


def session_log(
    processes: DataFrame,
    sessions: DataFrame,
    sql_text: DataFrame,
    collected_by: str,
    as_of: AsOf | None = None,
) -> DataFrame:
    """User processes with session settings and statement, in the layout of the session log.

    Of a log of samples, each process has the settings of its own time. ``as_of`` is when the rows are collected; it
    replaces the sample time in the result.
    """
    foreground = processes.where(F.rtrim("status") != "background")
    settings = sessions.select(
        "instance_fullname",
        *[c for c in ["sample_time"] if c in sessions.columns],
        F.col("session_id").cast(processes.schema["spid"].dataType).alias("spid"),
        "client_interface_name",
        F.col("client_version").alias("client_int_version"),
        decode.decode(F.col("transaction_isolation_level"), decode.ISOLATION_LEVEL, None).alias("isolation_level"),
    )
    values = ["client_interface_name", "client_int_version", "isolation_level"]
    joined = _of_their_time(foreground, settings, values).join(_statements(sql_text), ["instance_fullname", "sql_handle"])
    if as_of is not None:
        joined = joined.withColumn("sample_time", times.as_of_time(as_of))
    return joined.select(
        "instance_fullname",
        "sample_time",
        F.col("dbname").alias("databasename"),
        "spid",
        F.col("lastwaittype").alias("wait_type"),
        F.col("waittime").alias("wait_time_ms"),
        F.col("blocked").alias("blocked_by"),
        *[F.rtrim(c).alias(c) for c in ("hostname", "program_name", "loginame")],
        F.rtrim("nt_username").alias("user_name"),
        "login_time",
        "last_batch",
        "cpu",
        "physical_io",
        pages_to_mb(F.col("memory_usage")).alias("memory_usage_mb"),
        "open_tran",
        F.rtrim("status").alias("status"),
        F.rtrim("cmd").alias("cmd"),
        "text",
        "client_interface_name",
        "client_int_version",
        "isolation_level",
        F.lit(collected_by).alias("collected_by"),
    )


def pages_to_mb(pages: Column, scale: int = 2) -> Column:
    """Pages of 8 KB in MB."""
    return (pages.cast("decimal(20,0)") * 8 / 1024).cast(f"decimal(18,{scale})")
