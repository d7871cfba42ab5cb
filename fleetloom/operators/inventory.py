"""Inventory: database and server properties, table sizes, logins, users, backups, configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import decode, text, times
from fleetloom.functions.ordered import first_per_key
from fleetloom.functions.times import AsOf
from fleetloom.operators.ingest import upsert_latest
from fleetloom.operators.views import pages_to_mb

DATABASE = ["instance_fullname", "database_id"]

# File types, property and option names, and the expected configuration.
FILE_TYPES = {0: "row_data_mb", 1: "log_data_mb", 2: "filestream_data_mb", 3: "unknown_data_mb", 4: "fulltext_data_mb"}

DATABASE_PROPERTIES = {"Application": "application_name", "Description": "db_description"}

SERVER_OPTIONS = {
    "max degree of parallelism": "maxdop",
    "cost threshold for parallelism": "costthreshold",
    "max server memory (MB)": "maxmemorymb",
}

CONFIG_BASELINE = [
    ("remote admin connections", 1, "2.7"),
    ("Ad Hoc Distributed Queries", 0, "2.1"),
    ("CLR Enabled", 0, "2.2"),
    ("Cross DB Ownership Chaining", 0, "2.3"),
    ("Database Mail XPs", 0, "2.4"),
    ("Ole Automation Procedures", 0, "2.5"),
    ("Remote Access", 0, "2.6"),
    ("Scan For Startup Procs", 0, "2.8"),
    ("xp_cmdshell", 0, "2.15"),
    ("default trace enabled", 1, "5.2"),
    ("show advanced options", 0, None),
    ("backup compression default", 1, None),
]

BACKUP_TYPES = {"FULL": "Full_", "FULL_COPY": "Full_Copy_", "DIF": "Dif_", "LOG": "Log_"}

NEVER = "Never Expire"
# End of the fixed values.


def database_properties(
    databases: DataFrame, files: DataFrame, replicas: DataFrame, groups: DataFrame, xprops: DataFrame
) -> DataFrame:
    """User databases with file sizes by type, availability group, application and description."""
    kilobytes = F.col("size") * 8
    sizes = files.groupBy(*DATABASE).agg(
        *[F.sum(F.when(F.col("type") == kind, kilobytes)).alias(name) for kind, name in FILE_TYPES.items()]
    )
    sizes = sizes.withColumns({name: F.expr(f"{name} div 1024") for name in FILE_TYPES.values()})
    described = (
        xprops.where(F.col("property_name").isin(list(DATABASE_PROPERTIES)))
        .groupBy(*DATABASE)
        .agg(
            *[
                F.max(F.when(F.col("property_name") == prop, F.col("property_value"))).alias(name)
                for prop, name in DATABASE_PROPERTIES.items()
            ]
        )
    )
    local = (
        replicas.where(F.col("is_local"))
        .join(groups.select("instance_fullname", "group_id", F.col("name").alias("agname")), ["instance_fullname", "group_id"], "left")
        .select("instance_fullname", "group_database_id", "agname", F.col("is_primary_replica").alias("is_ag_primary"))
    )
    return (
        databases.where(F.col("database_id") > 4)
        .join(local, ["instance_fullname", "group_database_id"], "left")
        .join(described, DATABASE, "left")
        .join(sizes, DATABASE, "left")
        .withColumn("is_joined_availabilitygroups", F.col("group_database_id").isNotNull().cast("int"))
        .withColumnsRenamed({"name": "databasename", "recovery_model_desc": "recovery_model", "state": "db_state"})
    )


def table_sizes(
    tables: DataFrame,
    indexes: DataFrame,
    partitions: DataFrame,
    alloc: DataFrame,
    schemas: DataFrame,
    only_with_rows: bool = True,
    merge_rows: bool = False,
) -> DataFrame:
    """Reserved and used size per table and row count.

    Indexes that count different rows give a table several result rows; ``merge_rows`` gives one,
    with the largest count.
    """
    spans = partitions.where(F.col("rows") > 0) if only_with_rows else partitions
    units = alloc.select(*DATABASE, F.col("container_id").alias("partition_id"), "total_pages", "used_pages")
    # Pages are summed per index before names are joined on.
    pages = (
        spans.select(*DATABASE, "object_id", "index_id", "partition_id", "rows")
        .join(units, [*DATABASE, "partition_id"])
        .groupBy(*DATABASE, "object_id", "index_id", "rows")
        .agg(F.sum("total_pages").alias("_total"), F.sum("used_pages").alias("_used"))
        .join(indexes.select(*DATABASE, "object_id", "index_id"), [*DATABASE, "object_id", "index_id"])
    )
    named = tables.where(F.col("object_id") > 255).select(
        *DATABASE, "object_id", "schema_id", F.col("name").alias("table_name")
    ).join(
        schemas.select(*DATABASE, "schema_id", F.col("name").alias("schema_name")), [*DATABASE, "schema_id"], "left"
    )
    keys = [*DATABASE, "schema_name", "table_name"]
    joined = pages.join(named, [*DATABASE, "object_id"])
    grouped = (
        joined.groupBy(*keys).agg(F.max("rows").alias("row_count"), F.sum("_total").alias("_total"), F.sum("_used").alias("_used"))
        if merge_rows
        else joined.groupBy(*keys, F.col("rows").alias("row_count")).agg(
            F.sum("_total").alias("_total"), F.sum("_used").alias("_used")
        )
    )

    def gigabytes(pages_col: str) -> Column:
        return (F.col(pages_col).cast("decimal(20,0)") * 8 / 1048576).cast("decimal(18,2)")

    return grouped.select(
        *keys,
        "row_count",
        pages_to_mb(F.col("_total")).alias("totalsize_mb"),
        gigabytes("_total").alias("totalsize_gb"),
        pages_to_mb(F.col("_used")).alias("usedsize_mb"),
        gigabytes("_used").alias("usedsize_gb"),
    )


def server_properties(config_rows: DataFrame, props: DataFrame, as_of: AsOf) -> DataFrame:
    """One row per instance: its properties and three configured options as columns."""
    options = (
        config_rows.where(F.col("name").isin(list(SERVER_OPTIONS)))
        .groupBy("instance_fullname")
        .agg(*[F.max(F.when(F.col("name") == opt, F.col("value"))).alias(col) for opt, col in SERVER_OPTIONS.items()])
    )
    return props.join(options, "instance_fullname", "left").withColumn("sample_time", times.as_of_time(as_of))


def role_membership(logins: DataFrame) -> DataFrame:
    """One row per login and server role it has."""
    return (
        logins.unpivot(["instance_fullname", "name"], decode.ROLE_FLAGS, "role", "granted")
        .where(F.col("granted"))
        .drop("granted")
    )


def role_list(logins: DataFrame) -> DataFrame:
    """Roles of every login that has any, as text; needs no shuffle."""
    roles = F.concat_ws(", ", *[F.when(F.col(r), F.lit(r)) for r in decode.ROLE_FLAGS])
    return logins.select("instance_fullname", "name", roles.alias("roles")).where(F.col("roles") != "")


def login_sid_mismatch(logins: DataFrame) -> DataFrame:
    """Logins known under several identities: one row per name, identity and instance that has it."""
    known = logins.where(F.col("sid").isNotNull()).select(
        "name", F.concat(F.lit("0x"), F.hex("sid")).alias("sid"), "instance_fullname"
    ).distinct()
    several = known.groupBy("name").agg(F.count_distinct("sid").alias("identities")).where(F.col("identities") > 1)
    return known.join(several, "name")


def backup_files(
    backupset: DataFrame,
    mediafamily: DataFrame,
    day: str | None = None,
    database: str | None = None,
    as_of: AsOf = None,
) -> DataFrame:
    """Backup files finished on a day (the day before ``as_of`` unless given), one row per file.

    Backups without a media row are kept.
    """
    start = F.to_date(F.lit(day)) if day is not None else F.date_sub(times.as_of_time(as_of), 1)
    finished = F.col("backup_finish_date")
    sets = backupset.where(
        (finished >= start.cast("timestamp")) & (finished < F.date_add(start, 1).cast("timestamp"))
    )
    if database is not None:
        sets = sets.where(F.col("database_name") == database)
    path = F.col("physical_device_name")
    return (
        sets.join(mediafamily, ["instance_fullname", "media_set_id"], "left")
        .withColumns({"folder": text.folder_name(path), "filename": text.file_name(path)})
        .withColumn("backup_date", start)
    )


def config_compliance(snapshot: DataFrame, baseline: Sequence[tuple] = CONFIG_BASELINE) -> DataFrame:
    """Every instance against every expected option: PASS, FAIL or MISSING.

    Option names are compared without regard to case. The newest sample of an option counts.
    """
    expected = {name.lower(): (value, rule) for name, value, rule in baseline}
    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(value).cast("bigint").alias("expected"),
                F.lit(rule).cast("string").alias("rule"),
            )
            for name, (value, rule) in expected.items()
        ]
    )
    wanted = (
        snapshot.select("instance_fullname")
        .distinct()
        .select("instance_fullname", F.inline(options))
    )
    current = (
        snapshot.where(F.lower("name").isin(list(expected)))
        .groupBy("instance_fullname", F.lower("name").alias("name"))
        .agg(F.max(F.struct("sample_time", "value_in_use")).alias("_now"))
        .select("instance_fullname", "name", F.lit(True).alias("_found"), F.col("_now.value_in_use").alias("value"))
    )
    status = (
        F.when(F.col("_found").isNull(), "MISSING").when(F.col("value") == F.col("expected"), "PASS").otherwise("FAIL")
    )
    return (
        wanted.join(current, ["instance_fullname", "name"], "left")
        .withColumn("status", status)
        .drop("_found")
    )


def config_score(compliance: DataFrame) -> DataFrame:
    """Share of passed options per instance."""
    return compliance.groupBy("instance_fullname").agg(
        F.count(F.lit(1)).alias("options"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        (F.count_if(F.col("status") == "PASS") * 100 / F.count(F.lit(1))).alias("score"),
    )


def latest_full_backup(
    listing: DataFrame, group_cols: Sequence[str] = ("folder",), k: int = 1, case_insensitive: bool = True
) -> DataFrame:
    """The ``k`` last full-backup files of each folder, by name."""
    name = text.fold_case(F.col("filename"), case_insensitive)
    marker, suffix = ("_full_", ".bak") if case_insensitive else ("_Full_", ".BAK")
    files = listing.where(
        (F.col("isfile") == 1) & F.contains(name, F.lit(marker)) & F.endswith(name, F.lit(suffix))
    )
    return first_per_key(files, group_cols, [F.desc("filename")], k)


def _as_users(staged: DataFrame) -> DataFrame:
    """Directory entries as users: manager's name, dates where they parse, status of the account."""
    at = F.instr("manager", "OU=")
    manager = F.when(at >= 2, F.replace(F.left("manager", at - 2), F.lit("CN="), F.lit("")))
    return staged.select(
        F.col("cn").alias("username"),
        F.col("employeeid").alias("employee_id"),
        "title",
        F.col("samaccountname").alias("user_account"),
        manager.alias("manager_name"),
        F.col("department").alias("user_department"),
        "email",
        F.col("mobile").alias("mobile_number"),
        F.col("whencreated").try_cast("timestamp").alias("ldap_created_on"),
        F.col("whenchanged").try_cast("timestamp").alias("ldap_modified_on"),
        decode.decode(F.col("useraccountcontrol"), decode.ACCOUNT_CONTROL).alias("user_status"),
        F.col("samaccounttype").alias("sma_account_type"),
    )


def directory_users(staged: DataFrame) -> DataFrame:
    """Distinct directory entries as users."""
    return _as_users(staged).distinct()


def sync_directory_users(users: DataFrame, staged: DataFrame, as_of: AsOf) -> DataFrame:
    """User table after a directory load: unknown accounts added, known ones refreshed.

    Of several entries of an account the one changed last counts.
    """
    arrived = _as_users(staged)
    columns = [c for c in arrived.columns if c != "user_account"]
    latest = [F.desc("ldap_modified_on"), *[c for c in columns if c != "ldap_modified_on"]]
    return upsert_latest(users, arrived, ["user_account"], columns, as_of, latest_by=latest)


def password_expiry(logins: DataFrame) -> DataFrame:
    """Password age and expiry of the logins, system logins left out."""
    expires = F.date_add(F.to_date("password_last_set"), F.col("days_until_expiration"))
    return logins.where(~F.startswith("name", F.lit("##"))).select(
        F.col("instance_fullname").alias("servername"),
        F.col("name").alias("loginname"),
        F.col("password_last_set").alias("passwordlastsettime"),
        F.coalesce(F.col("days_until_expiration").cast("string"), F.lit(NEVER)).alias("daysuntilexpiration"),
        F.coalesce(F.date_format(expires, "MM/dd/yyyy"), F.lit(NEVER)).alias("passwordexpirationdate"),
        expires.alias("expiration_date"),
        F.when(F.col("is_expiration_checked"), "TRUE").otherwise("FALSE").alias("passwordexpirechecked"),
    )


def backup_archive_plan(
    files: DataFrame,
    as_of: AsOf,
    destination: str,
    retention_days: int = 32,
    weekly_day: str = "SUN",
    purge: str = "older_than",
) -> DataFrame:
    """Where each backup file belongs: dated folder, monthly copy, or purge.

    Full backups of the last day of the previous month, and of its last ``weekly_day``, go to a
    folder of that month and are not purged. ``purge='exact_day'`` purges only the files that are
    exactly ``retention_days`` old, as a job that never misses a day would.
    """
    today = F.to_date(times.as_of_time(as_of))
    month_end = F.last_day(F.add_months(today, -1))
    last_weekday = F.next_day(F.date_sub(month_end, 7), weekly_day)
    day = F.to_date("backup_finish_date")
    limit = F.date_sub(today, retention_days)
    expired = day == limit if purge == "exact_day" else day <= limit
    base = F.concat(F.lit(destination.rstrip("\\") + "\\"), "database_name", F.lit("\\"))
    full = F.contains(F.upper("filename"), F.lit("FULL"))
    keep = full & ((day == month_end) | (day == last_weekday))
    return (
        files.withColumn("destination", F.concat(base, F.date_format("backup_finish_date", "yyyyMMdd")))
        .withColumn("keep_monthly", F.coalesce(keep, F.lit(False)))
        .withColumn("monthly_folder", F.when(F.col("keep_monthly"), F.concat(base, F.date_format(month_end, "yyyy-MMM"))))
        .withColumn("purge", F.coalesce(expired, F.lit(False)) & ~F.col("keep_monthly"))
    )


def backup_eligibility(
    databases: DataFrame,
    replicas: DataFrame,
    backup_types: Sequence[str],
    as_of: AsOf,
    location: str,
    version: str,
    preferred_col: str = "is_preferred_backup",
) -> DataFrame:
    """For each online user database and backup type: run or skip, why, and the file to write.

    Log backups need the full recovery model and the preferred replica, full and differential ones
    the primary, full copies the preferred replica. Databases in no group are both.
    """
    unknown = [t for t in backup_types if t not in BACKUP_TYPES]
    if unknown:
        raise ValueError(f"unknown backup types: {unknown}")
    roles = replicas.where(F.col("is_local")).groupBy("instance_fullname", "group_database_id").agg(
        F.bool_or("is_primary_replica").alias("_primary"), F.bool_or(preferred_col).alias("_preferred")
    )
    alone = F.col("group_database_id").isNull()
    primary = alone | F.coalesce("_primary", F.lit(False))
    preferred = alone | F.coalesce("_preferred", F.lit(False))
    kind = F.col("backup_type")
    reason = (
        F.when((kind == "LOG") & ~(F.col("recovery_model_desc").eqNullSafe("FULL")), "recovery model is not full")
        .when(kind.isin("LOG", "FULL_COPY") & ~preferred, "not the preferred replica")
        .when(kind.isin("FULL", "DIF") & ~primary, "not the primary replica")
    )
    stamp = F.date_format(times.as_of_time(as_of), "yyyyMMddHHmm")
    host = text.host_name(F.col("instance_fullname"))
    instance = text.instance_name(F.col("instance_fullname"), default="MSSQLSERVER")
    file = F.concat(
        F.concat_ws("_", F.col("name"), stamp, host, instance, decode.decode(kind, BACKUP_TYPES, None)),
        F.lit(version),
        F.when(kind == "LOG", ".TRN").otherwise(".BAK"),
    )
    folder = F.concat(F.lit(location.rstrip("\\") + "\\"), "name", F.lit("\\"))
    return (
        databases.where((F.col("database_id") > 4) & (F.col("state") == 0))
        .join(roles, ["instance_fullname", "group_database_id"], "left")
        .withColumn("backup_type", F.explode(F.array(*[F.lit(t) for t in backup_types])))
        .withColumn("reason", reason)
        .select(
            *DATABASE,
            "name",
            "backup_type",
            F.when(F.col("reason").isNull(), "RUN").otherwise("SKIP").alias("decision"),
            "reason",
            F.when(F.col("reason").isNull(), F.concat(folder, file)).alias("backup_file"),
        )
    )
