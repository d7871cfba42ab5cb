"""Report-server usage and estate catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import decode, text, times
from fleetloom.functions.ordered import with_global_number
from fleetloom.functions.times import AsOf
from fleetloom.operators.series import latest_db_size
from fleetloom.operators.views import live_primary
from fleetloom.operators.xmlevents import parsed_once

# Property names, stages and codes of the report servers.
INFORMATION_TYPE = "sys_information_type_name"
SENSITIVITY_LABEL = "sys_sensitivity_label_name"
USAGE_TYPE = "information_usage_type"
MODEL_ACTION = 11
POWERBI_TYPE = 13
UNLISTED_TYPES = [1, 3, 5, 8]
REFRESH_ACTION = "DataRefresh"
BASE_URL = "http://baseurl"
REPORT_PREFIX = "/BI/report"
SOURCE_INFO = "SourceReportUri ARRAY<STRING>"
# End of the fixed values.


def source_uri(additional_info: Column) -> Column:
    """First source report URI in the XML of a log row; NULL when there is none or no proper XML."""
    info = F.from_xml(additional_info, SOURCE_INFO)
    return F.try_element_at(info["SourceReportUri"], F.lit(1))


def execution_log(
    log: DataFrame, catalog: DataFrame, exclude_user_like: str | None = None, case_insensitive: bool = True
) -> DataFrame:
    """Execution log rows with the catalog item they ran and their codes spelled out.

    Items no longer in the catalog are kept as deleted. ``exclude_user_like`` drops users by a LIKE
    pattern, of any case unless ``case_insensitive`` is off, and with it rows without a user.
    """
    user = text.collated(F.col("username"), case_insensitive)
    rows = log if exclude_user_like is None else log.where(~user.like(exclude_user_like))
    items = catalog.select(
        F.col("itemid").alias("_itemid"),
        F.col("path").alias("_path"),
        F.col("name").alias("_name"),
        F.col("type").alias("itemtype"),
    )
    joined = rows.join(items, F.col("reportid") == F.col("_itemid"), "left")
    path = F.when(F.col("reportaction") == MODEL_ACTION, source_uri(F.col("additionalinfo"))).otherwise(F.col("_path"))
    return joined.select(
        "logentryid",
        "instancename",
        F.coalesce(path, F.lit("Unknown")).alias("itempath"),
        "username",
        F.col("_itemid").alias("itemid"),
        F.col("_itemid").isNull().cast("int").alias("isitemdeleted"),
        F.coalesce("_name", F.lit("Deleted")).alias("itemname"),
        "itemtype",
        decode.decode(F.col("itemtype"), decode.CATALOG_TYPE).alias("itemtypedesc"),
        "executionid",
        decode.decode(F.col("requesttype"), decode.REQUEST_TYPE).alias("requesttype"),
        "format",
        "parameters",
        decode.decode(F.col("reportaction"), decode.REPORT_ACTION).alias("itemaction"),
        "timestart",
        "timeend",
        "timedataretrieval",
        "timeprocessing",
        "timerendering",
        decode.decode(F.col("source"), decode.EXECUTION_SOURCE).alias("source"),
        "status",
        "bytecount",
        "rowcount",
        "additionalinfo",
    )


def parent_folder(path: Column) -> Column:
    """Second-level folder of a report path: the text between the first character and the next slash."""
    no_folder = (path == "") | (F.locate("/", path, 3) < 2)
    return F.when(no_folder, "").otherwise(F.substring(path, F.lit(2), F.locate("/", path, 2) - 2))


def execution_stats(
    executions: DataFrame, as_of: AsOf, base_url: str = BASE_URL, years: int = 13, by_user: bool = True
) -> DataFrame:
    """Usage per item and month, for every user or (``by_user=False``) over all users.

    Times in seconds. The mean refresh time counts second boundaries and drops the fraction.
    """
    bound = times.as_of_time(as_of) - F.make_ym_interval(F.lit(years), F.lit(0))
    recent = executions.where(F.col("timestart") >= bound)
    path = F.col("itempath")
    item = ["itemid", "itemtype", "itempath", "itemname"]
    keys = [*item, "username"] if by_user else item
    # Within one user's rows there is one user or none; no distinct count is needed for that.
    users = (
        F.max(F.col("username").isNotNull().cast("bigint")) if by_user else F.count_distinct("username")
    )
    refresh = F.when(
        F.col("itemaction") == REFRESH_ACTION, times.seconds_between(F.col("timestart"), F.col("timeend"))
    )
    stats = (
        recent.withColumn("_refresh", refresh)
        .groupBy(*keys, F.date_format("timestart", "yyyyMM").alias("periodmonth"))
        .agg(
            users.alias("distinct_users"),
            (F.sum("timeprocessing") / F.lit(1000).cast("decimal(4,0)")).alias("total_timeprocessing"),
            (F.sum("timerendering") / F.lit(1000).cast("decimal(4,0)")).alias("total_timerendering"),
            F.sum("bytecount").alias("total_bytecount"),
            F.count("executionid").alias("total_executions"),
            F.max("timeend").alias("lastaccessed"),
            F.datediff(F.max("timeend"), F.min("timeend")).alias("statsperiod_days"),
            F.expr("sum(_refresh) div count(_refresh)").alias("avgmodelrefresh_sec"),
        )
    )
    prefix = F.when(F.col("itemtype") == POWERBI_TYPE, base_url).otherwise(base_url + REPORT_PREFIX)
    return stats.withColumns(
        {"parentfolder": parent_folder(path), "reporturl": F.concat(prefix, path)}
    ).drop("itemtype")


def subscriptions(subs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Subscriptions with the report they send."""
    return subs.join(catalog, F.col("report_oid") == F.col("itemid")).select(
        F.col("itemid").alias("reportitemid"),
        F.col("name").alias("reportname"),
        F.col("path").alias("reportlocation"),
        subs["description"].alias("subscriptiontitle"),
        "eventtype",
        "lastruntime",
        "laststatus",
        "creationdate",
    )


def report_stage(path: Column, case_insensitive: bool = True) -> Column:
    folded = text.fold_case(path, case_insensitive)

    def has(column: Column, part: str) -> Column:
        return F.contains(column, F.lit(part.lower() if case_insensitive else part))

    links, notices = has(folded, "Hyperlinks"), has(folded, "Subscriptions and Notifications")
    return (
        F.when(has(F.left(folded, F.lit(11)), "WorkSpace") & ~links & notices, "WorkSpace")
        .when(links, "URL Ref.")
        .when(notices, "Subscriptions")
        .otherwise("LIVE")
    )


def report_catalog(catalog: DataFrame, case_insensitive: bool = True) -> DataFrame:
    """Reports with stage and type, numbered by name (item id breaks ties) over the whole catalog."""
    reports = catalog.where(~F.col("type").isin(UNLISTED_TYPES)).select(
        F.col("itemid").alias("reportitemid"),
        F.col("name").alias("reportname"),
        F.col("path").alias("reportlocation"),
        report_stage(F.col("path"), case_insensitive).alias("reportstage"),
        decode.decode(F.col("type"), decode.CATALOG_TYPE).alias("reporttype"),
        F.col("description").alias("reportdescription"),
        F.to_date("creationdate").alias("createdon"),
        F.to_date("modifieddate").alias("modifiedon"),
    )
    return with_global_number(reports, ["reportname", "reportitemid"], "slnum")


def report_sources(log: DataFrame) -> DataFrame:
    """Executions and last access per source report URI found in the log."""
    uris = parsed_once(log, "additionalinfo", SOURCE_INFO)
    return (
        uris.withColumn("source_uri", F.try_element_at("SourceReportUri", F.lit(1)))
        .where(F.col("source_uri").isNotNull())
        .groupBy("source_uri")
        .agg(F.count(F.lit(1)).alias("executions"), F.max("timeend").alias("last_access"))
    )


def classifications(
    props: DataFrame, objects: DataFrame, schemas: DataFrame, columns: DataFrame, strict: bool = False
) -> DataFrame:
    """Sensitivity classification per column: information type, label and usage side by side.

    ``strict`` keeps only columns that have an information type, as a chain of outer joins keyed on
    the first set does.
    """
    base = ["instance_fullname", "database_id"]

    def of(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("value")))

    pivoted = (
        props.where(F.col("name").isin(INFORMATION_TYPE, SENSITIVITY_LABEL, USAGE_TYPE))
        .groupBy(*base, F.col("major_id").alias("object_id"), F.col("minor_id").alias("column_id"))
        .agg(
            of(INFORMATION_TYPE).alias("information_type"),
            of(SENSITIVITY_LABEL).alias("sensitivity_label"),
            of(USAGE_TYPE).alias("usage_type"),
            F.bool_or(F.col("name") == INFORMATION_TYPE).alias("_typed"),
        )
    )
    if strict:
        pivoted = pivoted.where("_typed")
    tables = objects.select(*base, "object_id", "schema_id", F.col("name").alias("table_name")).join(
        schemas.select(*base, "schema_id", F.col("name").alias("schema_name")), [*base, "schema_id"], "left"
    )
    names = columns.select(*base, "object_id", "column_id", F.col("name").alias("column_name"))
    return (
        pivoted.join(names, [*base, "object_id", "column_id"])
        .join(tables, [*base, "object_id"])
        .select(
            *base, "object_id", "schema_name", "table_name", "column_name", "information_type", "sensitivity_label", "usage_type"
        )
    )


def orphaned_users(db_principals: DataFrame, server_principals: DataFrame, case_insensitive: bool = True) -> DataFrame:
    """Database users whose identity no login of the server has; no identity counts as orphaned.

    Names of servers come from several collections, so they are compared without case unless ``case_insensitive`` is off.
    """
    users = db_principals.where((F.col("principal_id") > 5) & F.col("type").isin("S", "U", "G"))
    logins = server_principals.select(
        text.collated(F.col("instance_fullname"), case_insensitive).alias("_server"), F.col("sid").alias("_sid")
    )
    same_server = text.collated(F.col("instance_fullname"), case_insensitive) == F.col("_server")
    return users.join(logins, same_server & (F.col("sid") == F.col("_sid")), "left_anti")


def database_catalog(master: DataFrame, size_log: DataFrame, as_of: AsOf, strict: bool = False) -> DataFrame:
    """One row per live database name: its best description, primary instance and latest size.

    Sizes are those of the primary instance; ``strict`` adds up whatever the size log has under the
    name, one row per usage and allocation.
    """
    described = F.struct("application_name", "created_on", "instancefullname", "is_joined_availabilitygroups", "recovery_model")
    databases = (
        live_primary(master)
        .groupBy("databasename")
        .agg(F.max(described).alias("_best"), F.max("instancefullname").alias("instance_fullname"))
        .select(
            "databasename",
            "_best.is_joined_availabilitygroups",
            "_best.recovery_model",
            "_best.application_name",
            "instance_fullname",
        )
    )
    if strict:
        sizes = latest_db_size(size_log, as_of, keys=["usagetype", "allocationtype"], group_by=["databasename"])
        return databases.join(sizes, "databasename", "left")
    sizes = latest_db_size(size_log, as_of).withColumnRenamed("instancefullname", "instance_fullname")
    return databases.join(sizes, ["databasename", "instance_fullname"], "left")
