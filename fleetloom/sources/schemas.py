"""Schemas of the snapshot tables, as Spark DDL. Every table carries the instance, so one table holds the fleet."""

from __future__ import annotations

# Counters and sessions

OS_PERFORMANCE_COUNTERS = (
    "instance_fullname STRING, sample_time TIMESTAMP, object_name STRING, counter_name STRING, "
    "instance_name STRING, cntr_value BIGINT"
)
PERFMON_COUNTER_SQLSTATS = (
    "instance_fullname STRING, sample_time TIMESTAMP, counter_name STRING, cntr_value BIGINT"
)
CPU_RINGBUFFER = (
    "hostname STRING, sql_instance_name STRING, event_time TIMESTAMP, cpu_percent_sql_server INT, "
    "cpu_percent_others INT"
)
PROCESSES = (
    "instance_fullname STRING, sample_time TIMESTAMP, dbname STRING, spid SMALLINT, blocked SMALLINT, "
    "status STRING, lastwaittype STRING, waittime INT, cpu INT, physical_io BIGINT, memory_usage INT, "
    "login_time TIMESTAMP, last_batch TIMESTAMP, open_tran SMALLINT, program_name STRING, hostname STRING, "
    "loginame STRING, nt_username STRING, cmd STRING, sql_handle BINARY"
)
CONNECTIONS = (
    "instance_fullname STRING, sample_time TIMESTAMP, session_id INT, protocol_version INT, encrypt_option STRING, "
    "client_net_address STRING, client_tcp_port INT"
)
SESSIONS = (
    "instance_fullname STRING, sample_time TIMESTAMP, session_id INT, client_interface_name STRING, client_version DOUBLE, "
    "transaction_isolation_level SMALLINT"
)
SQL_TEXT = ("instance_fullname STRING, sql_handle BINARY, text STRING")

# Inventory and sizes

DATABASE_MASTER = (
    "instancefullname STRING, instancename STRING, database_id INT, databasename STRING, "
    "create_date TIMESTAMP, compatibility_level SMALLINT, collation_name STRING, recovery_model STRING, "
    "is_auto_create_stats_on BOOLEAN, is_auto_update_stats_on BOOLEAN, is_fulltext_enabled BOOLEAN, "
    "is_trustworthy_on BOOLEAN, is_encrypted BOOLEAN, is_query_store_on BOOLEAN, is_published BOOLEAN, "
    "is_subscribed BOOLEAN, is_merge_published BOOLEAN, is_distributor BOOLEAN, log_reuse_wait STRING, "
    "is_joined_availabilitygroups INT, target_recovery_seconds INT, containment STRING, agname STRING, "
    "is_ag_primary BOOLEAN, is_backup_scheduled INT, is_indexmaintain_scheduled INT, db_state SMALLINT, "
    "application_name STRING, db_description STRING, is_in_standby BOOLEAN, row_data_mb INT, log_data_mb INT, "
    "filestream_data_mb INT, fulltext_data_mb INT, unknown_data_mb INT, is_dropped BOOLEAN, "
    "created_on TIMESTAMP, modified_on TIMESTAMP"
)
# Key of the table above, and the columns a load never refreshes.
DATABASE_MASTER_KEY = ["instancefullname", "databasename"]
DATABASE_MASTER_FIXED = [
    *DATABASE_MASTER_KEY,
    "instancename",
    "database_id",
    "create_date",
    "compatibility_level",
    "is_dropped",
    "created_on",
    "modified_on",
]
DB_INSTANCES = (
    "instance_full_name STRING, instance_host STRING, instance_name STRING, environment STRING, dc STRING, "
    "is_deleted BOOLEAN"
)
DATABASE_SIZE_LOG_DETAILS = (
    "instancefullname STRING, databasename STRING, databaseid INT, log_date DATE, usagetype STRING, "
    "allocationtype STRING, filegroupname STRING, reserved_mb DECIMAL(15,3), used_mb DECIMAL(15,3), "
    "modified_on TIMESTAMP"
)
DATABASE_SIZE_LOG_DETAILS_KEY = [
    "instancefullname",
    "databaseid",
    "log_date",
    "filegroupname",
    "usagetype",
    "allocationtype",
]
DATABASE_SIZE_LOG = (
    "instancefullname STRING, databasename STRING, db_logdate TIMESTAMP, ag_isjoined INT, ag_isprimary INT, "
    "db_filetype STRING, filesize_gb DECIMAL(16,2), filesize_mb DECIMAL(16,2)"
)
DATABASES = (
    "instance_fullname STRING, database_id INT, name STRING, create_date TIMESTAMP, "
    "compatibility_level SMALLINT, collation_name STRING, recovery_model_desc STRING, "
    "group_database_id STRING, state SMALLINT, is_read_only BOOLEAN, is_in_standby BOOLEAN"
)
MASTER_FILES = ("instance_fullname STRING, database_id INT, type SMALLINT, size BIGINT")
REPLICA_STATES = (
    "instance_fullname STRING, group_database_id STRING, group_id STRING, is_local BOOLEAN, "
    "is_primary_replica BOOLEAN, is_preferred_backup BOOLEAN"
)
AVAILABILITY_GROUPS = ("instance_fullname STRING, group_id STRING, name STRING")
EXTENDED_PROPERTIES = (
    "instance_fullname STRING, database_id INT, property_name STRING, property_value STRING"
)
SERVER_STORAGE = (
    "hostname STRING, drive STRING, logical_name STRING, available_mb BIGINT, total_size_mb BIGINT"
)
CONFIGURATIONS = (
    "instance_fullname STRING, name STRING, value BIGINT, value_in_use BIGINT, sample_time TIMESTAMP"
)
CONFIG_BASELINE = ("name STRING, expected BIGINT, rule STRING")
HEALTH_CHECK = (
    "database_name STRING, database_size_mb DECIMAL(16,2), recovery_model STRING, "
    "last_full_backup TIMESTAMP, last_diff_backup TIMESTAMP, last_log_backup TIMESTAMP, ag_name STRING, "
    "replica_status STRING, query_store_on BOOLEAN, sample_time TIMESTAMP"
)
INTEGRITY_RESULTS = (
    "error INT, level INT, state INT, messagetext STRING, repairlevel STRING, status INT, dbid INT, "
    "dbfragid INT, objectid INT, indexid INT, partitionid BIGINT, allocunitid BIGINT, file INT, page INT, "
    "slot INT, instancefullname STRING"
)

# Indexes and tables

INDEXES = (
    "instance_fullname STRING, database_id INT, object_id INT, index_id INT, name STRING, type SMALLINT, "
    "type_desc STRING, is_primary_key BOOLEAN, fill_factor SMALLINT"
)
INDEX_USAGE_STATS = (
    "instance_fullname STRING, database_id INT, object_id INT, index_id INT, user_seeks BIGINT, "
    "user_scans BIGINT, user_lookups BIGINT, user_updates BIGINT, system_seeks BIGINT, system_scans BIGINT, "
    "system_lookups BIGINT, last_user_seek TIMESTAMP, last_user_scan TIMESTAMP, last_user_lookup TIMESTAMP, "
    "last_user_update TIMESTAMP, last_system_seek TIMESTAMP, last_system_scan TIMESTAMP, "
    "last_system_lookup TIMESTAMP"
)
PARTITION_STATS = (
    "instance_fullname STRING, database_id INT, object_id INT, index_id INT, partition_number INT, "
    "used_page_count BIGINT, row_count BIGINT"
)
PARTITIONS = (
    "instance_fullname STRING, database_id INT, object_id INT, index_id INT, partition_number INT, "
    "partition_id BIGINT, hobt_id BIGINT, rows BIGINT"
)
ALLOCATION_UNITS = (
    "instance_fullname STRING, database_id INT, container_id BIGINT, total_pages BIGINT, used_pages BIGINT"
)
OBJECTS = ("instance_fullname STRING, database_id INT, object_id INT, schema_id INT, name STRING")
SCHEMAS = ("instance_fullname STRING, database_id INT, schema_id INT, name STRING")
COLUMNS = ("instance_fullname STRING, database_id INT, object_id INT, column_id INT, name STRING")
CLASS_PROPERTIES = (
    "instance_fullname STRING, database_id INT, major_id INT, minor_id INT, name STRING, value STRING"
)
INDEX_PHYSICAL_STATS = (
    "instance_fullname STRING, database_id INT, object_id INT, index_id INT, partition_number INT, "
    "hobt_id BIGINT, avg_fragmentation_in_percent DOUBLE, page_count BIGINT"
)
INDEX_OPERATIONAL_STATS = (
    "instance_fullname STRING, database_id INT, object_id INT, index_id INT, partition_number INT, "
    "hobt_id BIGINT, leaf_allocation_count BIGINT, nonleaf_allocation_count BIGINT, "
    "leaf_insert_count BIGINT, nonleaf_insert_count BIGINT, leaf_update_count BIGINT, "
    "nonleaf_update_count BIGINT, leaf_delete_count BIGINT, nonleaf_delete_count BIGINT, "
    "row_lock_count BIGINT, row_lock_wait_count BIGINT, row_lock_wait_in_ms BIGINT, page_lock_count BIGINT, "
    "page_lock_wait_count BIGINT, page_lock_wait_in_ms BIGINT, page_latch_wait_count BIGINT, "
    "page_latch_wait_in_ms BIGINT"
)
ROW_GROUPS = (
    "instance_fullname STRING, database_id INT, object_id INT, index_id INT, partition_number INT, "
    "state SMALLINT, total_rows BIGINT, deleted_rows BIGINT"
)
CS_DICTIONARIES = (
    "instance_fullname STRING, database_id INT, hobt_id BIGINT, on_disk_size BIGINT, entry_count BIGINT"
)
MISSING_INDEXES = (
    "hostname STRING, sql_instance STRING, database_name STRING, databaseid INT, idx_table STRING, "
    "index_handle INT, idx_columns STRING, idx_columns_include STRING, user_requests BIGINT, "
    "impact_reduced DOUBLE, optimized_on TIMESTAMP"
)

# Reports, users, backups, events

EXECUTION_LOG = (
    "logentryid BIGINT, instancename STRING, reportid STRING, username STRING, executionid STRING, "
    "requesttype SMALLINT, format STRING, parameters STRING, reportaction SMALLINT, timestart TIMESTAMP, "
    "timeend TIMESTAMP, timedataretrieval INT, timeprocessing INT, timerendering INT, source SMALLINT, "
    "status STRING, bytecount BIGINT, rowcount BIGINT, additionalinfo STRING"
)
CATALOG = (
    "itemid STRING, name STRING, path STRING, type SMALLINT, description STRING, creationdate TIMESTAMP, "
    "modifieddate TIMESTAMP"
)
SUBSCRIPTIONS = (
    "report_oid STRING, description STRING, eventtype STRING, lastruntime TIMESTAMP, laststatus STRING"
)
DIRECTORY_USERS = (
    "cn STRING, employeeid STRING, title STRING, samaccountname STRING, manager STRING, company STRING, "
    "department STRING, email STRING, mobile STRING, whencreated STRING, whenchanged STRING, "
    "samaccounttype STRING, useraccountcontrol STRING"
)
LOGINS = (
    "instance_fullname STRING, name STRING, sid BINARY, type STRING, is_expiration_checked BOOLEAN, "
    "password_last_set TIMESTAMP, days_until_expiration INT, sysadmin BOOLEAN, securityadmin BOOLEAN, "
    "serveradmin BOOLEAN, setupadmin BOOLEAN, processadmin BOOLEAN, diskadmin BOOLEAN, dbcreator BOOLEAN, "
    "bulkadmin BOOLEAN"
)
DATABASE_PRINCIPALS = (
    "instance_fullname STRING, database_id INT, principal_id INT, name STRING, sid BINARY, type STRING"
)
BACKUPSET = (
    "instance_fullname STRING, media_set_id INT, database_name STRING, backup_finish_date TIMESTAMP"
)
BACKUPMEDIAFAMILY = ("instance_fullname STRING, media_set_id INT, physical_device_name STRING")
FILE_LISTING = ("folder STRING, filename STRING, depth SMALLINT, isfile SMALLINT")
ERROR_LOG = (
    "instance_fullname STRING, date TIMESTAMP, line_no BIGINT, processinfo STRING, text STRING"
)
NOTIFICATION_LOG = (
    "sessionid BIGINT, appname STRING, sessionuser STRING, logdatetime TIMESTAMP, paramsendercode STRING, "
    "parammobilenumbers STRING, parammessagetext STRING, smsstatus STRING, staustext STRING, "
    "responsetext STRING, calldetails STRING"
)
XE_RING_BUFFER = ("instance_fullname STRING, targetdata STRING")
BLOCKED_REPORTS_RAW = ("instance_fullname STRING, shape STRING, eventclass INT, endtime TIMESTAMP, textdata STRING")
BLOCKED_REPORTS = (
    "instance_fullname STRING, monitorloop STRING, databasename STRING, endtime TIMESTAMP, duration BIGINT, blocking_spid INT, "
    "blocking_ecid INT, blocked_spid INT, blocked_ecid INT, report_xml STRING"
)
PERSON_XML = ("payload STRING")
