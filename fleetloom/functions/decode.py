"""Code tables of the snapshots and the expression that applies them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes and texts below must equal what the servers' reports use.

CATALOG_TYPE = {
    1: "Folder",
    2: "Paginated Report",
    3: "Embeded Files",
    5: "Data Sources",
    8: "Data Sets",
    13: "PowerBI Report",
}

REQUEST_TYPE = {0: "Interactive", 1: "Subscription", 2: "Refresh Cache"}

REPORT_ACTION = {
    1: "Render",
    2: "BookmarkNavigation",
    3: "DocumentMapNavigation",
    4: "DrillThrough",
    5: "FindString",
    6: "GetDocumentMap",
    7: "Toggle",
    8: "Sort",
    9: "Execute",
    10: "RenderEdit",
    11: "ExecuteDataShapeQuery",
    12: "RenderMobileReport",
    13: "ConceptualSchema",
    14: "QueryData",
    15: "ASModelStream",
    16: "RenderExcelWorkbook",
    17: "GetExcelWorkbookInfo",
    18: "SaveToCatalog",
    19: "DataRefresh",
}

EXECUTION_SOURCE = {
    1: "Live",
    2: "Cache",
    3: "Snapshot",
    4: "History",
    5: "AdHoc",
    6: "Session",
    7: "Rdce",
}

ISOLATION_LEVEL = {
    0: "Unspecified",
    1: "ReadUncommitted",
    2: "ReadCommitted",
    3: "RepeatableRead",
    4: "Serializable",
    5: "Snapshot",
}

CLIENT_PROTOCOL = {
    0x70: "SQL Server 7.0",
    0x71: "SQL Server 2000",
    0x72: "SQL Server 2005",
    0x73: "SQL Server 2008",
    0x74: "SQL Server 2012+",
}

ACCOUNT_CONTROL = {"512": "Active", "66048": "Active", "514": "Inactive", "66050": "Inactive"}

ROLE_FLAGS = [
    "sysadmin",
    "securityadmin",
    "serveradmin",
    "setupadmin",
    "processadmin",
    "diskadmin",
    "dbcreator",
    "bulkadmin",
]

COUNTER_OBJECTS = [
    "Buffer Manager",
    "General Statistics",
    "Locks",
    "SQL Statistics",
    "Memory Manager",
    "Wait Statistics",
]

DATABASE_COUNTERS = ["Log Bytes Flushed/sec", "Transactions/sec"]

# End of the fixed values.


def decode(code: Column, table: Mapping, default: str | None = "Unknown") -> Column:
    """Text for a code; unknown and NULL codes give ``default`` (NULL when it is None)."""
    expr = None
    for key, text in table.items():
        expr = F.when(code == F.lit(key), F.lit(text)) if expr is None else expr.when(code == F.lit(key), F.lit(text))
    return expr.otherwise(F.lit(default)) if default is not None else expr
