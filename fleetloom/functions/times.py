"""Time helpers: explicit "as of" time, boundary-counting differences, minute rounding."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AsOf = str | datetime | date | Column | None


def as_of_time(as_of: AsOf) -> Column:
    """The reference moment of a report; the clock only when the caller gives none."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def days_before(as_of: AsOf, days: int) -> Column:
    return as_of_time(as_of) - F.make_dt_interval(F.lit(days))


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed between two instants (not elapsed time cut to seconds)."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def nearest_minute(time: Column) -> Column:
    """Round to the nearest minute, half a minute going up."""
    return F.date_trunc("minute", time.cast("timestamp") + F.make_dt_interval(secs=F.lit(30)))


def with_timestamps(df: DataFrame) -> DataFrame:
    """Turn zone-less timestamp columns into session-zone timestamps."""
    return _recast(df, T.TimestampNTZType, "timestamp")


def without_zones(df: DataFrame) -> DataFrame:
    """Turn timestamps back into zone-less ones, the type the snapshot files use."""
    return _recast(df, T.TimestampType, "timestamp_ntz")


def _recast(df: DataFrame, kind: type, target: str) -> DataFrame:
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(target).alias(f.name) if isinstance(f.dataType, kind) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
