"""Loading: sample append, insert-if-absent, upsert, soft delete, retention, dedupe, derived rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import decode, text, times
from fleetloom.functions.ordered import first_per_key
from fleetloom.functions.times import AsOf
from fleetloom.sources import schemas


def _keyed(df: DataFrame, keys: Sequence[str], target: DataFrame) -> DataFrame:
    """Rows with their key as one value, in the target's types; NULL parts of such a value equal each other.

    Reducing copies and joining by the same column costs one shuffle.
    """
    return df.withColumn("_key", F.struct(*[F.col(k).cast(target.schema[k].dataType).alias(k) for k in keys]))


def select_counters(counters: DataFrame) -> DataFrame:
    """Keep the counters worth sampling, names trimmed.

    The non-zero test belongs to the per-database counters only; the other objects keep zeros.
    """
    trimmed = counters.withColumns(
        {"object_name": F.rtrim("object_name"), "counter_name": F.rtrim("counter_name")}
    )
    per_database = (
        F.endswith("object_name", F.lit("Databases"))
        & F.col("counter_name").isin(decode.DATABASE_COUNTERS)
        & (F.col("cntr_value") != 0)
    )
    return trimmed.where(text.ends_with_any(F.col("object_name"), decode.COUNTER_OBJECTS) | per_database)


def append_sample(counters: DataFrame, as_of: AsOf, instance: str | Column | None = None) -> DataFrame:
    """Selected counters stamped with instance and minute-rounded sample time, ready to append.

    ``sample_date`` is the partition column of the log.
    """
    stamped = select_counters(counters)
    if instance is not None:
        stamped = stamped.withColumn(
            "instance_fullname", instance if isinstance(instance, Column) else F.lit(instance)
        )
    return stamped.withColumn("sample_time", times.nearest_minute(times.as_of_time(as_of))).withColumn(
        "sample_date", F.to_date("sample_time")
    )


def dedupe(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """Keep the first row of every key in the given total order."""
    return first_per_key(df, keys, order_by)


def new_rows(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column] | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """Staged rows whose key the target does not have: what an append has to write.

    Copies of a key inside the staging set are reduced to one first (by ``order_by``, or by all other
    columns), before anything is shuffled. With ``null_safe`` a NULL key part equals NULL.
    """
    order = order_by or [c for c in staged.columns if c not in keys] or list(keys)
    if not null_safe:
        return dedupe(staged, keys, order).join(target.select(*keys), list(keys), "left_anti").select(*staged.columns)
    once = dedupe(_keyed(staged, keys, target), ["_key"], order)
    return once.join(_keyed(target, keys, target).select("_key"), "_key", "left_anti").select(*staged.columns)


def insert_new(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str | Column] | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """The target with the absent staged rows added."""
    return target.unionByName(new_rows(target, staged, keys, order_by, null_safe), allowMissingColumns=True)


def unique_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, failing the job when two of them share a key."""
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.any_value(c).alias(c) for c in rest]
    )
    checked = F.assert_true(F.col("_copies") == 1, F.lit(f"staged rows are not unique on {list(keys)}"))
    return counted.where(checked.isNull()).select(*df.columns)


def upsert_latest(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    as_of: AsOf,
    created_col: str | None = "created_on",
    modified_col: str = "modified_on",
    null_safe: bool = True,
    latest_by: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Latest-state table after a load.

    Matched rows take the staged ``update_cols`` and the load time; unmatched target rows stay as
    they are; unknown staged rows are added with the load time in ``created_col``. Columns outside
    ``update_cols`` are never refreshed. One shuffle of each side does both halves of the load.
    Of several staged rows of a key the first by ``latest_by`` counts; without it they fail the job.
    With ``null_safe`` a NULL key part equals NULL.
    """
    moment = times.as_of_time(as_of)
    by = ["_key"] if null_safe else list(keys)
    stored, arrived = (_keyed(df, keys, target) if null_safe else df for df in (target, staged))
    once = first_per_key(arrived, by, latest_by) if latest_by else unique_on(arrived, by)
    old, new = stored.withColumn("_old", F.lit(True)).alias("t"), once.withColumn("_new", F.lit(True)).alias("s")
    equal = reduce(Column.__and__, [F.col(f"t.{c}") == F.col(f"s.{c}") for c in by])
    joined = old.join(new, equal, "full_outer")
    added, matched = F.col("t._old").isNull(), F.col("t._old") & F.col("s._new")

    def value(name: str) -> Column:
        stored = F.col(f"t.{name}")
        arrived = F.col(f"s.{name}") if name in staged.columns else F.lit(None)
        if name == modified_col:
            return F.when(matched, moment).otherwise(stored)
        if name == created_col:
            return F.when(added, moment).otherwise(stored)
        if name in update_cols:
            return F.when(added | matched, arrived).otherwise(stored)
        return F.when(added, arrived).otherwise(stored)

    return joined.select(
        *[value(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    )


def mark_dropped(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    as_of: AsOf,
    ok_sources: Sequence[str] | None = None,
    source_col: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Flag target rows that the staging set no longer has.

    With ``ok_sources`` only rows of sources that answered are judged, so an unreachable source does
    not drop its databases. A row that comes back loses its flag. ``strict`` judges every row and
    never resets a flag.
    """
    present = _keyed(staged, keys, target).select("_key").distinct().withColumn("_present", F.lit(True)).alias("s")
    joined = _keyed(target, keys, target).alias("t").join(present, F.col("t._key") == F.col("s._key"), "left")
    seen = F.col("s._present").isNotNull()
    judged = F.lit(True)
    if ok_sources is not None and not strict:
        judged = F.coalesce(F.col(f"t.{source_col or keys[0]}").isin(list(ok_sources)), F.lit(False))
    gone = judged & ~seen
    back = seen & F.coalesce(F.col("t.is_dropped"), F.lit(False)) & F.lit(not strict)
    new_values = {
        "is_dropped": F.when(gone, True).when(back, False).otherwise(F.col("t.is_dropped")),
        "modified_on": F.when(gone | back, times.as_of_time(as_of)).otherwise(F.col("t.modified_on")),
    }
    return joined.select(*[new_values.get(c, F.col(f"t.{c}")).alias(c) for c in target.columns])


def merge_load(
    target: DataFrame,
    staged: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    as_of: AsOf,
    ok_sources: Sequence[str] | None = None,
    source_col: str | None = None,
    latest_by: Sequence[str | Column] | None = None,
    flag_col: str = "is_dropped",
    created_col: str = "created_on",
    modified_col: str = "modified_on",
) -> DataFrame:
    """A load in one pass: known rows refreshed, new ones added, vanished ones flagged, by one full outer join.

    Rows of both sides take the staged ``update_cols``, lose the flag if they have it, and are modified now. Staged rows
    that are not known are added without the flag, created now. Rows that staging does not have get the flag and are
    modified now, if their source (``source_col``, the first key by default) is among ``ok_sources``, or these are
    not given; rows of sources that did not answer, or without a source, stay as they are. Columns outside
    ``update_cols`` keep what they had at first.

    Copies of a key in staging are reduced to the first by ``latest_by`` (without it they fail the job), by the key of the
    join: each side is shuffled once. NULL key parts equal each other.
    """
    moment = times.as_of_time(as_of)
    stored, arrived = _keyed(target, keys, target), _keyed(staged, keys, target)
    once = first_per_key(arrived, ["_key"], latest_by) if latest_by else unique_on(arrived, ["_key"])
    old, new = stored.withColumn("_old", F.lit(True)).alias("t"), once.withColumn("_new", F.lit(True)).alias("s")
    joined = old.join(new, F.col("t._key") == F.col("s._key"), "full_outer")
    added, matched = F.col("t._old").isNull(), F.col("t._old") & F.col("s._new")
    vanished = F.col("s._new").isNull()
    if ok_sources is not None:
        vanished &= F.coalesce(F.col(f"t.{source_col or keys[0]}").isin(list(ok_sources)), F.lit(False))

    def value(name: str) -> Column:
        before = F.col(f"t.{name}")
        now = F.col(f"s.{name}") if name in staged.columns else F.lit(None)
        if name == flag_col:
            back = F.coalesce(before, F.lit(False)) & matched
            return F.when(added | back, F.lit(False)).when(vanished, F.lit(True)).otherwise(before)
        if name == modified_col:
            return F.when(matched | vanished, moment).otherwise(before)
        if name == created_col:
            return F.when(added, moment).otherwise(before)
        return F.when(added | matched if name in update_cols else added, now).otherwise(before)

    return joined.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields])


def sync_database_master(
    master: DataFrame, staged: DataFrame, as_of: AsOf, ok_sources: Sequence[str] | None = None
) -> DataFrame:
    """The database list after a load: known databases refreshed, new ones added, missing ones flagged.

    ``ok_sources`` are the instances that answered; the databases of others are left alone.
    """
    keys = schemas.DATABASE_MASTER_KEY
    rest = [c for c in staged.columns if c not in keys]
    refreshed = [c for c in rest if c not in schemas.DATABASE_MASTER_FIXED]
    return merge_load(master, staged, keys, refreshed, as_of, ok_sources, latest_by=rest)


def sync_size_log(log: DataFrame, staged: DataFrame, as_of: AsOf) -> DataFrame:
    """The daily size log after a load: sizes of known parts refreshed, new parts and days added."""
    keys, sizes = schemas.DATABASE_SIZE_LOG_DETAILS_KEY, ["used_mb", "reserved_mb"]
    rest = [c for c in staged.columns if c not in keys]
    return upsert_latest(log, staged, keys, sizes, as_of, created_col=None, latest_by=rest)


def retain(
    df: DataFrame, time_col: str, days: int, as_of: AsOf, date_col: str | None = None
) -> DataFrame:
    """Rows younger than ``days``. A row exactly that old goes; a row without a time stays.

    ``date_col`` names the date partition column of the log, so that old partitions are not read.
    """
    cutoff = times.days_before(as_of, days)
    kept = df.where((F.col(time_col) > cutoff) | F.col(time_col).isNull())
    if date_col is not None:
        kept = kept.where((F.col(date_col) >= F.to_date(cutoff)) | F.col(date_col).isNull())
    return kept


def derive_instances(master: DataFrame, instances: DataFrame) -> DataFrame:
    """Instances that live databases mention and the instance list does not have yet."""
    full = F.col("instancefullname")
    mentioned = (
        master.where(~F.col("is_dropped") & full.isNotNull())
        .select(
            full.alias("instance_full_name"),
            text.host_name(full).alias("instance_host"),
            text.instance_name(full).alias("instance_name"),
        )
        .distinct()
    )
    return mentioned.join(instances.select("instance_full_name"), "instance_full_name", "left_anti")


def integrity_history(
    history: DataFrame,
    results: DataFrame,
    instance: str,
    in_scope: DataFrame,
    restamp: bool = False,
) -> DataFrame:
    """History of integrity checks with new result rows appended.

    Rows whose ``dbid`` is in scope get the instance name: the new ones, or with ``restamp`` every
    row of the history too.
    """
    scope = in_scope.select("dbid").distinct().withColumn("_in_scope", F.lit(True))

    def stamped(rows: DataFrame) -> DataFrame:
        before = F.col("instancefullname") if "instancefullname" in rows.columns else F.lit(None).cast("string")
        return (
            rows.join(scope, "dbid", "left")
            .withColumn("instancefullname", F.when(F.col("_in_scope"), F.lit(instance)).otherwise(before))
            .drop("_in_scope")
        )

    if restamp:
        return stamped(history.unionByName(results, allowMissingColumns=True))
    return history.unionByName(stamped(results), allowMissingColumns=True)


def notification_log(log: DataFrame | None, calls: DataFrame, as_of: AsOf, days: int = 365) -> DataFrame:
    """Call records added to the log with an id made from the call time, old records removed."""
    called = calls.withColumn(
        "sessionid", F.date_format("logdatetime", "yyyyMMddHHmmssSSSSS").cast("bigint")
    )
    whole = called if log is None else log.unionByName(called, allowMissingColumns=True)
    return retain(whole, "logdatetime", days, as_of)


def notification_status(log: DataFrame) -> DataFrame:
    """Calls per application and status."""
    return log.groupBy("appname", "staustext").agg(
        F.count(F.lit(1)).alias("calls"), F.max("logdatetime").alias("last_call")
    )
