"""Fan-in: one staging set from many servers, with the failing ones recorded and skipped."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.functions.durable import shared_folder
from fleetloom.sources.schemas import HEALTH_CHECK

Reader = Callable[[SparkSession], DataFrame]

ERRORS = "process_name STRING, object_ref STRING, error_msg STRING"


@dataclass(frozen=True)
class FleetResult:
    """``data`` of the sources that answered, ``errors`` (one row per failure), names that answered."""

    data: DataFrame
    errors: DataFrame
    ok_sources: list[str]


def fleet_union(
    spark: SparkSession,
    sources: Mapping[str, Reader],
    schema: str,
    process_name: str = "fleet_union",
    source_col: str = "source",
    at_once: int = 8,
) -> FleetResult:
    """Append the same projection of every source to one staging table.

    Every source is written to a folder of its own, several at a time: a source that fails, at
    planning or in the middle of its job, leaves an error row and no data. The staging folders are
    then read back as one table, each row tagged with its source.
    """
    wanted = T.StructType.fromDDL(schema)
    staging = shared_folder(spark, "fleet")

    def stage(numbered: tuple[int, str]) -> tuple[str, str, str | None]:
        number, name = numbered
        folder = f"{staging}/{number}"
        try:
            rows = sources[name](spark)
            missing = [f.name for f in wanted if f.name not in rows.columns]
            if missing:
                raise ValueError(f"columns missing: {', '.join(missing)}")
            rows.select(
                *[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted], F.lit(name).alias(source_col)
            ).write.parquet(folder)
            return name, folder, None
        except Exception as error:  # the contract: one bad source never stops the others
            return name, folder, str(error)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        staged = list(pool.map(stage, enumerate(sources)))

    tagged = T.StructType([*wanted.fields, T.StructField(source_col, T.StringType())])
    good = [(name, folder) for name, folder, error in staged if error is None]
    data = (
        spark.read.schema(tagged).parquet(*[folder for _, folder in good])
        if good
        else spark.createDataFrame([], tagged)
    )
    failed = [(process_name, name, error) for name, _, error in staged if error is not None]
    return FleetResult(data, spark.createDataFrame(failed, ERRORS), [name for name, _ in good])


def health_check_union(
    spark: SparkSession, sources: Mapping[str, Reader], schema: str = HEALTH_CHECK
) -> FleetResult:
    """Health-check rows of every server that has the health-check object, tagged with its name."""
    return fleet_union(spark, sources, schema, "health_check_union", source_col="instance_name")
