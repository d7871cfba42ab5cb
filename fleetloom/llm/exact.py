"""Exact deduplication of texts that holds up when one text is a third of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.durable import durable
from fleetloom.llm.common import SPACES, text_or_empty


def normalised(text_col: str = "text") -> Column:
    """The text with every run of ASCII white space as one space; NULL as the empty text."""
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Which row of every group of equal texts stays: the one with the smallest id.

    One row per input row: ``doc_id, keep_id, group_size, kept, digest``. Rows are combined three times,
    and each time the whole text is compared, not the digest alone:

    1. within a map task (the partial aggregate), so that a text leaves it once however often it occurs;
    2. by digest, text and a salt of the task, so that not even the copies that each of very many
       tasks lets through meet in one place;
    3. the winners of the salts, by digest. A digest whose texts are not all the same is kept apart, and
       its documents are grouped by text.

    What goes back to the documents is a digest and two numbers. NULL texts count as empty. Rows
    without an id never win against rows with one; a group that has only such rows has a NULL
    ``keep_id`` and keeps them. Repeated rows of one id and text are one document, reported as often
    as it occurs. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("text")).withColumn("digest", digest(F.col("text")))
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = durable(
        salted.groupBy("digest").agg(
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            (F.min("text") != F.max("text")).alias("clash"),
        )
    )
    plain = rows.select("doc_id", "digest").join(winners.where(~F.col("clash")).drop("clash"), "digest")
    clashing = winners.where("clash").select("digest")
    if not clashing.isEmpty():
        apart = rows.join(clashing, "digest", "left_semi")
        by_text = apart.groupBy("digest", "text").agg(
            F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        plain = plain.unionByName(apart.join(by_text, ["digest", "text"]).drop("text"))
    return plain.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
