"""What the document operators share: reading, folds, words, bounded samples."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.session import tune

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Python workers get at most so many texts at once: a batch of the longest texts still fits.
BATCH_ROWS = 1000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of a folder, under the session settings the operators rely on."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def document_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Id and text, which name a document: rows that repeat both are one document."""
    return [
        F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("key"),
        F.xxhash64(text_or_empty(text_col)).alias("text_hash"),
    ]


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds. NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string")) % folds


def in_fold(column: str, folds: int, remainder: int) -> Column:
    """Whether the id is in the fold; a row without an id is in none."""
    return F.coalesce(fold(column, folds) == remainder, F.lit(False))


def learnable(column: str, folds: int, held_out: int) -> Column:
    """Whether models may learn from the row: it has an id and is not held out."""
    return F.coalesce(fold(column, folds) != held_out, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows (or all, if fewer) with the smallest hashes of their key: the same ones in every run.

    Rows far from being drawn leave by a threshold on the hash, so that what is sorted is about
    twice the sample, whatever the size of the table.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30))
    total = rows.count()
    share = min(1.0, (2 * size + 100) / max(total, 1))
    drawn = rows.withColumn("_draw", draw).where(F.col("_draw") < int(share * (1 << 30)))
    return drawn.orderBy("_draw", key).limit(size).drop("_draw")
