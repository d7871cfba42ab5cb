"""The document operators one after the other: junk out, repeated lines out, near copies out, benchmark passages out, sources mixed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.functions.durable import discard, durable
from fleetloom.llm import contamination, lines, mixing, quality, simhash
from fleetloom.llm.common import learnable, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the documents at hand.

    Without labels or documents to learn from, nothing is rejected.
    """
    may_learn = learnable("doc_id", 3, 1)
    model = quality.fit_quality(docs.where(may_learn), read(spark, sf_dir, "labels").where(may_learn))
    return docs.where(quality.quality_score(F.col("text"), model) >= 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere already; those with no line left are gone."""
    left = lines.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return left


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies have sets of 5-word shingles of similarity 0.8 or more, or are linked by such.
    """
    return simhash.keep_one(docs, find=simhash.alike_documents)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a passage of the benchmark."""
    return contamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix has it, numbered by ``copy``."""
    mixed = mixing.mix(docs).where(F.col("copies") > 0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# The classifier is fitted by descent, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written and read again by the next."""
    docs, before = read(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
