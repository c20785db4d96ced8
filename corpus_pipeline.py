"""A corpus pipeline of five operators. Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs``; what
it returns is written as Parquet and read again as the next one's input. All but the last return the columns of documents.

The tables that a stage has written on its way are deleted when the next one is called, as its output has been written by then.

Defined results: every stage takes an empty table, null values and repeated rows as its operator does, and carries extra
columns whatever their names; no stage looks at what another has decided but through the rows that it is given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm._shared import give_back
from grainmill.llm.decontaminate import drop_contaminated
from grainmill.llm.exact_content import drop_exact_duplicates
from grainmill.llm.language import keep_identified
from grainmill.llm.mixing import mix
from grainmill.llm.simhash import drop_near_duplicates
from grainmill.tables import collected, delete, new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: dict[str, list[str]] = {}


def stage(function: Stage) -> Stage:
    """A stage that deletes the tables of the one before, and gives back the driver's memory that this has freed."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        for path in _before.pop(app, []):
            delete(spark, path)
        give_back()
        with collected() as _before[app]:
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that look like no known language."""
    return keep_identified(docs, known=True)


@stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs, keep="largest")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return drop_near_duplicates(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their target weights; ``copy`` numbers a document's copies."""
    return mix(docs, power=0.7, unit="chars", seed=2024)


STAGES = [
    ("language ID", language_id),
    ("exact duplicates", exact_duplicates),
    ("SimHash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
]

#: The kernel classifier and the latent space can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        path = new_path(spark, name.split()[0].lower())
        function(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
