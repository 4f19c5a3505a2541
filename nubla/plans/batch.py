"""Batches of documents: every file on its way, and one mapping of patients over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubla.functions.text import trim_space
from nubla.plans.pipeline import Config, pseudonymise
from nubla.sources.readers import read_documents


def process_folder(spark: SparkSession, path: str, config: Config | None = None) -> DataFrame:
    """The documents at ``path`` with their entities and new texts; those that could not be read keep their error."""
    docs = read_documents(spark, path)
    done = pseudonymise(docs, config)
    return done.withColumn("processed", F.when(F.col("status") == "completed", F.col("processed")))


def patient_names(done: DataFrame, key: str = "name") -> DataFrame:
    """(patient, label, documents): every patient's name over the batch, without regard to case.

    The label depends on the name alone, so all documents agree on it.
    """
    found = done.select(key, F.inline_outer(F.filter("entities", lambda e: e["subtype"] == "paciente"))).filter("start is not null")
    found = found.select(key, trim_space(F.lower("text")).alias("patient"), F.col("transformed").alias("label"))
    return found.groupBy("patient").agg(F.min("label").alias("label"), F.count_distinct(key).alias("documents"))


def queue_status(done: DataFrame) -> DataFrame:
    return done.groupBy("status").agg(F.count("*").alias("documents"))
