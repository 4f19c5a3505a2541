"""Notes as a stream: all note operators are narrow, so a stream goes the way of a table; counts take a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nubla.plans.pipeline import Config, pseudonymise


def read_notes(spark: SparkSession, path: str, schema: str, form: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """The notes of the files at ``path``, as they come: a small file is one partition, but each note costs milliseconds, so they
    are dealt out to all cores."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path).repartition(spark.sparkContext.defaultParallelism)


def pseudonymised(stream: DataFrame, config: Config | None = None, text: str = "text") -> DataFrame:
    return pseudonymise(stream, config, text).drop("candidates")


def entity_counts(done: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Entities by type in each window of event time; what is later than ``late`` is left out."""
    # Outer, so that Spark doesn't compute the entities a second time to see whether there are any.
    rows = done.withWatermark(time, late).select(time, F.explode_outer("entities").alias("e")).filter("e is not null")
    return rows.groupBy(F.window(time, window), F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


def write_notes(done: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Append what is there and end; start again with the same checkpoint for the rest."""
    return done.writeStream.format(form).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
