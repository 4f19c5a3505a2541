"""The mapping of patients over a stream of notes: one label for each patient, whichever notes come first.

Patients are keyed state: each has its label, how many notes name it, and which (in a map of the state store, not in memory).
So it doesn't matter how the stream is split into batches, and a restart goes on from the checkpoint. A patient who isn't named
for the time given as ``expiry`` is forgotten, which bounds the state; without it the state grows with the patients.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from nubla.functions.text import trim_space

MAPPED = "patient string, label string, documents long, seen timestamp"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Patients(StatefulProcessor):
    def __init__(self, expiry_ms: int | None):
        self.expiry = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "label string, documents long", self.expiry)
        self.notes = handle.getMapState("notes", "note string", "seen boolean", self.expiry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        label, documents = self.known.get() if self.known.exists() else (None, 0)
        for frame in rows:
            for note, own in frame.groupby("note")["label"].min().items():
                if not self.notes.containsKey((note,)):
                    documents += 1
                self.notes.updateValue((note,), (True,))
                label = own if label is None else min(label, own)
        self.known.update((label, documents))
        yield pd.DataFrame({"patient": [key[0]], "label": [label], "documents": [documents], "seen": [pd.Timestamp.now()]})

    def close(self) -> None:
        pass


def patient_rows(done: DataFrame, key: str) -> DataFrame:
    """(patient, note, label) of the patients in ``pseudonymise``'s entities, once for each note."""
    found = done.select(F.col(key).cast("string").alias("note"), F.explode_outer(F.filter("entities", lambda e: e["subtype"] == "paciente")).alias("e")).filter("e is not null")
    return found.select(trim_space(F.lower("e.text")).alias("patient"), "note", F.col("e.transformed").alias("label"))


def patient_map(done: DataFrame, key: str, expiry_ms: int | None = None) -> DataFrame:
    """A row (patient, label, documents, seen) for each patient that a batch of the stream names, with what is known since.

    ``done``: the stream of ``pseudonymise``; ``key``: what tells notes apart (repeated notes count once). expiry_ms: how
    long a patient is kept without being named; the label starts anew after that. Sets the session's state store to RocksDB.
    """
    done.sparkSession.conf.set(*STORE)
    grouped = patient_rows(done, key).groupBy("patient")
    return grouped.transformWithStateInPandas(Patients(expiry_ms), MAPPED, "Update", "ProcessingTime" if expiry_ms else "None")


def write_patient_map(mapped: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there: each batch a folder of its number, written anew if the batch is run again; start again with the
    same checkpoint for the rest."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return mapped.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def read_patient_map(spark: SparkSession, path: str) -> DataFrame:
    """(patient, label, documents): the last that was written of each patient."""
    rows = spark.read.option("basePath", path).schema(f"{MAPPED}, batch int").parquet(path)
    last = Window.partitionBy("patient").orderBy(F.desc("batch"))
    return rows.withColumn("nth", F.row_number().over(last)).filter("nth = 1").select("patient", "label", "documents")
