"""Patients of a stream: the batch's mapping from any split, restarts included; expiry."""

import pandas as pd
import pytest

from nubla.plans.batch import patient_names
from nubla.plans.pipeline import pseudonymise
from nubla.plans.relations import notes
from nubla.streaming import notes as N
from nubla.streaming import patients as P


@pytest.mark.parametrize("files", [1, 100])
def test_any_split_gives_the_batch(spark, small, tmp_path, files):
    rows = notes(spark, small).filter("note_id < 120").withColumnRenamed("note_id", "name").cache()
    parts = [rows.filter(f"name % 3 = {i}") for i in range(3)] + [rows.filter("name % 7 = 0")]  # some notes twice
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(source)
        if i in (1, 3):  # ends and starts again between them
            stream = N.pseudonymised(N.read_notes(spark, source, "name long, text string", files_per_trigger=files))
            P.write_patient_map(P.patient_map(stream, "name"), out, checkpoint).awaitTermination()
    expected = {tuple(r) for r in patient_names(pseudonymise(rows)).select("patient", "label", "documents").collect()}
    assert {tuple(r) for r in P.read_patient_map(spark, out).collect()} == expected and len(expected) > 5


class State:
    def __init__(self):
        self.value = None

    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value


class Map(dict):
    containsKey = dict.__contains__  # noqa: N815
    updateValue = dict.__setitem__  # noqa: N815


def test_state_and_expiry():
    class Handle:
        def getValueState(self, name, schema, ttl):  # noqa: N802
            assert ttl == 5000
            return State()

        def getMapState(self, name, key, value, ttl):  # noqa: N802
            assert ttl == 5000
            return Map()

    p = P.Patients(5000)
    p.init(Handle())
    frame = lambda *rows: pd.DataFrame(rows, columns=["patient", "note", "label"])
    (a,) = p.handleInputRows(("ana",), iter([frame(("ana", "1", "B"), ("ana", "1", "A")), frame(("ana", "2", "C"))]), None)
    (b,) = p.handleInputRows(("ana",), iter([frame(("ana", "2", "C"))]), None)
    assert list(a.iloc[0])[:3] == ["ana", "A", 2] == list(b.iloc[0])[:3]
    p.close()


def test_notes_of_one_file_are_dealt_out(spark, small, tmp_path):
    """A file of one partition is work for all cores, and none of its notes is lost."""
    notes(spark, small).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    stream = N.read_notes(spark, str(tmp_path / "in"), "note_id long, text string", files_per_trigger=1)
    put = lambda rows, batch: found.extend(rows.selectExpr("note_id", "spark_partition_id() as part").collect())
    stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    assert len({r["part"] for r in found}) == spark.sparkContext.defaultParallelism > 1
    assert sorted(r["note_id"] for r in found) == sorted(r["note_id"] for r in notes(spark, small).select("note_id").collect())
