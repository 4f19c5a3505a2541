"""Longitudinal tables: the worked example, blanks, and numbering across ranges."""

import pytest
from pyspark.sql import functions as F

from nubla.operators import structured as G

ROWS = [
    ("4521987", "María", "García López", "12345678A", "15/06/1970", "15/01/2024", "12.5", "H.U. Badajoz", "Dr. Pérez"),
    ("4521987", "María", "García López", "12345678A", "15/06/1970", "15/03/2024", "8.2", "H.U. BADAJOZ", "Dr. Pérez"),
    ("7894561", "Juan", "Martín Ruiz", "87654321B", "22/03/1958", "20/01/2024", "18.7", "H. Mérida", "Dra. Gómez"),
    ("4521987", "María", "García López", "12345678A", "15/06/1970", "15/06/2024", "3.1", "H.U. Badajoz", "Dr. Pérez"),
    ("7894561", "Juan", "Martín Ruiz", "87654321B", "22/03/1958", "20/04/2024", "10.3", "H. Mérida", "Dra. Gómez"),
    ("1122334", "Ana", "Sánchez Díaz", "11223344C", "08/11/1985", "10/02/2024", "15.0", "H.U. Badajoz", "Dr. Pérez"),
]
NAMES = ["NHC", "Nombre", "Apellidos", "DNI", "Fecha_Nacimiento", "Fecha_Visita", "PASI", "Centro", "Medico"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "_row long, " + ", ".join(f"{n} string" for n in NAMES)).cache()


@pytest.fixture(scope="module")
def actions(table):
    found = {r["originalName"]: r["suggestedAction"] for r in G.profile(G.first_values(table, "_row")).collect()}
    assert found == {"NHC": "PATIENT_ID", "Nombre": "REMOVE", "Apellidos": "REMOVE", "DNI": "REMOVE", "Fecha_Nacimiento": "TO_AGE", "Fecha_Visita": "KEEP", "PASI": "KEEP", "Centro": "CODIFY", "Medico": "REMOVE"}
    return found


def test_patient_column(table):
    assert G.patient_column(G.profile(G.first_values(table, "_row"))).first()["originalName"] == "NHC"


def test_anonymised(table, actions):
    out = G.anonymise(table, actions, "_row", "2024-12-15").orderBy("_row").collect()
    assert [(r["ID_ESTUDIO"], r["Visita_Num"], r["Edad"], r["Centro"]) for r in out] == [("PAC_001", 1, 54, "CENTRO_01"), ("PAC_001", 2, 54, "CENTRO_01"), ("PAC_002", 1, 66, "CENTRO_02"), ("PAC_001", 3, 54, "CENTRO_01"), ("PAC_002", 2, 66, "CENTRO_02"), ("PAC_003", 1, 39, "CENTRO_01")]
    assert not {"Nombre", "Apellidos", "DNI", "Medico", "NHC"} & set(out[0].asDict())


def test_correspondence_and_codes(table, actions):
    assert [(r["ID_ESTUDIO"], r["Total_Visitas"], r["NHC"]) for r in G.correspondence(table, actions, "_row").orderBy("ID_ESTUDIO").collect()] == [("PAC_001", 3, "4521987"), ("PAC_002", 2, "7894561"), ("PAC_003", 1, "1122334")]
    assert {(r["original"], r["code"]) for r in G.codes(table, "Centro", "_row").collect()} == {("h.u. badajoz", "CENTRO_01"), ("h. mérida", "CENTRO_02")}


def test_stats_and_validation(table, actions):
    assert tuple(G.table_stats(table, actions).first()) == (6, 3, "2.0", 4, 3, 2)
    assert tuple(G.validation_summary(table, "NHC", "Fecha_Visita", "_row").first()) == (3, 6, "2.0", 1, 2, 0, 0)


def test_blank_and_many(spark):
    rows = spark.range(3000).select(F.col("id").alias("_row"), F.when(F.col("id") % 3 == 0, " ").otherwise((F.col("id") % 2999).cast("string")).alias("p"))
    mapping = G.patient_mapping(rows, "p", "_row").orderBy("first_row").collect()
    assert [r["study_id"] for r in mapping] == [f"PAC_{i:03d}" for i in range(1, len(mapping) + 1)] and len(mapping) == 2000 - 0
    assert G.blank_ids(rows, "p", "_row").count() == 1000


def test_unordered_and_repeated(spark):
    rows = spark.createDataFrame([(1, "a", "02/01/2024"), (2, "a", "01/01/2024"), (3, "a", "01/01/2024"), (4, "b", "x"), (5, "b", "2024-02-03")], "_row int, p string, d string")
    assert [tuple(r) for r in G.unordered_visits(rows, "p", "d", "_row").collect()] == [("a", 2, 1)]
    assert [tuple(r) for r in G.repeated_days(rows, "p", "d", "_row").collect()] == [("a", 3, 2)]


def test_empty_table(spark, actions):
    empty = spark.createDataFrame([], "_row long, " + ", ".join(f"{n} string" for n in NAMES))
    assert G.anonymise(empty, actions, "_row", "2024-12-15").count() == 0 and G.correspondence(empty, actions, "_row").count() == 0


def test_missing_id_column(table):
    with pytest.raises(ValueError, match="PATIENT_ID"):
        G.anonymise(table, {"Nombre": "REMOVE"}, "_row", "2024-12-15")


def test_header_row_by_file(spark):
    rows = spark.createDataFrame([("a", 0, ["1", "2", "3"]), ("a", 1, ["NHC", "Nombre", "Fecha"]), ("b", 0, ["Edad", "x", "y"]), ("c", 0, ["", None, "z"])], "f string, row long, cells array<string>")
    assert {tuple(r) for r in G.header_row(rows, ["f"]).collect()} == {("a", 1), ("b", 0), ("c", 0)}
