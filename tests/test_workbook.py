"""Workbooks: what is written by many tasks is read again; failures leave nothing."""

import os
import random
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from nubla.sources import sinks, workbook
from nubla.sources.readers import read_xlsx, sheet_cells
from nubla.sources.workbook import cell_text, write_workbook

NS = {"m": workbook.MAIN}


def sheets(path):
    """{name: rows} of all sheets of a file, checked to be well formed."""
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {"[Content_Types].xml", "_rels/.rels", "xl/_rels/workbook.xml.rels"} <= set(z.namelist())
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{workbook.MAIN}}}sheet")]
        out = {}
        for i, name in enumerate(names, 1):
            rows = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iterfind(".//m:row", NS)
            out[name] = [[c.findtext("m:v", None, NS) if c.get("t") is None else cell_text("".join(t.text or "" for t in c.iter(f"{{{workbook.MAIN}}}t"))) for c in r.iterfind("m:c", NS)] for r in rows]
    return out


def test_hostile_cells(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: "".join(rng.choices('aé<>&"\'\n\r\t\x00\x1f _x0041_😀,;￾', k=rng.randint(0, 12)))
    rows = [(i, text() or None, rng.choice([None, 0.5, -3.0, float("nan"), 1e300]), 10**17 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "n long, `a.b ``c` string, d double, big long").repartition(7)
    path = str(tmp_path / "t.xlsx")
    write_workbook([("Datos", df, "n", True), ("Con n", df.filter("n < 3"), F.col("n"), True), ("Vacía", df.filter("false"), "n", True), ("Líneas", df.select("n", "d"), "n", False)], path)
    got = sheets(path)
    shown = lambda d: None if d is None else "nan" if d != d else f"{d:.15g}"
    assert list(got) == ["Datos", "Con n", "Vacía", "Líneas"] and got["Datos"][0] == ["a.b `c", "d", "big"] == got["Vacía"][0] and len(got["Vacía"]) == 1
    assert got["Datos"][1:] == [[s, shown(d), str(b)] for _, s, d, b in rows]
    assert got["Con n"] == [["n", "a.b `c", "d", "big"]] + [[str(i), s, shown(d), str(b)] for i, s, d, b in rows[:3]]
    assert [r[0] for r in got["Líneas"]] == [shown(d) for _, _, d, _ in rows]
    assert os.listdir(tmp_path) == ["t.xlsx"] and sheet_cells(open(path, "rb").read())[0] == ["a.b `c", "d", "big"]
    with pytest.raises(Exception, match="FileExists"):
        write_workbook([("x", df, "n", True)], path)
    write_workbook([("x", df.limit(1), "n", True)], path, overwrite=True)
    assert list(sheets(path)) == ["x"]


def test_failures_leave_nothing(spark, tmp_path):
    df = spark.range(100).withColumn("t", F.when(F.col("id") == 77, F.repeat(F.lit("x"), 40_000)).otherwise("y"))
    for name, bad in (("long", df), ("columns", spark.range(3).select("id", *[F.lit(1).alias(f"c{i}") for i in range(10)]))):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(workbook, "SHEET_COLUMNS", 5)
            with pytest.raises(Exception):  # noqa: B017
                write_workbook([("t", bad, "id", True)], str(tmp_path / f"{name}.xlsx"))
    for names in (["a", "A"], ["x/y"], [""], ["n" * 32]):
        with pytest.raises(Exception):  # noqa: B017
            write_workbook([(n, spark.range(1), "id", True) for n in names], str(tmp_path / "n.xlsx"))
    assert os.listdir(tmp_path) == []


def test_full_sheets_go_on(tmp_path, monkeypatch):
    """The writer by itself: fragments of two partitions, and of a task that ran twice, of which one counts."""
    monkeypatch.setattr(workbook, "SHEET_ROWS", 4)
    cell = lambda t: type("C", (), {"text": t, "number": None})
    row = lambda t: type("R", (), {"sheet": 0, "cells": [cell(t)]})
    writer = workbook.WorkbookWriter(str(tmp_path / "w.xlsx"), ["d"])
    lost = writer.write(iter([row("lost")]))
    parts = [writer.write(iter(map(row, own))) for own in (["head", "1", "2"], ["3", "4", "5", "6"])]
    parts[0].partition, parts[1].partition = 0, 1
    assert lost.found and len(os.listdir(tmp_path)) == 1
    writer.commit([parts[1], parts[0], None])
    got = sheets(tmp_path / "w.xlsx")
    assert got == {"d": [["head"], ["1"], ["2"], ["3"]], "d (2)": [["head"], ["4"], ["5"], ["6"]]} and os.listdir(tmp_path) == ["w.xlsx"]


def test_sheets_that_go_on_are_read(spark, tmp_path, monkeypatch):
    """The table of full sheets is read whole, in order and without their headers; other sheets are not part of it, nor are
    those that are only called so."""
    monkeypatch.setattr(workbook, "SHEET_ROWS", 4)
    number = lambda t: type("C", (), {"text": None, "number": t})
    cell = lambda t: type("C", (), {"text": t, "number": None})
    row = lambda s, *c: type("R", (), {"sheet": s, "cells": list(c)})
    head = [row(0, cell("NHC"), cell("Nombre"), cell("Visita"))]
    for name, n in (("a", 40), ("b", 4), ("c", 7)):
        writer = workbook.WorkbookWriter(str(tmp_path / f"{name}.xlsx"), ["d", "Info"])
        own = [row(0, cell(f"{name}{i}"), cell("Ana" if i % 5 else ""), number(float(i))) for i in range(n - 1)]
        writer.commit([writer.write(iter([*head, *own, *[row(1, cell("x"), cell("y"), cell("z")) for _ in range(6)]]))])
    assert list(sheets(tmp_path / "a.xlsx"))[:13] == ["d", *[f"d ({i})" for i in range(2, 14)]]
    assert len(sheet_cells((tmp_path / "a.xlsx").read_bytes())) == 40 and len(sheet_cells((tmp_path / "b.xlsx").read_bytes())) == 4
    table = read_xlsx(spark, str(tmp_path))
    rows = [tuple(r) for r in table.orderBy("_row").collect()]
    assert [r[:3] for r in rows] == [(f"{name}{i}", "Ana" if i % 5 else "", str(i)) for name, n in (("a", 40), ("b", 4), ("c", 7)) for i in range(n - 1)]
    assert [r[3] for r in rows] == [(k << 32) + i + 1 for k, n in enumerate((40, 4, 7)) for i in range(n - 1)]
    copy = tmp_path / "copy.xlsx"
    with zipfile.ZipFile(tmp_path / "c.xlsx") as z, zipfile.ZipFile(copy, "w") as out:
        for n in z.namelist():
            out.writestr(n, re.sub(rb"<definedNames>.*</definedNames>", b"", z.read(n)))
    assert [r[0] for r in sheet_cells(copy.read_bytes())] == [r[0] for r in sheets(copy)["d"]] == ["NHC", "c0", "c1", "c2"]
    broken = tmp_path / "u.xlsx"
    with zipfile.ZipFile(broken, "w") as out:
        out.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{workbook.MAIN}"><sheetData><row><c t="inlineStr"><is><t>abc</t></is></c></row></sheetData></worksheet>')
    broken.write_bytes(broken.read_bytes().replace(b"abc", b"abd"))
    with pytest.raises(Exception, match="CRC|broken"):
        read_xlsx(spark, str(broken)).collect()


def test_sinks_as_workbooks(spark, tmp_path):
    rows = [(0, "7", "Ana", "01/02/2024", " Sur"), (1, "8", "Luis", "02/02/2024", "norte"), (2, "7", "Ana", "03/02/2024", "SUR")]
    table = spark.createDataFrame(rows, "_row long, nhc string, nombre string, fecha string, centro string")
    actions = {"nhc": "PATIENT_ID", "nombre": "REMOVE", "fecha": "KEEP", "centro": "CODIFY"}
    sinks.write_anonymised(table, actions, "_row", "2024-12-15", str(tmp_path / "a.xlsx"), "xlsx")
    sinks.write_correspondence(table, actions, "_row", str(tmp_path / "c.xlsx"), "xlsx")
    a, c = sheets(tmp_path / "a.xlsx"), sheets(tmp_path / "c.xlsx")
    assert a["Datos"] == [["ID_ESTUDIO", "Visita_Num", "fecha", "centro"], ["PAC_001", "1", "01/02/2024", "CENTRO_01"], ["PAC_002", "1", "02/02/2024", "CENTRO_02"], ["PAC_001", "2", "03/02/2024", "CENTRO_01"]]
    assert ["Registros totales", "3"] in a["Info"] and ["Pacientes únicos", "2"] in a["Info"]
    assert list(c) == ["LEER PRIMERO", "Correspondencia", "Cod_centro", "Mapeo_Columnas"] and c["LEER PRIMERO"] == [[w] for w in sinks.WARNING]
    assert [r[0] for r in c["Correspondencia"]] == ["ID_ESTUDIO", "PAC_001", "PAC_002"]
    assert c["Cod_centro"] == [["Código", "Valor_Original"], ["CENTRO_01", "sur"], ["CENTRO_02", "norte"]]
    assert c["Mapeo_Columnas"] == [["Columna_Original", "Acción", "Columna_Final"], ["nhc", "PATIENT_ID", "ID_ESTUDIO"], ["nombre", "REMOVE", "[ELIMINADA]"], ["fecha", "KEEP", "fecha"], ["centro", "CODIFY", "centro"]]
    assert read_xlsx(spark, str(tmp_path / "a.xlsx")).drop("_row").columns == a["Datos"][0]
