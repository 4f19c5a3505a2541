"""Files in and out, batches and streams."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from nubla.operators.review import apply_decisions, highlighted, reviewed_documents
from nubla.operators.substitute import as_day, transform_entity
from nubla.plans.batch import patient_names, process_folder, queue_status
from nubla.plans.pipeline import pseudonymise
from nubla.sources import readers, sinks
from nubla.streaming import notes as N


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('NHC;Nombre ;Nota\n1; Ana ;"a;b ""c"""\n\n2;Luis\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path / "t.csv")).orderBy("_row").collect()
    assert [(r["NHC"], r["Nombre"], r["Nota"]) for r in rows] == [("1", "Ana", 'a;b "c"'), ("2", "Luis", None)]
    assert readers.separator("a,b;c") == "," and readers.separator("a\tb\tc,d") == "\t"


def test_csv_files_in_order(spark, tmp_path):
    for name, rows in (("b", "3;Eva\n4;Luz"), ("a", "1;Ana\n2;Luis")):
        (tmp_path / f"{name}.csv").write_text("NHC;Nombre\n" + rows + "\n", encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path)).orderBy("_row").collect()
    assert [r["NHC"] for r in rows] == ["1", "2", "3", "4"] and len({r["_row"] for r in rows}) == 4


def test_table_by_extension(spark, tmp_path):
    (tmp_path / "t.csv").write_text("NHC,x\n1,2\n", encoding="utf-8")
    _xlsx(tmp_path / "t.xlsx")
    assert readers.read_table(spark, str(tmp_path / "t.csv")).first()["x"] == "2" and readers.read_table(spark, str(tmp_path / "t.xlsx")).first()["NHC"] == "77"
    with pytest.raises(ValueError, match="formato no soportado"):
        readers.read_table(spark, str(tmp_path / "t.ods"))


def test_examples(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": 1, "texto": "DNI 12345678A"}', encoding="utf-8")
    assert readers.read_examples(spark, str(tmp_path)).first()["text"] == "DNI 12345678A"


def _xlsx(path, rows=None):
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    rows = rows or [[("A1", "Informe")], [("A2", "NHC"), ("B2", "Nombre"), ("D2", "Fecha")], [("A3", "77"), ("B3", "Ana"), ("D3", "1/2/2024")]]
    body = "".join(f"<row>{''.join(cell(*c) for c in r)}</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    _xlsx(tmp_path / "t.xlsx")
    row = readers.read_xlsx(spark, str(tmp_path / "t.xlsx")).first()
    assert (row["NHC"], row["Nombre"], row["columna_3"], row["Fecha"]) == ("77", "Ana", "", "1/2/2024")


def test_xlsx_files_with_own_headers(spark, tmp_path):
    """Header rows and columns differ by workbook; the order is that of files and rows."""
    _xlsx(tmp_path / "b.xlsx")
    _xlsx(tmp_path / "a.xlsx", [[("A1", "Nombre"), ("B1", "NHC"), ("C1", "Edad"), ("D1", "Edad")], [("A2", "Luz"), ("B2", "5"), ("C2", "40"), ("D2", "41")], [("A3", "Eva"), ("B3", "6"), ("C3", "50")]])
    table = readers.read_xlsx(spark, str(tmp_path))
    assert table.columns == ["Nombre", "NHC", "Edad", "Edad_4", "columna_3", "Fecha", "_row"]
    assert [tuple(r)[:6] for r in table.orderBy("_row").collect()] == [("Luz", "5", "40", "41", "", ""), ("Eva", "6", "50", "", "", ""), ("Ana", "77", "", "", "", "1/2/2024")]
    assert table.select("_row").distinct().count() == 3


def test_large_xlsx_is_an_error(spark, tmp_path, monkeypatch):
    _xlsx(tmp_path / "t.xlsx")
    _xlsx(tmp_path / "u.xlsx")
    with open(tmp_path / "u.xlsx", "ab") as f:
        f.write(b" " * 5000)
    monkeypatch.setattr(readers, "TABLE_BYTES", 5000)
    with pytest.raises(ValueError, match="u.xlsx"):
        readers.read_xlsx(spark, str(tmp_path))


def test_batch(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("Paciente Ana López, DNI 12345678A.", encoding="utf-8")
    (folder / "b.pdf").write_bytes(b"x")
    with zipfile.ZipFile(folder / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Paciente Ana López.</w:t></w:r></w:p></w:body></w:document>')
    done = process_folder(spark, str(folder)).cache()
    assert {(r["status"], r["documents"]) for r in queue_status(done).collect()} == {("completed", 2), ("error", 1)}
    assert [tuple(r) for r in patient_names(done).collect()] == [("ana lópez", "Paciente Mujer", 2)]
    sinks.write_summary(done, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    assert sinks.report(done, "name").count() == 3


def test_review(spark):
    done = pseudonymise(spark.createDataFrame([(1, "DNI 12345678A <b> en Sevilla")], "id int, text string"))
    decisions = spark.createDataFrame([(1, 0, "restore", None, None), (1, 1, "modify", "Sur", "x")], "id int, idx int, action string, value string, notes string")
    assert apply_decisions(done, decisions, "id").first()["processed"] == "DNI 12345678A <b> en Sur"
    assert highlighted(done).first()["html"] == 'DNI <mark data-type="IDENTIFICADOR">12345678A</mark> &lt;b&gt; en <mark data-type="UBICACION">Sevilla</mark>'


def test_review_status_and_single_labels(spark):
    done = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    assert [tuple(r) for r in reviewed_documents(done, done.filter("id = 2").unionByName(done.filter("id = 2")), "id").select("id", "reviewed").orderBy("id").collect()] == [(1, False), (2, True)]
    rows = spark.createDataFrame([("Dr. Ruiz", "NOMBRE", "profesional"), ("Ana", "NOMBRE", "paciente"), ("01/01/2024", "FECHA", "fecha_completa"), ("Teruel", "UBICACION", "ciudad")], "text string, type string, subtype string")
    assert [r[0] for r in rows.select(transform_entity(F.col("text"), F.col("type"), F.col("subtype"), as_day("2026-01-01"))).collect()] == ["Profesional Sanitario 1", "Paciente Mujer", "Visita 1 (hace 2 años)", "Ciudad A"]


def test_correspondence_files(spark, tmp_path):
    table = spark.createDataFrame([(1, "7", "Ana", "Sur"), (2, "7", "Ana", "Sur")], "_row int, nhc string, nombre string, centro string")
    sinks.write_correspondence(table, {"nhc": "PATIENT_ID", "nombre": "REMOVE", "centro": "CODIFY"}, "_row", str(tmp_path / "c"))
    read = lambda name: [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c" / name)).collect()]
    assert read("correspondencia") == [("PAC_001", "2", "Ana", "7")] or read("correspondencia") == [("PAC_001", "2", "7", "Ana")]
    assert read("cod_centro") == [("sur", "CENTRO_01")] and len(read("aviso")) == len(sinks.WARNING)


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "DNI 12345678A"), (2, None)], "id int, text string").write.parquet(source)
    N.write_notes(N.pseudonymised(N.read_notes(spark, source, "id int, text string")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["processed"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("processed")).collect()} == {"DNI ", ""}


def cells_by_hand(line, sep):
    out, cell, inside, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and inside and line[i + 1 : i + 2] == '"':
            cell, i = cell + '"', i + 1
        elif c == '"':
            inside = not inside
        elif c == sep and not inside:
            out, cell = [*out, cell.strip()], ""
        else:
            cell += c
        i += 1
    return [*out, cell.strip()]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_cells_of_hostile_lines(spark, sep):
    rng = random.Random(2)
    lines = ["", sep, '"', '""', '"""', f'a{sep}"b', f'"a{sep}b"c{sep}{sep}', f'x"y{sep}z"{sep}"""q"""', f"{sep}a{sep}"]
    lines += ["".join(rng.choices('ab "' + sep * 2 + '"ñ\\$', k=rng.randint(0, 25))) for _ in range(800)] + ['"' * 50_001 + sep, ("x" + sep) * 20_000, '"' + "y" * 100_000]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", F.expr(readers.cells_sql("line", sep)).alias("c")).collect()
    assert all(r["c"] == cells_by_hand(lines[r["i"]], sep) for r in got) and len(got) == len(lines)


def test_csv_of_several_parts(spark, tmp_path):
    """Files dealt out in parts of a few lines: headers go, order stays, ragged rows keep what they have."""
    for name in "ba":
        rows = [f'{name}{i};"v;{i}"' + (";more;" * (i % 3)) if i % 4 else f"{name}{i}" for i in range(400)]
        (tmp_path / f"{name}.csv").write_bytes(("﻿ \r\n" + "id; val ;;id\r\n\r\n" + "\r\n".join(rows) + "\r\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        table = readers.read_csv(spark, str(tmp_path), extra="rest")
        got = table.orderBy("_row").collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert table.columns == ["id", "val", "columna_3", "id_4", "rest", "_row"]
    assert [r["id"] for r in got] == [f"{n}{i}" for n in "ab" for i in range(400)] and len({r["_row"] for r in got}) == 800
    for r in got:
        i = int(r["id"][1:])
        line = f'{r["id"]};"v;{i}"' + (";more;" * (i % 3)) if i % 4 else r["id"]
        cells = cells_by_hand(line, ";")
        assert [r["id"], r["val"], r["columna_3"], r["id_4"]] == (cells + [None] * 4)[:4] and r["rest"] == cells[4:]
