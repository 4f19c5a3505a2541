"""Workbooks (.xlsx) of several sheets, written by many tasks.

A data source of rows (sheet, place, cells): each task turns its rows into the XML of a fragment for each sheet, in a folder
beside the target; the commit joins the fragments of the tasks that succeeded, in the order of sheets and partitions, into one
file, and renames it. A task that is run again writes fragments of its own, which count instead; a failed write leaves nothing.
The commit copies fragment by fragment: what it holds at once doesn't grow with the table. A sheet that is full
(``SHEET_ROWS``) is followed by another of the same header, and the workbook keeps how many rows each has (a hidden name,
``ROWS_NAME``), by which ``readers`` tells what belongs together. The path lies on a file system that all executors mount.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SHEET_ROWS, SHEET_COLUMNS, CELL_CHARS, NAME_CHARS = 1 << 20, 1 << 14, 32_767, 31
CELLS = "sheet int, place long, cells array<struct<text:string,number:double>>"
UNFIT = re.compile(r"[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
ROWS_NAME = "_nubla_rows"
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def cell_xml(text: str | None, number: float | None) -> str:
    if number is not None and number == number and abs(number) != float("inf"):
        return f"<c><v>{number:.15g}</v></c>"
    text = text if text is not None else "" if number is None else str(number)
    if not text:
        return "<c/>"
    if len(text) > CELL_CHARS:
        raise ValueError(f"a cell of {len(text)} characters; {CELL_CHARS} fit")
    fit = UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(fit)}</t></is></c>'


def cell_text(text: str) -> str:
    """A cell's text as it was before characters that XML doesn't allow were named."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def part_name(name: str, part: int) -> str:
    """What the sheet ``name`` is called where it goes on, from 1."""
    return name if part == 1 else f"{name[: NAME_CHARS - len(f' ({part})')]} ({part})"


@dataclass
class Fragments(WriterCommitMessage):
    """What a task wrote: its partition, and (sheet, rows, file) of each fragment."""

    partition: int
    found: list[tuple[int, int, str]]


class Workbook(DataSource):
    """``workbook``, to be written with the options ``path`` and ``sheets``, the names with tabs between."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        return WorkbookWriter(path, self.options["sheets"].split("\t"))


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, sheets: list[str]):
        if len({s.lower() for s in sheets}) < len(sheets) or any(not s or len(s) > NAME_CHARS or re.search(r"[\[\]:*?/\\]", s) for s in sheets):
            raise ValueError(f"not fit as names of sheets: {sheets}")
        self.path, self.sheets, self.parts = path, sheets, f"{path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Fragments:
        os.makedirs(self.parts, exist_ok=True)
        found, out, now = [], None, None
        try:
            for row in iterator:
                if row.sheet != now:
                    if out:
                        out.close()
                    now, name = row.sheet, f"{self.parts}/{uuid.uuid4().hex}"
                    found.append([now, 0, name])
                    out = open(name, "w", encoding="utf-8", newline="\n")  # noqa: SIM115
                if len(row.cells) > SHEET_COLUMNS:
                    raise ValueError(f"{len(row.cells)} columns; {SHEET_COLUMNS} fit")
                # A row is a line: line ends within cells are named.
                line = "".join(cell_xml(c.text, c.number) for c in row.cells)
                out.write("<row>" + line.replace("\n", "&#10;") + "</row>\n")
                found[-1][1] += 1
        finally:
            if out:
                out.close()
        context = TaskContext.get()
        return Fragments(context.partitionId() if context else 0, [tuple(f) for f in found])

    def commit(self, messages: list) -> None:
        fragments = sorted((sheet, m.partition, rows, file) for m in messages if m for sheet, rows, file in m.found)
        half = f"{self.parts}.xlsx"
        try:
            with zipfile.ZipFile(half, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
                names: list[str] = []
                parts: dict[int, list[int]] = {}
                for i, name in enumerate(self.sheets):
                    first = len(names)
                    parts[first] = self._sheet(z, names, name, [file for sheet, _, _, file in fragments if sheet == i])
                self._frame(z, names, parts)
            os.replace(half, self.path)
        finally:
            self.abort(messages)

    def _sheet(self, z: zipfile.ZipFile, names: list[str], name: str, files: list[str]) -> list[int]:
        """One sheet, or several where it is full; the first row of all is the header. How many rows each has."""
        header, rows, out, part, done = None, 0, None, 0, []

        def end() -> None:
            if out:
                out.write(b"</sheetData></worksheet>")
                out.close()

        for line in (line for file in files for line in open(file, "rb")):  # noqa: SIM115
            if out is None or rows == SHEET_ROWS:
                end()
                done += [rows] if out else []
                part += 1
                names.append(part_name(name, part))
                out = z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True)
                out.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{MAIN}"><sheetData>\n'.encode())
                rows = 0
                if header:
                    out.write(header)
                    rows = 1
            header = header or line
            out.write(line)
            rows += 1
        if out is None:
            names.append(name)
            out = z.open(f"xl/worksheets/sheet{len(names)}.xml", "w")
            out.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{MAIN}"><sheetData>'.encode())
        end()
        return [*done, rows]

    def _frame(self, z: zipfile.ZipFile, names: list[str], parts: dict[int, list[int]]) -> None:
        head, quoted = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n', lambda n: escape(n, {'"': "&quot;"})
        every = range(1, len(names) + 1)
        sheets = "".join(f'<sheet name="{quoted(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(every, names, strict=True))
        several = "".join(f'<definedName name="{ROWS_NAME}" localSheetId="{i}" hidden="1">{{{",".join(map(str, rows))}}}</definedName>' for i, rows in parts.items() if len(rows) > 1)
        own = f"<definedNames>{several}</definedNames>" if several else ""
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{sheets}</sheets>{own}</workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in every)
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{KIND}.worksheet+xml"/>' for i in every)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>{kinds}</Types>')

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)
        if os.path.exists(f"{self.parts}.xlsx"):
            os.remove(f"{self.parts}.xlsx")


def _cells(df: DataFrame, sheet: int, order: Column | str, header: bool) -> DataFrame:
    """The rows of one sheet; numbers are cells of that kind, all else is text."""
    columns = [c for c in df.columns if c != order] if isinstance(order, str) else df.columns
    order = F.col(order) if isinstance(order, str) else order
    kinds = dict(df.dtypes)
    name = lambda c: "`" + c.replace("`", "``") + "`"
    cell = lambda text, number: F.struct(text.cast("string").alias("text"), number.cast("double").alias("number"))
    none = F.lit(None)
    # Whole numbers beyond 15 digits stay text, as cells hold doubles.
    fits = lambda c: (F.abs(F.col(name(c))) < 10**15) if kinds[c] == "bigint" else F.lit(True)
    own = [cell(F.when(~fits(c), F.col(name(c))), F.when(fits(c), F.col(name(c)))) if kinds[c] in NUMBERS else cell(F.col(name(c)), none) for c in columns]
    body = df.select(F.lit(sheet).alias("sheet"), order.cast("long").alias("place"), F.array(*own).alias("cells"))
    if not header:
        return body
    # Before every row, those without a place too.
    top = df.sparkSession.range(1).select(F.lit(sheet).alias("sheet"), F.lit(-(1 << 63)).cast("long").alias("place"), F.array(*[cell(F.lit(c), none) for c in columns]).alias("cells"))
    return top.unionByName(body.withColumn("place", F.coalesce("place", F.lit((1 << 63) - 1))))


def write_workbook(sheets: list[tuple[str, DataFrame, Column | str, bool]], path: str, overwrite: bool = False) -> None:
    """One .xlsx file of sheets (name, rows, order, whether column names are its first row). ``order``: whole numbers by
    which rows lie in the sheet, an expression, or the name of a column, which then isn't written.

    An existing file is an error unless ``overwrite``; so are names no sheet can have, too many columns and too long cells. An
    empty table makes a sheet of its header. Nulls are empty cells.
    """
    spark = sheets[0][1].sparkSession
    spark.dataSource.register(Workbook)
    parts = [_cells(df, i, order, header) for i, (_, df, order, header) in enumerate(sheets)]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    placed = rows.repartitionByRange("sheet", "place").sortWithinPartitions("sheet", "place")
    placed.write.format("workbook").option("path", path).option("sheets", "\t".join(n for n, *_ in sheets)).mode("overwrite" if overwrite else "append").save()
