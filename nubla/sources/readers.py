"""Sources: CSV with its separator found, sheets of .xlsx, texts, .docx and .pdf documents, JSON examples."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nubla.functions.regex import quoted
from nubla.operators.structured import header_row
from nubla.sources.pdf import pdf_text
from nubla.sources.workbook import MAIN, ROWS_NAME, cell_text, part_name

SEPARATORS = [",", ";", "\t"]
DOCUMENT_BYTES, TABLE_BYTES, MOST_DOCUMENTS = 5 << 20, 10 << 20, 50


def separator(line: str) -> str:
    """The commonest of comma, semicolon and tab; the first of these where there's a tie."""
    return max(SEPARATORS, key=line.count)


def cells_sql(line: str, sep: str) -> str:
    """SQL of the cells of a line, as array<string>, trimmed.

    Quotes switch quoting on and off wherever they stand in a cell, and go; within them a doubled quote is one, and a
    separator is text; a quote left open reaches to the line's end.
    """
    own = "\\t" if sep == "\t" else sep
    found = f"regexp_extract_all(concat({quoted(sep)}, {line}), {quoted(own + r'((?:"(?:[^"]++|"")*+(?:"|\z)|[^"' + own + r'])*+)')}, 1)"
    bare = f"replace(regexp_replace(c, {quoted(r'"((?:[^"]++|"")*+)(?:"|\z)')}, '$1'), '\"\"', '\"')"
    return f"transform({found}, c -> regexp_replace({bare}, {quoted(r'^[\s\x{FEFF}\xA0]+|[\s\x{FEFF}\xA0]+$')}, ''))"


def read_csv(spark: SparkSession, path: str, order: str = "_row", extra: str | None = None) -> DataFrame:
    """A table of strings with the header of its first line that isn't blank, and an ordinal ``order``.

    Cells are read by ``cells_sql``; blank lines are dropped; a short row is filled with nulls. What a row has beyond the
    header is in the array column ``extra``, or left out where none is named. The ordinal follows the files' names and their
    lines. All files have the columns and the separator of the first by name, and a header line each. A header that is
    blank is called ``columna_n``; one that repeats gets its number.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("path"), place.alias("place"))
    lines = lines.filter(r"line rlike '[^\\s\\x{FEFF}\\xA0]'")
    heads = lines.groupBy("path").agg(F.min("place").alias("head"), F.min_by("line", "place").alias("first"))
    first = heads.orderBy("path").limit(1).collect()
    if not first:
        raise ValueError(f"{path}: empty")
    sep = separator(first[0]["first"])
    named = heads.orderBy("path").limit(1).select(F.expr(cells_sql("first", sep)).alias("names")).first()["names"]
    names: list[str] = []
    for i, n in enumerate(named, 1):
        n = n or f"columna_{i}"
        names.append(f"{n}_{i}" if n in names else n)
    # Parts of files are runs of lines in order: their own order is a small table's, a row for each.
    runs = lines.select("path", F.col("place.start").alias("start")).distinct()
    runs = runs.withColumn("nth", F.row_number().over(Window.orderBy("path", "start")) - 1)
    body = lines.join(heads.select("path", "head"), "path").filter(F.col("place") != F.col("head")).withColumn("start", F.col("place.start")).join(runs, ["path", "start"])
    ordinal = F.col("nth") * (1 << 33) + F.col("place.n").bitwiseAND((1 << 33) - 1)
    cells = body.select(F.expr(cells_sql("line", sep)).alias("cells"), ordinal.alias("at"))
    beyond = [F.slice("cells", len(names) + 1, F.greatest(F.size("cells") - len(names), F.lit(0))).alias(extra)] if extra else []
    return cells.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], *beyond, F.col("at").alias(order))


ROW, CELL, VALUE, TEXT = (f"{MAIN} {n}" for n in ("row", "c", "v", "t"))
LETTERS = re.compile("[A-Z]*")
#: Compressed bytes of the sheets that a task reads, and bytes of XML and rows it has at once.
TASK_BYTES, CHUNK, ROWS = 4 << 20, 1 << 20, 10_000


def table_sheets(z: zipfile.ZipFile) -> list[tuple[str, int]]:
    """(entry, rows before it) of the sheets of a workbook's first table: its first sheet, and those in which
    ``write_workbook`` went on with it, which have its first row again."""
    entries, frame, links = set(z.namelist()), "xl/workbook.xml", "xl/_rels/workbook.xml.rels"
    if not {frame, links} <= entries:
        return [(min(n for n in entries if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), 0)]
    book = ElementTree.fromstring(z.read(frame))
    target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read(links)) if r.get("Type", "").endswith("/worksheet")}
    ids = [(s.get("name"), next((target[v] for k, v in s.items() if k.endswith("}id") and v in target), None)) for s in book.iter(f"{{{MAIN}}}sheet")]
    sheets = [(i, name, t[1:] if t.startswith("/") else f"xl/{t}") for i, (name, t) in enumerate(ids) if t]
    first, name, _ = sheets[0]
    rows = next((d.text for d in book.iter(f"{{{MAIN}}}definedName") if d.get("name") == ROWS_NAME and d.get("localSheetId") == str(first)), "")
    found, before = [(sheets[0][2], 0)], 0
    for part, (n, (_, own, entry)) in enumerate(zip(map(int, re.findall(r"\d+", rows)), sheets[1:]), 2):
        if own != part_name(name, part):
            break
        before += n - 1
        found.append((entry, before))
    return found


def sheet_rows(xml: Iterable[bytes], shared: list[str]) -> Iterator[list[str]]:
    """The rows of a sheet as its XML comes, blanks as empty strings."""
    done: list[list[str]] = []
    columns: dict[str, int] = {"": 0}
    value, text = [], []
    row, at, kind, into = None, 0, None, None

    def start(name, attributes):
        nonlocal row, at, kind, into
        if name == CELL:
            letters = LETTERS.match(attributes.get("r", ""))[0]
            if letters not in columns:
                n = 0
                for letter in letters:
                    n = n * 26 + ord(letter) - 64
                columns[letters] = n
            at, kind = columns[letters] - 1, attributes.get("t")
            value.clear()
            text.clear()
        elif name == VALUE:
            into = value
        elif name == TEXT:
            into = text
        elif name == ROW:
            row = {}

    def end(name):
        nonlocal row, into
        if name == CELL and row is not None:
            own = "".join(text if kind == "inlineStr" else value)
            row[at if at >= 0 else len(row)] = cell_text(shared[int(own)] if kind == "s" and own else own)
        elif name in (VALUE, TEXT):
            into = None
        elif name == ROW:
            done.append([row.get(i, "") for i in range(max(row, default=-1) + 1)])
            row = None

    def characters(data):
        if into is not None:
            into.append(data)

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    for chunk in xml:
        parser.Parse(chunk, False)
        yield from done
        done.clear()
    parser.Parse(b"", True)
    yield from done


def shared_strings(xml: bytes) -> list[str]:
    return ["".join(t.text or "" for t in s.iter(f"{{{MAIN}}}t")) for s in ElementTree.fromstring(xml).iter(f"{{{MAIN}}}si")] if xml else []


def _shared(z: zipfile.ZipFile) -> bytes:
    return z.read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in z.namelist() else b""


def _entry_rows(z: zipfile.ZipFile, entry: str, shared: list[str]) -> Iterator[list[str]]:
    with z.open(entry) as f:
        yield from sheet_rows(iter(lambda: f.read(CHUNK), b""), shared)


def sheet_cells(content: bytes) -> list[list[str]]:
    """The rows of the first table of an .xlsx file, see ``table_sheets``; blanks as empty strings."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = shared_strings(_shared(z))
        return [r for k, (entry, _) in enumerate(table_sheets(z)) for r in islice(_entry_rows(z, entry, shared), min(k, 1), None)]


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first ten rows of each file's table, and how many sheets it has."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                sheets = table_sheets(z)
                cells = list(islice(_entry_rows(z, sheets[0][0], shared_strings(_shared(z))), 10))
            n = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n), pa.array(range(n), pa.int64()), pa.array(cells, pa.list_(pa.string())), pa.array([len(sheets)] * n, pa.int32())], ["path", "row", "cells", "sheets"])


def _sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sheet of the files' tables as it is compressed, to be read by another task."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            file = content.as_buffer()
            with zipfile.ZipFile(io.BytesIO(file)) as z:
                shared = zlib.compress(_shared(z), 1)
                for k, (entry, before) in enumerate(table_sheets(z)):
                    own = z.getinfo(entry)
                    if own.flag_bits & 1 or own.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                        raise ValueError(f"{path}: {entry} can't be read")
                    name, more = struct.unpack("<HH", file[own.header_offset + 26 : own.header_offset + 30])
                    at = own.header_offset + 30 + name + more
                    row = {"path": path.as_py(), "sheet": k, "before": before, "packed": own.compress_type == zipfile.ZIP_DEFLATED, "crc": own.CRC, "content": bytes(file[at : at + own.compress_size]), "shared": shared}
                    yield pa.RecordBatch.from_pylist([row], SHEETS)


SHEETS = pa.schema([("path", pa.string()), ("sheet", pa.int32()), ("before", pa.int64()), ("packed", pa.bool_()), ("crc", pa.int64()), ("content", pa.binary()), ("shared", pa.binary())])


def _unpacked(content: pa.Buffer, packed: bool, crc: int) -> Iterator[bytes]:
    """What an entry of a .zip holds, by parts."""
    found, sum_ = zlib.decompressobj(-zlib.MAX_WBITS), 0
    for i in range(0, len(content), CHUNK >> 4):
        part = bytes(content[i : i + (CHUNK >> 4)])
        part = found.decompress(part) if packed else part
        sum_ = zlib.crc32(part, sum_)
        yield part
    if sum_ != crc or packed and not found.eof:
        raise zipfile.BadZipFile("a sheet is broken")


def _body(columns: list[str]):
    """(row, cells): the rows below the header, their cells in the order of ``columns``, blank where a file has no such."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, packed, crc, shared, sheet, before, header, names, file in zip(*(batch[c] for c in ("content", "packed", "crc", "shared", "sheet", "before", "header", "names", "file")), strict=True):
                own = names.as_py()
                if len(set(own)) < len(own):
                    raise ValueError(f"columns of one name: {own}")
                place = {n: i for i, n in enumerate(own)}
                takes = [place.get(c, -1) for c in columns]
                # A sheet that goes on has the first row again.
                first = 1 if sheet.as_py() else header.as_py() + 1
                at = file.as_py() * (1 << 32) + before.as_py() + first
                xml = _unpacked(content.as_buffer(), packed.as_py(), crc.as_py())
                found = islice(sheet_rows(xml, shared_strings(zlib.decompress(shared.as_buffer()))), first, None)
                while some := list(islice(found, ROWS)):
                    cells = [[r[i] if 0 <= i < len(r) else "" for i in takes] for r in some]
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(some)), pa.int64()), pa.array(cells, pa.list_(pa.string()))], ["row", "cells"])
                    at += len(some)

    return rows


def read_xlsx(spark: SparkSession, path: str, order: str = "_row", most_bytes: int | None = None) -> DataFrame:
    """The first table of each workbook at ``path`` as strings, below its own header row (one of the first ten): its first
    sheet, and those in which ``write_workbook`` went on where that was full. A sheet is a task's.

    Workbooks may differ in their columns: the table has all of them, in the order of files and sheets, and what a workbook
    lacks is empty. The ordinal follows the files' names and their rows. A workbook of more than ``most_bytes`` (``TABLE_BYTES`` by default) is an error.
    """
    found, most_bytes = spark.read.format("binaryFile").load(path), most_bytes or TABLE_BYTES
    large = [r["path"] for r in found.filter(F.col("length") > most_bytes).select("path").orderBy("path").collect()]
    if large:
        raise ValueError(f"more than {most_bytes} bytes: {', '.join(large)}")
    files = found.select("path", "content")
    tops = files.mapInArrow(_first_rows, "path string, row long, cells array<string>, sheets int")
    named = F.transform("cells", lambda c, i: F.when(F.trim(c) == "", F.concat(F.lit("columna_"), (i + 1).cast("string"))).otherwise(F.trim(c)))
    once = F.transform("names", lambda n, i: F.when(F.array_contains(F.slice("names", 1, i), n), F.concat_ws("_", n, (i + 1).cast("string"))).otherwise(n))
    heads = header_row(tops, ["path"]).join(tops, "path").filter("row = header")
    heads = heads.withColumn("names", named).select("path", "header", once.alias("names"), "sheets", (F.row_number().over(Window.orderBy("path")) - 1).alias("file"))
    columns: dict[str, None] = {}
    sheets = 0
    for r in heads.orderBy("path").select("names", "sheets").toLocalIterator():
        columns |= dict.fromkeys(r["names"])
        sheets += r["sheets"]
    if not columns:
        raise ValueError(f"{path}: empty")
    size = found.agg(F.sum("length")).first()[0]
    parts = files.mapInArrow(_sheets, "path string, sheet int, before long, packed boolean, crc long, content binary, shared binary")
    dealt = parts.join(heads.drop("sheets"), "path").repartition(max(1, min(sheets, size // TASK_BYTES)))
    body = dealt.mapInArrow(_body(list(columns)), "row long, cells array<string>")
    return body.select(*[F.col("cells")[i].alias(n) for i, n in enumerate(columns)], F.col("row").alias(order))


def read_table(spark: SparkSession, path: str, order: str = "_row") -> DataFrame:
    """A table by the extension of its path: .csv or .xlsx."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in TABLES:
        raise ValueError(f"formato no soportado: {kind}")
    return TABLES[kind](spark, path, order)


TABLES = {"csv": read_csv, "xlsx": read_xlsx}


def docx_text(content: bytes) -> str:
    """The paragraphs of a .docx document."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.iter(f"{w}p"))


DOCUMENTS = {"txt": lambda content: bytes(content).decode("utf-8-sig"), "docx": docx_text, "pdf": pdf_text}


def document_texts(files: DataFrame) -> DataFrame:
    """(name, text, status, error) of each of ``files`` (path, length, content): .txt, .docx and .pdf.

    A file that is too large, of another kind or broken has status ``error`` and no text; the others go on.
    """

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, size, content in zip(frame["path"], frame["length"], frame["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                try:
                    if kind not in DOCUMENTS:
                        raise ValueError(f"formato no soportado: {kind}")
                    if size > DOCUMENT_BYTES:
                        raise ValueError("archivo demasiado grande")
                    out.append((name.rsplit("/", 1)[-1], DOCUMENTS[kind](content), "completed", None))
                except Exception as e:  # one broken file must not end the job
                    out.append((name.rsplit("/", 1)[-1], None, "error", str(e)))
            yield pd.DataFrame(out, columns=["name", "text", "status", "error"])

    return files.select("path", "length", "content").mapInPandas(texts, "name string, text string, status string, error string")


def read_documents(spark: SparkSession, path: str, least_limits: bool = False) -> DataFrame:
    """(name, text, status, error) of each file at ``path``, see ``document_texts``. least_limits: also refuse more than
    ``MOST_DOCUMENTS`` files."""
    files = spark.read.format("binaryFile").load(path)
    if least_limits and files.select("path").limit(MOST_DOCUMENTS + 1).count() > MOST_DOCUMENTS:
        raise ValueError(f"more than {MOST_DOCUMENTS} files")
    return document_texts(files)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Notes in JSON files, one object a file, with their text in ``texto``."""
    return spark.read.json(path, multiLine=True).withColumnRenamed("texto", "text")
