"""Sinks: the table to share, what must be kept apart, workbooks of both, PDF files, and the batch summary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nubla.operators import structured as G
from nubla.plans.pipeline import stats
from nubla.sources.pdf import text_pdf
from nubla.sources.workbook import write_workbook

FORMATS = ("parquet", "csv", "json", "orc")
WARNING = ["DOCUMENTO CONFIDENCIAL", "Permite volver a identificar a los pacientes.", "Guárdelo separado de los datos y con acceso restringido."]


def _write(df: DataFrame, path: str, form: str) -> None:
    if form not in FORMATS:
        raise ValueError(f"{form}: not one of {FORMATS}")
    writer = df.write.mode("errorifexists")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


# What the sheets of figures and of the warning say.
INFO = [("INFORMACIÓN DEL ARCHIVO", None), ("ESTADÍSTICAS", None), ("Registros totales", "rows"), ("Pacientes únicos", "patients"), ("Visitas promedio por paciente", "visits_per_patient"), ("COLUMNAS", None), ("Columnas eliminadas", "removed"), ("Columnas mantenidas", "kept"), ("AVISO LEGAL", None), ("Este archivo contiene datos seudonimizados.", None), ("No contiene identificadores directos del paciente.", None)]


def info(table: DataFrame, actions: dict[str, str]) -> DataFrame:
    """The table's figures as lines (n, concepto, valor)."""
    lines = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(label).alias("concepto"), (F.col(c).cast("string") if c else F.lit(None).cast("string")).alias("valor")) for i, (label, c) in enumerate(INFO)])
    return G.table_stats(table, actions).select(F.inline(lines))


def write_anonymised(table: DataFrame, actions: dict[str, str], order: str, reference: str, path: str, form: str = "csv", prefix: str = "PAC") -> None:
    """``datos`` in the rows' order, and ``info`` with the table's figures: folders of files, or with the form ``xlsx`` one
    workbook at ``path`` with a sheet for each."""
    done = G.anonymise(table, actions, order, reference, prefix)
    if form == "xlsx":
        return write_workbook([("Datos", done, order, True), ("Info", info(table, actions), "n", False)], path)
    _write(done.orderBy(order).drop(order), f"{path}/datos", form)
    _write(G.table_stats(table, actions), f"{path}/info", form)


def write_correspondence(table: DataFrame, actions: dict[str, str], order: str, path: str, form: str = "csv", prefix: str = "PAC") -> None:
    """What leads back to patients, for a folder of restricted access: a warning, correspondence, codes and column mapping, as
    folders of files, or with the form ``xlsx`` as the sheets of one workbook at ``path``."""
    warning = table.sparkSession.createDataFrame(list(enumerate(WARNING)), "n int, aviso string")
    mapping = G.column_mapping(table, actions).withColumn("final", F.coalesce("final", F.lit("[ELIMINADA]")))
    coded = [c for c, a in actions.items() if a == "CODIFY"]
    patients = G.correspondence(table, actions, order, prefix)
    if form == "xlsx":
        number = lambda c: F.regexp_extract(F.col(c), r"(\d+)$", 1).cast("long")
        named = mapping.select(F.col("original").alias("Columna_Original"), F.col("action").alias("Acción"), F.col("final").alias("Columna_Final"))
        place = F.array_position(F.array(*map(F.lit, actions)), F.col("Columna_Original"))
        codes = [(f"Cod_{c}"[:31], G.codes(table, c, order).select(F.col("code").alias("Código"), F.col("original").alias("Valor_Original")), number("Código"), True) for c in coded]
        return write_workbook([("LEER PRIMERO", warning, "n", False), ("Correspondencia", patients, number("ID_ESTUDIO"), True), *codes, ("Mapeo_Columnas", named, place, True)], path)
    _write(warning.drop("n").coalesce(1), f"{path}/aviso", form)
    _write(patients, f"{path}/correspondencia", form)
    for c in coded:
        _write(G.codes(table, c, order), f"{path}/cod_{c}"[: len(path) + 32], form)
    _write(mapping, f"{path}/mapeo_columnas", form)


def pdf_files(docs: DataFrame, name: str, text: str = "text", lines: int = 50) -> DataFrame:
    """(path, length, content): a PDF file of each document, called after the column ``name``, of pages of so many lines; a
    null text makes one empty page. ``content`` goes to a table, or to files one by one."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            split = [(t or "").split("\n") for t in frame["text"]]
            content = [text_pdf([own[i : i + lines] for i in range(0, len(own), lines)], packed=i % 2 == 1) for i, own in enumerate(split)]
            yield pd.DataFrame({"path": frame["path"], "length": [len(c) for c in content], "content": content})

    return docs.select(F.concat(F.col(name).cast("string"), F.lit(".pdf")).alias("path"), F.col(text).alias("text")).mapInPandas(made, "path string, length long, content binary")


def batch_summary(done: DataFrame) -> DataFrame:
    """A row for each document of a batch: its counts and status, and its time where ``done`` has one (``ms``)."""
    s = stats(F.col("entities"))
    time = [F.col("ms").alias("Tiempo (ms)")] if "ms" in done.columns else []
    columns = {"Entidades Detectadas": "total", "Nombres": "nombres", "Fechas": "fechas", "Ubicaciones": "ubicaciones", "Identificadores": "identificadores", "Sospechosos": "sospechosos"}
    return done.select(F.col("name").alias("Nombre"), *[s[v].alias(k) for k, v in columns.items()], *time, F.col("status").alias("Estado"))


def total_time(summary: DataFrame) -> DataFrame:
    """The sum of a summary's times."""
    return summary.agg(F.coalesce(F.sum("Tiempo (ms)"), F.lit(0)).cast("long").alias("total_ms"))


def write_summary(done: DataFrame, path: str) -> None:
    """The summary as CSV with every cell quoted."""
    batch_summary(done).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def report(done: DataFrame, key: str, most: int = 15, text: str = "processed") -> DataFrame:
    """What a printed report shows of each note: a preview, the first entities, and how many more there are."""
    preview = F.substring(text, 1, 2000)
    first = F.transform(F.slice("entities", 1, most), lambda e: F.struct(e["type"].alias("type"), F.substring(e["text"], 1, 25).alias("text"), F.substring(e["transformed"], 1, 25).alias("transformed")))
    return done.select(key, preview.alias("preview"), first.alias("entities"), F.greatest(F.size("entities") - most, F.lit(0)).alias("more"))
