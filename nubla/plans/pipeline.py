"""The whole way of a note: detect, resolve, score, filter, substitute. One narrow stage: nothing is shuffled, but for the
hits of dictionaries in a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubla.functions.regex import let
from nubla.functions.text import pages
from nubla.operators import score as S
from nubla.operators.detect import detect
from nubla.operators.dictionaries import Dictionaries
from nubla.operators.lookup import KNOWN, looked_up
from nubla.operators.resolve import resolve
from nubla.operators.substitute import as_day, labelled, splice


@dataclass(frozen=True)
class Config:
    """as_of: the day from which visits are told; boundary: ``ascii`` word edges, or ``unicode`` for accented names."""

    as_of: str = "2026-01-01"
    use_scoring: bool = True
    heuristics: bool = True
    threshold: float = S.THRESHOLD
    strict: bool = False
    boundary: str = "ascii"
    words: Dictionaries = field(default_factory=Dictionaries)


def scored(notes: DataFrame, config: Config | None = None, text: str = "text") -> DataFrame:
    """``notes`` with ``spans``: disjoint, by start, with their final confidence and a recommendation."""
    c = config or Config()
    notes = notes.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    if c.words.table:
        notes = looked_up(notes, c.words.table, text, c.boundary)
    out = detect(notes, c.words, text, c.boundary).withColumn("spans", resolve("candidates")).drop("candidates")
    if c.use_scoring:
        out = out.withColumn("spans", let(pages(F.col(text)), lambda p: F.transform("spans", lambda s: s.withField("confidence", S.score(s, p, c.words)))))
    fresh = lambda s: (s["type"] == "NOMBRE") & (s["subtype"] != "familiar")
    out = out.withColumn("spans", F.transform("spans", lambda s: s.withField("recommendation", F.when(fresh(s) & F.lit(c.use_scoring), S.recommendation(s["confidence"])).otherwise("ANONIMIZAR"))))
    if c.heuristics:
        out = out.withColumn("spans", let(pages(F.col(text)), lambda p: F.transform("spans", lambda s: s.withField("confidence", S.adjusted(s, s["confidence"], p)))))
    return out.drop(KNOWN)


def pseudonymise(notes: DataFrame, config: Config | None = None, text: str = "text") -> DataFrame:
    """``notes`` with ``processed``, ``entities`` (kept spans with ``transformed``) and ``discarded``.

    A null or empty text gives an empty result. Works on a stream as on a table.
    """
    c = config or Config()
    fits = lambda s: s["confidence"] >= S.threshold(s["type"], c.threshold, c.strict)
    out = scored(notes, c, text).withColumn("kept", F.filter("spans", fits)).withColumn("discarded", F.filter("spans", lambda s: ~fits(s)))
    out = out.withColumn("entities", labelled(F.col("kept"), as_day(c.as_of), c.strict))
    return out.withColumn("processed", splice(F.col(text), F.col("entities"))).drop("spans", "kept")


def stats(entities: Column) -> dict[str, Column]:
    """Counts of a note's entities by kind."""
    count = lambda test: F.size(F.filter(entities, test)).cast("long")
    return {
        "total": F.size(entities).cast("long"),
        "pacientes": count(lambda e: e["subtype"] == "paciente"),
        "profesionales": count(lambda e: e["subtype"] == "profesional"),
        "familiares": count(lambda e: e["subtype"] == "familiar"),
        "fechas": count(lambda e: e["type"] == "FECHA"),
        "identificadores": count(lambda e: e["type"] == "IDENTIFICADOR"),
        "ubicaciones": count(lambda e: e["type"] == "UBICACION"),
        "sospechosos": count(lambda e: e["type"] == "SOSPECHOSO"),
        "nombres": count(lambda e: e["type"] == "NOMBRE"),
    }


def entity_rows(done: DataFrame, key: str) -> DataFrame:
    """The entities of ``pseudonymise`` as rows."""
    found = done.select(key, F.inline_outer("entities")).filter("start is not null")
    return found.select(key, "start", "end", "type", "subtype", "text", "confidence", "recommendation", "transformed")
