"""Dictionaries of names and places: those in ``nubla/resources`` by default, any others as a parameter.

The resource files are fixed values, an entry a line: hospitals, districts, provinces, regions and names of both genders in
full, and the 200 commonest names of women and men, surnames and cities. Longer lists are a parameter: a table of any size
(``of_table``, ``read``), which is joined and never collected (see ``lookup``), or lists that become part of the plan
(``load``).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubla.functions.text import ACCENTED, PLAIN
from nubla.operators.lookup import KINDS

RESOURCES = Path(__file__).parent.with_name("resources")

# Words that the rules know.
CENTRE_PREFIXES = ["Centro de Salud", "Consultorio", "Ambulatorio", "Centro de Especialidades", "Centro Médico", "Clínica", "Policlínica", "Centro de Atención Primaria", "CAP", "Unidad de Salud Mental", "USM", "Hospital de Día", "Centro de Diagnóstico"]
ABBREVIATIONS = ["Mª", "M.", "Ma", "Ma.", "Fco", "Fco.", "Fdo", "Fdo.", "Jse", "J.", "Ant", "Ant.", "Anto", "Mig", "Mgl", "Cris", "Tere", "Paco", "Pepe", "Lola", "Concha", "Conchi", "Pili", "Maite", "Maribel", "Maricarmen", "Marisa", "Merche", "Charo", "Rafa", "Nacho", "Manolo", "Kiko", "Quique", "Juanjo", "Juanma", "Javi", "Dani", "Toni", "Santi", "Edu", "Fer", "Guille"]


def _resource(name: str):
    return field(default_factory=lambda: (RESOURCES / f"{name}.txt").read_text(encoding="utf-8").splitlines())


@dataclass(frozen=True)
class Dictionaries:
    """``places`` are cities, provinces and regions together."""

    women: list[str] = _resource("women")
    men: list[str] = _resource("men")
    unisex: list[str] = _resource("unisex")
    surnames: list[str] = _resource("surnames")
    cities: list[str] = _resource("cities")
    provinces: list[str] = _resource("provinces")
    regions: list[str] = _resource("regions")
    hospitals: list[str] = _resource("hospitals")
    centre_prefixes: list[str] = field(default_factory=lambda: CENTRE_PREFIXES)
    districts: list[str] = _resource("districts")
    abbreviations: list[str] = field(default_factory=lambda: ABBREVIATIONS)
    #: Rows (kind, entry) that take the place of the lists of ``lookup.KINDS``.
    table: DataFrame | None = None

    @property
    def places(self) -> list[str]:
        return [*self.cities, *self.provinces, *self.regions]

    def sizes(self) -> dict[str, int]:
        return {k: len(set(v)) for k, v in self.__dict__.items() if k != "table"}


def plain(word: str) -> str:
    """The form in which dictionary words are compared."""
    return word.translate(str.maketrans(ACCENTED, PLAIN)).lower()


def of_table(entries: DataFrame) -> Dictionaries:
    """Dictionaries of a table (kind, entry), of which there may be millions; ``kind`` is one of ``lookup.KINDS``. What the
    rules know themselves (prefixes of centres, abbreviations) stays."""
    return replace(Dictionaries(), **dict.fromkeys(KINDS, []), table=entries)


def as_table(spark: SparkSession, words: Dictionaries | None = None) -> DataFrame:
    """The lists of ``words`` (the default ones) as a table (kind, entry)."""
    words = words or Dictionaries()
    return spark.createDataFrame([(k, w) for k in KINDS for w in getattr(words, k)], "kind string, entry string")


def read(spark: SparkSession, **paths: str) -> DataFrame:
    """A table (kind, entry) from text files of one entry a line, a path for each kind."""
    parts = [spark.read.text(path).select(F.lit(kind).alias("kind"), F.col("value").alias("entry")) for kind, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def load(spark: SparkSession, **lists: str | DataFrame) -> Dictionaries:
    """Dictionaries from text files (a path) or DataFrames (first column); those not named keep their defaults.

    They become patterns (trees of common beginnings) and hashed sets inside the plan, so the driver holds them: this is for
    lists of some thousand entries, and for streams; ``of_table`` takes more. Blank entries are left out, repeated ones count
    once.
    """
    found = {}
    for name, source in lists.items():
        rows = spark.read.text(source) if isinstance(source, str) else source.select(F.col(source.columns[0]).cast("string").alias("value"))
        found[name] = sorted(r["value"] for r in rows.select(F.trim("value").alias("value")).filter("value <> ''").distinct().toLocalIterator())
    return replace(Dictionaries(), **found)
