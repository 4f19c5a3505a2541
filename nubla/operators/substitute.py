"""Substitution: coherent labels within a note, and the new text.

Labels are given from the end of the note to its start, so the last professional mentioned is number 1.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from nubla.functions.dates import note_date, relative, since_visit
from nubla.functions.regex import let
from nubla.functions.text import PAGE, behind, pages, trim_space
from nubla.operators.rules import RELATIONS

# Words that tell a name's gender, titles, and the labels of quasi-identifiers.
FEMININE_SHORT = ["mª", "m.ª", "m.", "ma", "ma."]
MASCULINE_IN_A = ["luca", "bautista", "borja", "santiago", "garcía", "joshua", "ezra"]
FEMININE = ["carmen", "rocío", "consuelo", "rosario", "raquel", "isabel", "pilar", "mar", "mercedes", "dolores", "nieves", "milagros", "belen", "belén", "montserrat", "nuria", "ines", "inés"]
TITLE = r"^(dr\.|dra\.|doctor|doctora|facultativo|enfermero|enfermera|enf\.)\s*"
CENTRE_NAME = r"(?:hospital|clínica|clinica|centro de salud|consultorio)\s+(?:universitario\s+)?(?:infantil\s+)?(?:general\s+)?(?:regional\s+)?(?:comarcal\s+)?(?:provincial\s+)?(?:materno\s+)?(?:clínico\s+)?(?:de\s+día\s+)?(.+)"
ODD_LABELS = {"enfermedad_rara": "diagnostico poco frecuente", "cargo_publico": "cargo institucional", "parentesco_especial": "relacion familiar sensible", "profesion_especifica": "profesion sensible"}


def gender(name: Column) -> Column:
    """``F`` or ``M`` by the first word."""
    first = F.lower(F.split(name, " ")[0])
    by_end = F.when(first.isin(MASCULINE_IN_A), "M").otherwise("F")
    return F.when(first.isin(FEMININE_SHORT), "F").when(F.endswith(first, F.lit("a")), by_end).when(first.isin(FEMININE), "F").otherwise("M")


def patient_label(name: Column) -> Column:
    return F.when(gender(name) == "F", "Paciente Mujer").otherwise("Paciente Hombre")


def professional_key(text: Column) -> Column:
    return trim_space(F.regexp_replace(F.regexp_replace(trim_space(F.lower(text)), TITLE, ""), r"\s+", " "))


def _words(key: Column) -> Column:
    """A key with its words, so that these are split once."""
    return F.struct(key.alias("key"), F.split(key, " ").alias("words"))


def _rest(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.slice(words, 2, 1000)).otherwise(words)


def same_professional(a: Column, b: Column) -> Column:
    """Of two keys with their words: equal, one the end of the other, a single word of it, or all surnames of the shorter in
    the longer."""

    def compare(short: Column, long: Column) -> Column:
        common = F.filter(_rest(long["words"]), lambda w: F.array_contains(_rest(short["words"]), w))
        alone = (F.size(short["words"]) == 1) & F.array_contains(long["words"], short["words"][0])
        # Some word is in both where surnames are: cheaper to see than which ones.
        surnames = F.arrays_overlap(short["words"], long["words"]) & let(common, lambda c: (F.size(c) == F.size(_rest(short["words"]))) & (F.size(c) > 0))
        return F.endswith(long["key"], short["key"]) | alone | surnames

    return (a["key"] == b["key"]) | F.when(F.size(a["words"]) <= F.size(b["words"]), compare(a, b)).otherwise(compare(b, a))


def relative_key(text: Column) -> Column:
    """The first relation, in a fixed order, that the text holds; the text itself where it holds none."""
    lower = F.lower(text)
    return F.coalesce(*[F.when(F.contains(lower, F.lit(r)), F.lit(r)) for r in RELATIONS], trim_space(lower))


def centre_key(text: Column) -> Column:
    """A centre's proper name."""
    out = trim_space(F.lower(text))
    for old, new in ((r"\s+(período|periodo|médico|medico)\s*\z", ""), (r"^h\.\s*u\.\s*", "hospital universitario "), (r"^h\.\s*", "hospital "), (r"\s+de\s+día\s*", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, old, new)
    out = trim_space(out)
    return let(out, lambda o: F.when(o.rlike(CENTRE_NAME), trim_space(F.regexp_extract(o, CENTRE_NAME, 1))).otherwise(o))


def _like(a: Column, b: Column) -> Column:
    return F.contains(a["key"], b["key"]) | F.contains(b["key"], a["key"])


def numbered(keys: Column, same) -> Column:
    """struct<keys, numbers>: the distinct keys in order, and a number for each: that of the first earlier key that is the
    same, else the next one. ``same`` takes keys with their words."""

    def numbers(known: Column) -> Column:
        with_words = lambda w: F.transform(w, lambda x, i: F.try_element_at(F.filter(F.slice(w, 1, i), lambda o: same(x, o)), F.lit(1))["key"])
        first = let(F.transform(known, _words), with_words)

        def number(first: Column) -> Column:
            step = lambda done, i: F.concat(done, F.array(F.when(first[i].isNull(), F.coalesce(F.array_max(done), F.lit(0)) + 1).otherwise(F.element_at(done, F.greatest(F.array_position(known, first[i]), F.lit(1)).cast("int")))))
            return F.aggregate(F.sequence(F.lit(0), F.size(known) - 1), F.from_json(F.lit("[]"), "array<int>"), step)

        return F.when(F.size(known) > 0, let(first, number)).otherwise(F.from_json(F.lit("[]"), "array<int>"))

    return let(F.array_distinct(keys), lambda known: F.struct(known.alias("keys"), numbers(known).alias("numbers")))


def _number(known: Column, key: Column) -> Column:
    return F.try_element_at(known["numbers"], F.nullif(F.array_position(known["keys"], key), F.lit(0)).cast("int"))


def letter(number: Column) -> Column:
    return F.chr((number + 64).cast("long"))


def dated(span: Column) -> Column:
    """Whether a span is a date that is told by visits: full dates and years."""
    return (span["type"] == "FECHA") & (span["subtype"].isin("fecha_completa", "ano") | span["text"].rlike(r"^\d{1,2}[/\-]"))


def visits(spans: Column, today: Column) -> Column:
    """struct<keys, labels>: distinct dates in order, the first told from today, each other from the one before."""
    parsed = F.transform(F.filter(spans, dated), lambda s, i: let(trim_space(s["text"]), lambda t: F.struct(note_date(t).alias("day"), i.alias("i"), t.alias("key"))))
    keys = F.array_distinct(F.transform(F.array_sort(F.filter(parsed, lambda v: v["day"].isNotNull())), lambda v: v["key"]))

    def labels(keys: Column) -> Column:
        def label(days: Column, i: Column) -> Column:
            first = relative(F.datediff(today, days[i]))
            gap = since_visit(F.datediff(days[i], F.element_at(days, F.greatest(i, F.lit(1)))))
            later = F.concat(gap, F.lit(" Visita "), i.cast("string"))
            return F.concat(F.lit("Visita "), (i + 1).cast("string"), F.lit(" ("), F.when(i == 0, first).otherwise(later), F.lit(")"))

        told = let(F.transform(keys, lambda k: note_date(k)), lambda days: F.transform(days, lambda d, i: label(days, i)))
        return F.struct(keys.alias("keys"), told.alias("labels"))

    return let(keys, labels)


def labelled(spans: Column, today: Column, strict: bool = False) -> Column:
    """``spans`` (by start) with ``transformed``."""
    back = F.reverse(spans)
    of = lambda test, key: F.transform(F.filter(back, test), lambda s: key(s["text"]))
    is_professional = lambda s: s["subtype"] == "profesional"
    is_centre = lambda s: (s["type"] == "UBICACION") & (s["subtype"] == "hospital")
    is_city = lambda s: (s["type"] == "UBICACION") & (s["subtype"] != "hospital")
    city_key = lambda t: trim_space(F.lower(t))
    state = F.struct(
        numbered(F.filter(of(is_professional, professional_key), lambda k: F.length(k) >= 3), same_professional).alias("professionals"),
        F.array_distinct(of(lambda s: s["subtype"] == "familiar", relative_key)).alias("relatives"),
        numbered(of(is_centre, centre_key), _like).alias("centres"),
        F.array_distinct(of(is_city, city_key)).alias("cities"),
        visits(spans, today).alias("visits"),
    )

    def replaced(k: Column, s: Column) -> Column:
        name = s["text"]
        number = lambda n: n.cast("string")
        professional = F.when(F.length(professional_key(name)) < 3, "").otherwise(F.concat(F.lit("Profesional Sanitario "), number(_number(k["professionals"], professional_key(name)))))
        relative_ = F.concat(F.lit("Familiar "), number(F.array_position(k["relatives"], relative_key(name))))
        visit = F.try_element_at(k["visits"]["labels"], F.nullif(F.array_position(k["visits"]["keys"], trim_space(name)), F.lit(0)).cast("int"))
        centre = F.lit("Centro Sanitario") if strict else F.concat(F.lit("Centro "), letter(_number(k["centres"], centre_key(name))))
        city = F.lit("Zona Geografica") if strict else F.concat(F.lit("Ciudad "), letter(F.array_position(k["cities"], city_key(name))))
        odd = F.lit("[dato_sensible]") if strict else F.coalesce(*[F.when(s["subtype"] == x, F.lit(v)) for x, v in ODD_LABELS.items()], F.lit("dato cuasi-identificador"))
        return (
            F.when(s["type"] == "IDENTIFICADOR", "")
            .when(is_professional(s), professional)
            .when(s["subtype"] == "familiar", relative_)
            .when(s["type"] == "NOMBRE", patient_label(name))
            .when(dated(s), F.coalesce(visit, name))
            .when(is_centre(s), centre)
            .when(is_city(s), city)
            .when(s["type"] == "SOSPECHOSO", odd)
            .otherwise(name)
        )

    return let(state, lambda k: F.transform(spans, lambda s: s.withField("transformed", replaced(k, s))))


def transform_entity(text: Column, kind: Column, subtype: Column, today: Column, strict: bool = False) -> Column:
    """The label of one entity by itself: numbers and letters start anew."""
    span = F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), kind.alias("type"), subtype.alias("subtype"), text.alias("text"))
    return labelled(F.array(span), today, strict)[0]["transformed"]


def splice(text: Column, spans: Column, field: str = "transformed") -> Column:
    """``text`` with each of the disjoint ``spans`` (by start) replaced: the pieces are made apart and joined once. Long pieces,
    of which there are few, are cut from the text, others from its pages."""

    def joined(s: Column, paged: Column) -> Column:
        at = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(s, F.greatest(i, F.lit(1)))["end"])
        piece = lambda begin, size: F.when(size <= PAGE, behind(paged, begin, size)).otherwise(F.substring(text, begin + 1, size))
        pieces = F.transform(s, lambda x, i: F.concat(let(at(i), lambda begin: piece(begin, x["start"] - begin)), x[field]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, at(F.size(s)) + 1, F.length(text)))

    return let(spans, lambda s: let(pages(text), lambda paged: joined(s, paged)))


def as_day(value: str | date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")
