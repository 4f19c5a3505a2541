"""Additive confidence: dictionary and context scores for names, contextual adjustments, thresholds.

All sums are doubles added in a fixed order, since thresholds compare with ``>=``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nubla.functions.regex import java, let
from nubla.functions.text import ahead_of, behind, normalize, trim_space
from nubla.operators.dictionaries import Dictionaries, plain
from nubla.operators.lookup import KNOWN
from nubla.operators.rules import NAME

HIGH, MEDIUM, LOW = 0.8, 0.6, 0.4
THRESHOLD, STRICT, STRICT_ODD = 0.5, 0.35, 0.25

# Cues, word lists and weights.
PROFESSIONAL_CUE = r"(?:Dr\.|Dra\.|Doctor|Doctora|Enfermero|Enfermera|Facultativo|Psic[oó]log[oa]|Fisioterapeuta)\s*$"
PATIENT_CUE = r"(?:paciente|enferm[oa]|atendid[oa]|ingresad[oa]|derivad[oa])\s+(?:es\s+|se\s+llama\s+)?$"
LABEL_CUE = r"(?:Nombre|Paciente|Contacto|Familiar|Acompañante|Tutor)\s*:\s*$"
PLACE_CUE = r"(?:vive|reside|natural|procedente|domiciliad[oa]|vecin[oa])\s+(?:en|de)\s*$"
COMMON_WORDS = ["que", "con", "sin", "por", "para", "del", "las", "los", "una", "uno", "estable", "consciente", "orientado", "orientada", "presenta", "muestra", "tratamiento", "medicación", "diagnóstico", "pronóstico", "evolución", "valoración", "evaluación", "protocolo", "procedimiento", "intervención"]
SPECIALTIES = ["cardiología", "dermatología", "pediatría", "cirugía", "medicina", "oncología", "neurología", "psiquiatría", "traumatología", "ginecología", "urología", "oftalmología", "neumología", "digestivo", "endocrinología", "reumatología", "nefrología", "hematología", "geriatría", "radiología", "anestesiología", "cardiologia", "dermatologia", "pediatria", "cirugia", "oncologia", "neurologia", "psiquiatria", "traumatologia", "ginecologia"]
POSITIVE = [(r"\bpaciente\s+(?:es\s+|se\s+llama\s+)?$", 0.9), (r"\bDr\.\s*$", 0.95), (r"\bDra\.\s*$", 0.95), (r"\bDoctor\s+$", 0.9), (r"\bDoctora\s+$", 0.9), (r"\benfermero\s+$", 0.85), (r"\benfermera\s+$", 0.85), (r"\bNombre\s*:\s*$", 0.95), (r"\bPaciente\s*:\s*$", 0.95), (r"\bFamiliar\s*:\s*$", 0.9), (r"\bContacto\s*:\s*$", 0.9), (r"\bfirmado\s+por\s+$", 0.85), (r"\batendido\s+por\s+$", 0.85), (r"\bvalorado\s+por\s+$", 0.85), (r"\bderivado\s+(?:a|por)\s+$", 0.8), (r"\brealizado\s+por\s+$", 0.85), (r"\bsupervisado\s+por\s+$", 0.85)]
NEGATIVE = [(r"\bdiagnóstico\s+de\s*$", -0.4), (r"\btratamiento\s+(?:de|con)\s*$", -0.4), (r"\bmedicación\s*$", -0.3), (r"\bprotocolo\s+$", -0.3), (r"\bsíndrome\s+(?:de|del)\s*$", -0.5), (r"\benfermedad\s+(?:de|del)\s*$", -0.5), (r"\btécnica\s+(?:de|del)\s*$", -0.4), (r"\bprueba\s+(?:de|del)\s*$", -0.3), (r"\bescala\s+(?:de|del)\s*$", -0.4), (r"\btest\s+(?:de|del)\s*$", -0.4), (r"\bíndice\s+(?:de|del)\s*$", -0.4), (r"\bhospital\s+$", -0.3), (r"\bclínica\s+$", -0.3)]
NEXT_WORDS = ["mg", "ml", "gr", "kg", "mcg", "UI", "comprimidos", "cápsulas", "tabletas", "gotas", "ampollas", "cada", "horas", "días", "veces", "positivo", "negativo", "elevado", "elevada", "bajo", "baja", "normal", "test", "escala", "índice", "puntuación", "grado", "estadio", "tipo", "clase", "síndrome", "enfermedad", "patología", "trastorno"]
EPONYMS = ["alzheimer", "parkinson", "crohn", "hodgkin", "kawasaki", "hashimoto", "graves", "addison", "cushing", "wilson", "huntington", "meniere", "raynaud", "sjogren", "behcet", "marfan", "ehlers", "danlos", "guillain", "barre", "down", "turner", "klinefelter", "edwards", "patau", "asperger", "rett", "angelman", "prader", "willi", "bell", "basedow", "paget", "dupuytren", "barret", "zollinger", "ellison", "conn", "wernicke", "korsakoff"]
MEDICATION = r"\d+\s*mg|\d+\s*ml|cada\s+\d+\s+horas|\d+\s+veces\s+al\s+día|pauta\s*:|posología\s*:|tratamiento\s*:"
COMPOUND = r"^(?:María\s+(del\s+)?(Carmen|Pilar|Teresa|Ángeles|Angeles|Luisa|José|Rosa|Luz|Dolores|Mercedes)|Ana\s+(María|Isabel|Belén|Belen|Rosa|Lucía|Lucia)|María\s+de\s+los\s+(Ángeles|Angeles|Dolores|Remedios)|José\s+(María|Luis|Manuel|Antonio|Miguel|Ángel|Angel|Francisco|Ramón|Ramon)|Juan\s+(Carlos|José|Antonio|Manuel|Miguel|Pablo|Francisco)|Francisco\s+(Javier|José|Manuel)|Miguel\s+(Ángel|Angel))"
SHORT_NAMES = ["Mª", "M.ª", "Fco.", "Fco", "Jse.", "Jse", "Ant.", "Ant", "Mig.", "Fdo.", "Rdo.", "Crmen", "Cmen"]


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _end(pattern: str) -> str:
    return java(pattern.replace("$", r"\z"), True)


def _added(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _named(word: Column, kind: str) -> Column:
    """Whether a note's hits have the word as a name."""
    return F.exists(KNOWN, lambda k: (k["kind"] == kind) & (k["word"] == normalize(word)))


def _given(word: Column, words: Dictionaries) -> Column:
    if words.table:
        return _named(word, "=given")
    return normalize(word).isin(sorted({plain(w) for w in [*words.women, *words.men]}))


def _surname(tokens: Column, words: Dictionaries) -> Column:
    if words.table:
        return F.exists(F.slice(tokens, 2, 1000), lambda w: _named(w, "=surname"))
    known = sorted({plain(w) for w in words.surnames})
    return F.exists(F.slice(tokens, 2, 1000), lambda w: normalize(w).isin(known))


def patient_parts(tokens: Column, ahead: Column, words: Dictionaries) -> list[Column]:
    """The parts of a patient's score, in the order in which they are added: fixed values."""
    shape = (F.size(tokens) >= 2) & (F.size(tokens) <= 4) & F.forall(tokens, lambda w: w.rlike(f"^{NAME}$"))
    professional, label = ahead.rlike(_end(PROFESSIONAL_CUE)), ahead.rlike(_end(LABEL_CUE))
    return [
        _if(_given(tokens[0], words), 0.3),
        _if(_surname(tokens, words), 0.25),
        _if(shape, 0.2),
        _if(professional, 0.3),
        _if(ahead.rlike(_end(PATIENT_CUE)), 0.25),
        _if(label, 0.35),
        _if(F.lower(tokens[0]).isin(COMMON_WORDS), -0.3),
        _if((F.size(tokens) == 1) & ~professional & ~label, -0.2),
    ]


def professional_parts(tokens: Column, words: Dictionaries) -> list[Column]:
    """The parts of a professional's score, as above; the title is the first word."""
    return [
        F.lit(0.3),
        _if(_given(tokens[0], words), 0.3),
        _if(_surname(tokens, words), 0.25),
        _if(F.size(tokens) >= 2, 0.15),
        _if(F.lower(tokens[0]).isin(SPECIALTIES), -0.4),
    ]


def place_score(text: Column, subtype: Column, ahead: Column, words: Dictionaries) -> Column:
    """A place's score by kind, known city, cue and number; the pipeline keeps a place's detected confidence instead."""
    base = F.when(subtype.isin("hospital", "direccion"), 0.5).when(subtype == "ciudad", 0.4).when(subtype == "contexto", 0.35).otherwise(0.0)
    known = normalize(text).isin(sorted({plain(w) for w in words.places}))
    return _clamp(base + _if(known, 0.3) + _if(ahead.rlike(_end(PLACE_CUE)), 0.2) + _if(text.rlike(r"\d"), 0.3))


def score(span: Column, pages: Column, words: Dictionaries) -> Column:
    """The span's confidence: names are scored anew, others keep what their rule gives. pages: the text's."""
    tokens, ahead = F.split(span["text"], r"\s+"), ahead_of(pages, span["start"], 50)
    named = lambda c: F.when(span["subtype"] == "profesional", _clamp(_added(professional_parts(c["tokens"], words)))).otherwise(_clamp(_added(patient_parts(c["tokens"], c["ahead"], words))))
    fresh = (span["type"] == "NOMBRE") & (span["subtype"] != "familiar")
    return F.when(fresh, let(F.struct(tokens.alias("tokens"), ahead.alias("ahead")), named)).otherwise(span["confidence"])


def recommendation(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "ANONIMIZAR").when(confidence >= MEDIUM, "ANONIMIZAR_CON_REVISION").when(confidence >= LOW, "REVISION_MANUAL").otherwise("NO_ANONIMIZAR")


def is_eponym(text: Column) -> Column:
    return F.lower(text).rlike("|".join(EPONYMS))


def first_weight(ahead: Column, cues: list[tuple[str, float]]) -> Column:
    """The weight of the first cue that ends right before a span."""
    return F.coalesce(*[F.when(ahead.rlike(_end(p)), F.lit(w)) for p, w in cues], F.lit(0.0))


def next_word(behind: Column) -> Column:
    return F.lower(F.regexp_extract(trim_space(behind), r"^\S*", 0))


def in_medication(around: Column) -> Column:
    return around.rlike(f"(?iu){MEDICATION}")


def is_compound(text: Column) -> Column:
    return text.rlike(f"(?iu){COMPOUND}")


def has_short_name(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in SHORT_NAMES])


def structure_bonus(text: Column) -> Column:
    tokens = F.split(text, r"\s+")
    return F.when(F.size(tokens) == 3, 0.15).when(F.size(tokens) == 2, 0.1).when(F.size(tokens) == 1, -0.1).when(is_compound(F.array_join(F.slice(tokens, 1, 2), " ")), 0.2).otherwise(0.0)


def adjustment(name: Column, ahead: Column, behind: Column) -> Column:
    """What context and structure add to a name's confidence."""
    context = first_weight(ahead, POSITIVE) + first_weight(ahead, NEGATIVE) - _if(next_word(behind).isin(NEXT_WORDS), 0.3)
    total = context + structure_bonus(name) + _if(is_compound(name), 0.15) + _if(has_short_name(name), 0.1)
    return total - _if(in_medication(F.concat(ahead, name, behind)), 0.3)


def adjusted(span: Column, confidence: Column, pages: Column) -> Column:
    """Confidence after the heuristics: names only, and nothing is left of one that holds an eponym. pages: the text's."""
    context = F.struct(ahead_of(pages, span["start"], 60).alias("ahead"), behind(pages, span["end"], F.lit(40)).alias("behind"))
    moved = let(context, lambda c: _clamp(confidence + adjustment(span["text"], c["ahead"], c["behind"])))
    return F.when(span["type"] != "NOMBRE", confidence).when(is_eponym(span["text"]), 0.0).otherwise(moved)


def threshold(kind: Column, least: float = THRESHOLD, strict: bool = False) -> Column:
    return F.when(kind == "SOSPECHOSO", STRICT_ODD).otherwise(min(least, STRICT)) if strict else F.lit(least)
