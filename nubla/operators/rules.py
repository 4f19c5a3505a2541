"""The detection rules: what each one looks for, in the order in which ties are decided.

A rule's match is ``lead`` then ``body``; the span is the body (all of the match where there is no lead). The same patterns
serve Spark and the SQL that checks it, so they hold no look-around.
"""

from __future__ import annotations

from dataclasses import dataclass

from nubla.functions.dates import MONTHS
from nubla.functions.regex import alternation
from nubla.operators.dictionaries import Dictionaries, plain
from nubla.operators.lookup import GIVEN, PLACES


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    subtype: str
    confidence: float
    body: str
    lead: str = ""
    ignore_case: bool = False
    trim: bool = True  # cut white space at the end of the span
    least: int = 0  # characters
    check: str = ""  # a further condition, by name
    around: tuple[int, int, str] | None = None  # a cue within so many characters before and after
    kinds: tuple[str, ...] = ()  # the dictionaries whose entries begin the body
    behind: str = ""  # what follows an entry


# Patterns of the detectors.
CAPITAL, SMALL = "[A-ZÁÉÍÓÚÑ]", "[a-záéíóúñ]"
NAME = CAPITAL + SMALL + "+"
PARTICLES = r"(?:\s+(?:de|del|de la|de los|de las|y|i))?"
MONTH = "(?:" + "|".join(MONTHS) + ")"
YEAR = r"(?:19\d{2}|20\d{2}|2100)"
SCALE = r"^\d{1,2}-\d{1,2}/10$"  # a range on a pain scale, not a date
RELATIONS = ["esposa", "esposo", "madre", "padre", "hijo", "hija", "hermano", "hermana", "abuelo", "abuela", "tío", "tía", "primo", "prima", "sobrino", "sobrina", "cuñado", "cuñada", "suegro", "suegra", "yerno", "nuera", "pareja", "cónyuge", "tutor", "tutora"]
TITLES = r"\b(?:Dr\.|Dra\.|Doctor|Doctora|Facultativo|Enfermero|Enfermera|Enf\.|Fisioterapeuta|Psic[oó]log[oa]|Matrona|Farmac[eé]utic[oa]|Auxiliar|Técnico|T[eé]cnica)\s+"
COMPOUND_CITIES = ["Mairena del Aljarafe", "San Fernando", "San Sebastián", "San Sebastian", "Santa Cruz de Tenerife", "Las Palmas de Gran Canaria", "Palma de Mallorca", "Santiago de Compostela", "Alcalá de Henares", "Jerez de la Frontera", "Dos Hermanas", "El Puerto de Santa María", "Roquetas de Mar"]

IDENTIFIERS = [
    ("dni", "dni", 0.99, "", r"\b\d{8}[A-Za-z]\b", ""),
    ("nie", "nie", 0.99, "", r"\b[XYZxyz]\d{7}[A-Za-z]\b", ""),
    ("nuss", "nuss", 0.85, "", r"\b\d{12}\b", ""),
    ("nuss_slashed", "nuss", 0.95, "", r"\b\d{2}/\d{8}/\d{2}\b", ""),
    ("nuss_spaced", "nuss", 0.90, "", r"\b\d{2}\s+\d{8}\s+\d{2}\b", ""),
    ("dni_label", "dni", 0.95, r"(?:Documento|DNI|NIF)\s*:\s*", r"[^\n\r]*[^\s]", "i"),
    ("nhc", "nhc", 0.95, "", r"\b(?:NHC|Historia|H\.?C\.?)\s*:?\s*\d+", "i"),
    ("nhc_code", "nhc", 0.96, r"\b(?:NHC|N[º°]?\s*Historia|H\.?C\.?)\s*:?\s*", r"(?:[A-Z0-9]{2,}[/\-][A-Z0-9]{3,}|\d{4}[/\-]\d{5,8})\b", "i"),
    ("nhc_loose", "nhc", 0.90, "", r"\b\d{4}[/\-]\d{5,8}\b", ""),
    ("health_card", "tarjeta_sanitaria", 0.93, r"\b(?:CIP|SIP|TIS|TSI|Tarjeta\s+Sanitaria|N[úu]mero\s+de\s+Tarjeta\s+Sanitaria)\s*:?\s*", r"[A-Z]{0,4}\d{6,16}[A-Z0-9]{0,4}\b", "i"),
    ("phone", "telefono", 0.95, "", r"\b(?:\+34\s?)?[679]\d{2}[\s.\-]?\d{3}[\s.\-]?\d{3}\b", ""),
    ("phone_label", "telefono", 0.90, r"(?:Tel[eé]fono|Tfno|M[oó]vil|Tel)\s*:?\s*", r"[\d\s.+\-]+", "i9"),
    ("email", "email", 0.99, "", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", ""),
    ("email_label", "email", 0.95, r"(?:Email|Correo|E-mail)\s*:?\s*", r"[^\s,]+@[^\s,]+", "i"),
    ("address", "direccion", 0.97, "", r"\b(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino)\s+[^\n\r.]{3,120}", "iw"),
    ("address_label", "direccion", 0.98, r"(?:Direcci[oó]n|Domicilio)\s*:\s*", r"[^\n\r.]{5,140}", "i6"),
    ("postal_code", "codigo_postal", 0.80, "", r"\b(?:C\.?P\.?\s*:?\s*)?\d{5}\b", "c"),
    ("admin_code", "codigo_admin", 0.90, "", r"\b[A-Z]{2,4}[0-9]{2,4}[\-_][A-Z]{2,4}[\-_][0-9]{4,6}\b", ""),
    ("admin_code_label", "codigo_admin", 0.92, r"(?:C[oó]digo\s*(?:visado|expediente|referencia)?|Visado|Referencia|Ref\.?|Expediente)\s*:\s*", r"[A-Z0-9][\w/\-]+", "i5"),
    ("licence_number", "colegiado", 0.95, "", r"\b(?:Colegiado|Col\.?|N[º°]?\s*Coleg\.?)\s*:?\s*(?:\d{2}/\d{5,6}|\d{6,8})", "i"),
]


def rules(words: Dictionaries | None = None) -> list[Rule]:
    """All rules; ``check`` names what plain patterns can't say (see ``detect``).

    The patterns, subtypes and confidences below are fixed values.
    """
    words = words or Dictionaries()
    found = []
    for name, subtype, confidence, lead, body, how in IDENTIFIERS:
        least = int("".join(c for c in how if c.isdigit()) or 0)
        kind = "UBICACION" if subtype == "direccion" else "IDENTIFICADOR"
        found.append(Rule(name, kind, subtype, confidence, body, lead, "i" in how, "w" not in how, least, "postal" if "c" in how else ""))
    date = lambda name, subtype, confidence, body, lead="", check="": Rule(name, "FECHA", subtype, confidence, body, lead, name != "date_numeric", check=check)
    found += [
        date("date_numeric", "fecha_completa", 0.95, r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}\b", check="calendar"),
        date("date_textual", "fecha_completa", 0.95, rf"\b\d{{1,2}}\s+de\s+{MONTH}\s+(?:de\s+|del\s+)?\d{{4}}\b"),
        date("date_partial", "fecha_parcial", 0.85, rf"\b{MONTH}\s+(?:de\s+)?\d{{4}}\b", check="uncontained"),
        date("year_context", "ano", 0.78, YEAR + r"\b", r"\b(?:en|desde|hasta|durante|diagnosticad[oa]\s+en|ingresad[oa]\s+en|alta\s+en|consulta\s+en|seguimiento\s+desde)\s+", check="uncontained"),
        date("year_label", "ano", 0.82, YEAR + r"\b", r"\b(?:Año|Anio)\s*:?\s*", check="uncontained"),
    ]
    place = lambda name, subtype, confidence, body, lead="", i=True, **more: Rule(name, "UBICACION", subtype, confidence, body, lead, i, **more)
    two, care = rf"{NAME}(?:\s+{NAME})?", r"(hospital|h\.u\.|cl[ií]nica|centro\s+de\s+salud|ingresad[oa]|derivad[oa]|seguimiento|urgencias|consulta)"
    unaccented = [plain(c) for c in words.places if plain(c) != c.lower()]
    entry = lambda entries, behind="": rf"\b(?:{alternation(entries)}){behind or chr(92) + 'b'}"
    found += [
        place("hospital_pattern", "hospital", 0.95, rf"\b(?:complejo hospitalario|hospital|clínica|clinica|centro de salud|consultorio|h\.u\.|h\.)\s+(?:(?:universitario|infantil|general|regional|comarcal|provincial|materno|clínico|clinico)\s+)*(?:de\s+(?:día\s+|dia\s+)?)?{NAME}(?:\s+(?:de\s+la\s+|del\s+|de\s+)?{NAME})*", check="hospital"),
        place("hospital_dict", "hospital", 0.91, entry(words.hospitals), around=(35, 25, care), kinds=("hospitals",)),
        place("centre_prefix", "hospital", 0.90, rf"\b(?:{alternation(words.centre_prefixes)})\s+{CAPITAL}[^\n\r.;,]{{2,80}}", i=False, check="centre"),
        place("city_dict", "ciudad", 0.90, entry(words.places), kinds=PLACES),
        place("city_unaccented", "ciudad", 0.85, entry(unaccented), kinds=("unaccented",)),
        place("geo_context", "contexto", 0.85, two, r"\b(?:[Vv]ive?|[Vv]iven?|[Rr]eside|[Rr]esidente?|[Rr]esiden?|[Nn]atural(?:es)?|[Pp]rocedente|[Dd]omiciliado|[Dd]omiciliada|[Vv]ecino|[Vv]ecina)\s+(?:en\s+|de\s+)", i=False),
        place("admin_context", "contexto", 0.88, two, r"\b(?:[Mm]unicipio|[Ll]ocalidad|[Pp]rovincia|[Cc]omarca)\s+de\s+", i=False),
        place("district_context", "barrio", 0.84, rf"{NAME}(?:\s+{NAME}){{0,2}}", r"\b(?:barrio|distrito|zona|urbanizaci[oó]n)\s+de\s+"),
        place("district_dict", "barrio", 0.80, entry(words.districts), around=(25, 25, r"(barrio|distrito|zona|calle|avenida|domicilio|direcci[oó]n|reside|vive)"), kinds=("districts",)),
        place("compound_city", "ciudad", 0.92, r"\b(?:" + "|".join(c.replace(" ", r"\s+") for c in COMPOUND_CITIES) + r")\b"),
    ]
    person = lambda name, subtype, confidence, body, lead="", i=True, **more: Rule(name, "NOMBRE", subtype, confidence, body, lead, i, **more)
    names = rf"(?:{PARTICLES}\s+{NAME}){{1,3}}\b"
    found += [
        person("professional", "profesional", 0.90, rf"{TITLES}{NAME}(?:\s+{NAME}){{0,3}}", check="professional"),
        person("patient_phrase", "paciente", 0.88, rf"{NAME}(?:{PARTICLES}\s+{NAME}){{1,4}}", r"\bpaciente\s+(?:es\s+|se\s+llama\s+)?", check="patient"),
        person("patient_label", "paciente", 0.95, rf"{NAME}(?:{PARTICLES}\s+{NAME}){{0,4}}[ \t]*(?:[\n\r]|\z)", r"Nombre\s*:\s*", check="labelled"),
        person("patient_dict", "paciente", 0.82, entry([*words.women, *words.men, *words.unisex], names), i=False, check="patient", kinds=GIVEN, behind=names),
        person("patient_abbreviated", "paciente", 0.90, rf"\b(?:{alternation(words.abbreviations)})\s+{NAME}(?:\s+{NAME}){{1,3}}\b", i=False),
        person("relative_label", "familiar", 0.95, rf"{NAME}(?:\s+{NAME}){{0,4}}", r"(?:Acompañante|Familiar|Contacto)\s*:?\s*", check="relative"),
        person("relative_block", "familiar", 0.98, rf"\b(?:{alternation(RELATIONS + ['abuela materna', 'abuela paterna', 'abuelo materno', 'abuelo paterno', 'hermano mayor', 'hermana mayor'])})\s*\([^)]+\)", check="named_block"),
        person("relative_simple", "familiar", 0.90, rf"\b(?:madre|padre|esposo|esposa|hijo|hija)\s*:\s*{NAME}(?:\s+{NAME}){{0,2}}"),
        person("relative_age", "familiar", 0.92, rf"\({NAME}(?:\s+{NAME}){{1,2}},\s*\d{{1,3}}\s*a[ñn]os?\)", check="free"),
    ]
    odd = lambda name, confidence, body, lead="", i=True, **more: Rule(name, "SOSPECHOSO", name, confidence, body, lead, i, **more)
    found += [
        odd("singularidad", 0.90, r"\b(?:únic[oa]s?\s+pacientes?|caso\s+[úu]nico|único\s+caso)\b"),
        odd("enfermedad_rara", 0.88, rf"\b(?:s[ií]ndrome|enfermedad)\s+de\s+{NAME}(?:\s+{NAME}){{0,2}}\b", i=False),
        odd("cargo_publico", 0.86, r"\b(?:alcalde|alcaldesa|concejal|concejala|diputad[oa]|senador(?:a)?|juez|magistrad[oa]|delegad[oa])(?:\s+del?\s+(?:municipio|ayuntamiento|consistorio|distrito|barrio|partido))?\b"),
        odd("parentesco_especial", 0.86, r"\b(?:herman[oa]\s+gemel[oa]|gemel[oa]\s+de|hij[oa]\s+[úu]nic[oa])\b"),
        odd("profesion_especifica", 0.75, r"[A-Za-zÁÉÍÓÚÑáéíóúñ][^\n\r,.]{4,80}", r"\b(?:Profesi[oó]n|Ocupaci[oó]n)\s*:\s*"),
    ]
    return found


# Words that end or bar a name or a place.
PLACE_ENDS = ["período", "periodo", "médico", "medico", "enfermera", "enfermero", "doctor", "doctora", "paciente", "tratamiento", "consulta", "cita", "urgencias", "ingreso", "alta", "derivación", "derivacion", "semana", "mes", "año", "día", "dia", "criterios", "valoración", "valoracion", "evaluación", "evaluacion", "gravedad", "cumplidos", "cumplidas", *MONTHS, "el", "la", "los", "las", "desde", "hasta", "durante", "para", "por", "con"]
PLACE_CUTS = [rf"\s+(del?\s+\d+\s+)?({'|'.join(PLACE_ENDS)}).*\z", rf"\s+del?\s+\d{{1,2}}\s*(?:de\s+)?{MONTH}?\s*\d{{0,4}}\z", r"\s+el\s+\d{1,2}\s+de\s*\z"]
NOT_PROFESSIONAL = [
    "especialista", "dermatología", "cardiología", "pediatría", "cirugía", "medicina", "oncología", "neurología", "psiquiatría", "traumatología", "ginecología", "urología", "oftalmología", "otorrinolaringología", "neumología", "digestivo", "endocrinología", "reumatología", "nefrología", "hematología", "geriatría", "radiología", "anestesiología",
    "residente", "adjunto", "adjunta", "jefe", "jefa", "responsable", "coordinador", "coordinadora", "supervisor", "supervisora", "titular", "interino", "interina", "suplente", "correcta", "valoración", "valoracion", "técnica", "tecnica", "evaluación", "evaluacion", "escalas", "protocolo", "procedimiento", "intervención", "intervencion",
    "médico", "medico", "servicio", "unidad", "área", "area", "consulta", "planta",
    "derivada", "derivado", "desde", "hacia", "para", "con", "del", "de", "la", "el", "en", "según", "segun", "mediante", "durante", "tras", "ante", "sobre", "bajo", "entre",
]
NOT_PATIENT = [
    "que", "refiere", "estable", "consciente", "orientado", "orientada", "presenta", "muestra", "niega", "afirma", "con", "sin", "ha", "fue", "es", "no", "si", "sí", "está", "siendo", "tratado", "tratada", "derivado", "derivada", "diagnosticado", "diagnosticada", "ingresado", "ingresada", "dado", "dada", "competente", "capacitado", "capacitada", "valorado", "valorada", "evaluado", "evaluada", "estabilizado", "estabilizada",
    "mujer", "hombre", "varón", "adulto", "adulta", "joven", "anciano", "anciana", "menor", "niño", "niña", "bebé", "recién", "lactante", "gestante", "embarazada", "crónico", "crónica", "agudo", "aguda", "terminal", "grave", "leve", "moderado", "moderada", "pluripatológico", "pluripatológica", "polimedicado", "polimedicada", "crítico", "crítica",
    "residente", "reside", "vive", "domiciliado", "domiciliada", "natural", "procedente", "vecino", "vecina", "nacido", "nacida",
]
NOT_SURNAME = ["derivada", "derivado", "desde", "hacia", "hasta", "para", "entre", "fármaco", "farmaco", "tratamiento", "medicación", "medicacion", "terapia", "dosis", "administración", "administracion", "autoadministración", "autoadministracion", "hospital", "clínica", "clinica", "centro", "servicio", "unidad", "consulta", "el", "la", "los", "las", "del", "de", "al", "con", "por", "en", "que", "como", "presenta", "refiere", "acude", "ingresa", "solicita", "requiere"]
NOT_RELATIVE = ["telefónico", "telefono", "teléfono", "presencial", "urgente", "pendiente", "ninguno", "desconocido", "no", "si", "sí"]
NAME_PARTICLES = ["de", "del", "la", "las", "los", "y", "i"]
