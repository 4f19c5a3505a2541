"""Longitudinal tables: column profiling, study ids, visit numbers, value codes, correspondence and validation.

A table has an ordinal column (``order``) that tells the order of its rows; cells are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nubla.functions.dates import age, table_date
from nubla.functions.text import sample, trim_space

BROADCAST_ROWS = 50_000
# What columns are called, what is done with them, and what code prefixes are made of.
HEADERS = {
    "PATIENT_ID": r"^(nhc|n[º°]?_?hist|id_?pac|codigo_?pac|num_?pac|patient_?id)",
    "NAME": r"^(nombre|name|paciente$|first_?name)",
    "SURNAME": r"^(apellido|surname|last_?name)",
    "FULL_NAME": r"^(nombre_?completo|full_?name|pac_?nombre)",
    "DNI": r"^(dni|nif|nie|documento|id_?fiscal)",
    "PHONE": r"^(tel[eé]fono|phone|m[oó]vil|mobile|tfno)",
    "EMAIL": r"^(email|correo|e-?mail|mail)",
    "BIRTHDATE": r"^(fecha_?nac|f_?nac|birthdate|nacimiento|fec_?nac)",
    "VISIT_DATE": r"^(fecha_?vis|f_?vis|fecha_?consulta|fecha$|date)",
    "ADDRESS": r"^(direcci[oó]n|address|domicilio|calle|dir)",
    "POSTAL_CODE": r"^(cp|cod_?postal|postal|zip)",
    "CENTER": r"^(centro|hospital|h_|clinic|servicio)",
    "DOCTOR": r"^(m[eé]dico|doctor|dr_?|facultativo|responsable)",
}
CONTENTS = {
    "DNI": r"(?i)^(\d{8}[A-Z]|[XYZ]\d{7}[A-Z])$",
    "PHONE": r"^(\+34)?[67]\d{8}$",
    "EMAIL": r"^[^\s@]+@[^\s@]+\.[^\s@]+$",
    "VISIT_DATE": r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}$",
    "PATIENT_ID": r"^\d{5,12}$",
}
ACTIONS = {"PATIENT_ID": "PATIENT_ID", "NAME": "REMOVE", "SURNAME": "REMOVE", "FULL_NAME": "REMOVE", "DNI": "REMOVE", "PHONE": "REMOVE", "EMAIL": "REMOVE", "BIRTHDATE": "TO_AGE", "VISIT_DATE": "KEEP", "ADDRESS": "REMOVE", "POSTAL_CODE": "REMOVE", "CENTER": "CODIFY", "DOCTOR": "REMOVE", "UNKNOWN": "KEEP"}
HEADER_WORDS = r"(?iu)^(nhc|nombre|apellido|fecha|dni|paciente|id|codigo|edad|sexo|telefono|email|direccion|centro|medico|diagnostico|procedimiento|visita)"


def _holds(kind: str, value: Column) -> Column:
    value = F.regexp_replace(value, r"[\s.\-]", "") if kind == "PHONE" else value
    return value.rlike(CONTENTS[kind])


def column_type(name: Column, value: Column) -> Column:
    """A column's type by its name (first pattern that fits), else by a sample value."""
    value = trim_space(F.coalesce(value, F.lit("")))
    named = [F.when(name.rlike(f"(?iu){p}"), k) for k, p in HEADERS.items()]
    return F.coalesce(*named, *[F.when(_holds(k, value), k) for k in CONTENTS], F.lit("UNKNOWN"))


def profile(columns: DataFrame) -> DataFrame:
    """(name, value) of each column -> originalName, sample, detectedType, suggestedAction, confidence."""
    kind = F.col("detectedType")
    value = trim_space(F.coalesce("value", F.lit("")))
    by_name = F.coalesce(*[F.when((kind == k) & F.col("name").rlike(f"(?iu){p}"), True) for k, p in HEADERS.items()], F.lit(False))
    by_value = F.coalesce(*[F.when(kind.isin(*(["VISIT_DATE", "BIRTHDATE"] if k == "VISIT_DATE" else [k])), _holds(k, value)) for k in CONTENTS], F.lit(False))
    action = F.coalesce(*[F.when(kind == k, v) for k, v in ACTIONS.items()])
    sure = F.when(kind == "UNKNOWN", 0.3).when(by_name & by_value, 0.95).when(by_name | by_value, 0.7).otherwise(0.5)
    out = columns.withColumn("detectedType", column_type(F.col("name"), F.col("value")))
    return out.select(F.col("name").alias("originalName"), sample(F.col("value")).alias("sample"), "detectedType", action.alias("suggestedAction"), sure.alias("confidence"))


def first_values(table: DataFrame, order: str) -> DataFrame:
    """(name, value): each column's value in the first row; an empty table gives nulls."""
    names = [c for c in table.columns if c != order]
    first = table.agg(F.min_by(F.struct(*[F.col(c).cast("string").alias(c) for c in names]), order).alias("r"))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"r.{c}").alias("value")) for c in names])
    return first.select(F.explode(pairs).alias("c")).select("c.name", "c.value")


def patient_column(profiled: DataFrame) -> DataFrame:
    """The column that tells patients apart: the surest PATIENT_ID above .7, if any."""
    return profiled.filter("detectedType = 'PATIENT_ID' and confidence > 0.7").orderBy(F.desc("confidence"), "originalName").limit(1).select("originalName", "confidence")


def header_row(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(row, cells array<string>) of a sheet's first rows -> the number of the row that holds the headers, 0 where none seems
    to; for each value of ``by``, such as the sheet's file, if given."""
    filled = F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    number = F.filter(filled, lambda c: c.try_cast("double").isNotNull())
    words = F.size(filled) - F.size(number)
    known = F.exists(filled, lambda c: c.rlike(HEADER_WORDS))
    fits = (words >= 3) & (known | (words > F.size(number)))
    return rows.filter("row < 10").groupBy(*(by or [])).agg(F.coalesce(F.min(F.when(fits, F.col("row"))), F.lit(0)).alias("header"))


def key_of(value: Column) -> Column:
    """A cell as a patient's key: trimmed text, null where blank."""
    text = trim_space(value.cast("string"))
    return F.when(text != "", text)


def number_globally(rows: DataFrame, order: str, name: str, parts: int = 256) -> DataFrame:
    """``rows`` numbered from 1 by a numeric column without ties, in ranges that tasks number apart.

    Quantiles bound the ranges, and a small table has how many rows come before each: both are computed inside the plan.
    """
    steps = [i / parts for i in range(1, parts)]
    value = F.col(order).cast("double")
    cuts = rows.agg(F.coalesce(F.array_distinct(F.percentile_approx(value, steps, 10_000)), F.array().cast("array<double>")).alias("cuts")).scalar()
    ranged = rows.withColumn("_cuts", cuts).withColumn("_part", F.size(F.filter("_cuts", lambda b: b < value))).drop("_cuts")
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def patient_mapping(table: DataFrame, patient: str, order: str, prefix: str = "PAC") -> DataFrame:
    """(patient, first_row, study_id, visits): study ids by first appearance; blank ids have none."""
    seen = table.select(key_of(F.col(patient)).alias("patient"), F.col(order).alias("first_row")).filter("patient is not null")
    seen = seen.groupBy("patient").agg(F.min("first_row").alias("first_row"), F.count("*").alias("visits"))
    return number_globally(seen, "first_row", "n").select("patient", "first_row", F.format_string(f"{prefix}_%03d", "n").alias("study_id"), "visits")


def code_prefix(column: str) -> str:
    name = column.upper()
    for words, prefix in ((("CENTRO", "HOSPITAL"), "CENTRO"), (("SERVICIO",), "SERV"), (("MEDICO", "DOCTOR"), "MED")):
        if any(w in name for w in words):
            return prefix
    return "COD"


def code_key(value: Column) -> Column:
    return trim_space(F.lower(F.coalesce(value.cast("string"), F.lit(""))))


def codes(table: DataFrame, column: str, order: str) -> DataFrame:
    """(original, code): the values of a column, without regard to case, numbered by first appearance."""
    seen = table.groupBy(code_key(F.col(column)).alias("original")).agg(F.min(order).alias("first_row"))
    return number_globally(seen, "first_row", "n").select("original", F.format_string(f"{code_prefix(column)}_%02d", "n").alias("code"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, computed once and broadcast if it has ``BROADCAST_ROWS`` rows at most; as it is beyond that."""
    got = df.limit(BROADCAST_ROWS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema)) if len(got) <= BROADCAST_ROWS else df


def patient_of(actions: dict[str, str]) -> str:
    """The column that has PATIENT_ID; an error if there is none."""
    found = [c for c, a in actions.items() if a == "PATIENT_ID"]
    if not found:
        raise ValueError("no column has the action PATIENT_ID")
    return found[0]


def with_visits(table: DataFrame, patient: str, order: str) -> DataFrame:
    """``table`` without blank patients, with ``Visita_Num``: a patient's rows in order."""
    rows = table.withColumn("_patient", key_of(F.col(patient))).filter("_patient is not null")
    return rows.withColumn("Visita_Num", F.row_number().over(Window.partitionBy("_patient").orderBy(order)))


def anonymise(table: DataFrame, actions: dict[str, str], order: str, reference: str, prefix: str = "PAC", number_visits: bool = True) -> DataFrame:
    """The table to share: study id, visit number, and each column by its action.

    KEEP as it is; REMOVE gone; TO_AGE as ``Edad`` in full years at ``reference``; CODIFY as codes. Exactly one column has
    PATIENT_ID; rows where it is blank go. A column without an action is kept, but a further PATIENT_ID never is.
    """
    patient = patient_of(actions)
    mapping = patient_mapping(table, patient, order, prefix).select(F.col("patient").alias("_patient"), F.col("study_id").alias("ID_ESTUDIO"))
    out = with_visits(table, patient, order).join(mapping, "_patient")
    for c in [c for c, a in actions.items() if a == "CODIFY"]:
        coded = codes(table, c, order).select(F.col("original").alias("_key"), F.col("code").alias("_code"))
        out = out.withColumn("_key", code_key(F.col(c))).join(_small(coded), "_key").withColumn(c, F.col("_code")).drop("_key", "_code")
    columns = ["ID_ESTUDIO", *(["Visita_Num"] if number_visits else [])]
    aged = [c for c, a in actions.items() if a == "TO_AGE"]
    if aged:
        columns.append(age(table_date(F.col(aged[-1]).cast("string")), F.lit(reference).cast("date")).alias("Edad"))
    columns += [c for c in table.columns if c != order and actions.get(c, "KEEP") in ("KEEP", "CODIFY")]
    return out.select(order, *columns)


def correspondence(table: DataFrame, actions: dict[str, str], order: str, prefix: str = "PAC") -> DataFrame:
    """The table to keep apart: study id, visits, and what identifies a patient, from the first of the patient's rows."""
    patient = patient_of(actions)
    names = [c for c, a in actions.items() if a in ("REMOVE", "PATIENT_ID")]
    first = table.withColumn("_patient", key_of(F.col(patient))).filter("_patient is not null")
    first = first.groupBy("_patient").agg(F.min_by(F.struct(*names), order).alias("r"))
    mapping = patient_mapping(table, patient, order, prefix)
    return mapping.join(first, F.col("patient") == F.col("_patient")).select(F.col("study_id").alias("ID_ESTUDIO"), F.col("visits").alias("Total_Visitas"), "r.*")


def column_mapping(table: DataFrame, actions: dict[str, str]) -> DataFrame:
    """(original, action, final): what became of each column; null where it went."""
    final = {"REMOVE": None, "TO_AGE": "Edad", "PATIENT_ID": "ID_ESTUDIO"}
    return table.sparkSession.createDataFrame([(c, a, final.get(a, c)) for c, a in actions.items()], "original string, action string, final string")


def _one_digit(a: Column, b: Column) -> Column:
    return F.format_string("%.1f", (F.floor(a / b * 10 + 0.5) / 10).cast("double"))


def table_stats(table: DataFrame, actions: dict[str, str]) -> DataFrame:
    """Rows, patients, visits a patient (one digit), and columns removed, kept and transformed."""
    patient = patient_of(actions)
    count = lambda *kinds: F.lit(sum(a in kinds for a in actions.values())).cast("long")
    out = table.agg(F.count("*").alias("rows"), F.count_distinct(key_of(F.col(patient))).alias("patients"))
    return out.select("rows", "patients", _one_digit(F.col("rows"), F.col("patients")).alias("visits_per_patient"), count("REMOVE").alias("removed"), count("KEEP", "CODIFY").alias("kept"), count("TO_AGE", "CODIFY").alias("transformed"))


def blank_ids(table: DataFrame, patient: str, order: str) -> DataFrame:
    """(row, message): rows without a patient."""
    return table.filter(key_of(F.col(patient)).isNull()).select(F.col(order).alias("row"), F.lit("ID de paciente vacío").alias("message"))


def _dated(table: DataFrame, patient: str, day: str, order: str) -> DataFrame:
    rows = table.select(key_of(F.col(patient)).alias("patient"), F.col(order).alias("row"), F.trim(F.col(day).cast("string")).alias("raw"))
    return rows.withColumn("day", table_date(F.col("raw"))).filter("patient is not null and day is not null")


def unordered_visits(table: DataFrame, patient: str, day: str, order: str) -> DataFrame:
    """(patient, row, previous_row): the first visit of a patient that lies before the one above it."""
    above = Window.partitionBy("patient").orderBy("row")
    rows = _dated(table, patient, day, order).withColumn("last_day", F.lag("day").over(above)).withColumn("last_row", F.lag("row").over(above))
    bad = rows.filter("day < last_day").groupBy("patient").agg(F.min_by(F.struct("row", "last_row"), "row").alias("r"))
    return bad.select("patient", F.col("r.row").alias("row"), F.col("r.last_row").alias("previous_row"))


def repeated_days(table: DataFrame, patient: str, day: str, order: str) -> DataFrame:
    """(patient, visits, days): patients with fewer different days, as written, than visits."""
    out = _dated(table, patient, day, order).groupBy("patient").agg(F.count("*").alias("visits"), F.count_distinct("raw").alias("days"))
    return out.filter("days < visits")


def validation_summary(table: DataFrame, patient: str, day: str, order: str) -> DataFrame:
    """One row: patients, rows, visits a patient, and patients with one, several, unordered and repeated visits.

    One pass: rows meet by patient once; those without one are each a group of their own.
    """
    rows = table.select(key_of(F.col(patient)).alias("p"), F.col(order).alias("row"), F.trim(F.col(day).cast("string")).alias("raw"))
    rows = rows.withColumn("day", table_date(F.col("raw"))).withColumn("key", F.coalesce("p", F.concat(F.lit("\0"), F.col("row").cast("string"))))
    earlier = Window.partitionBy("key").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("last_day", F.last("day", ignorenulls=True).over(earlier))
    days = F.size(F.collect_set(F.when(F.col("day").isNotNull(), F.col("raw"))))
    each = rows.groupBy("key", "p").agg(F.count("*").alias("n"), F.count("day").alias("dated"), days.alias("days"), F.coalesce(F.bool_or(F.col("day") < F.col("last_day")), F.lit(False)).alias("unordered"))
    known = F.col("p").isNotNull()
    out = each.agg(F.count("p").alias("patients"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(known & (F.col("n") == 1)).alias("single"), F.count_if(known & (F.col("n") > 1)).alias("several"), F.count_if(known & F.col("unordered")).alias("unordered"), F.count_if(known & (F.col("days") < F.col("dated"))).alias("repeated"))
    return out.select("patients", "rows", _one_digit(F.col("rows"), F.col("patients")).alias("visits_per_patient"), "single", "several", "unordered", "repeated")
