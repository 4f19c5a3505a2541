"""Dates written in notes and tables, ages, and intervals in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months as they are written: fixed values.
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]


def make(year: Column, month: Column, day: Column) -> Column:
    """A date whose month or day may overflow into the next (31 February is 2 or 3 March); null out of Spark's range."""
    first = F.make_date(F.when(year.between(1, 9999), year), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, month - 1), day - 1)


def full_year(digits: Column) -> Column:
    """Two digits above 50 are of the last century; other lengths stand for themselves."""
    n = F.try_to_number(digits, F.lit("9999")).cast("int")
    return F.when(F.length(digits) == 2, F.when(n > 50, n + 1900).otherwise(n + 2000)).otherwise(n)


def numeric_date(text: Column) -> Column:
    """``d/m/y`` or ``d-m-y``, else null."""
    pattern = r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = lambda i: F.try_to_number(part(i), F.lit("99")).cast("int")
    return F.when(text.rlike(pattern), make(full_year(part(3)), number(2), number(1)))


def note_date(text: Column) -> Column:
    """A year, ``d/m/y``, or ``d de MES (de) yyyy``; null for other forms (``del yyyy`` among them)."""
    words = r"(?iu)^(\d{1,2})\s+de\s+(" + "|".join(MONTHS) + r")\s+(?:de\s+)?(\d{4})$"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, words, 2))).cast("int")
    spoken = make(F.regexp_extract(text, words, 3).try_cast("int"), month, F.regexp_extract(text, words, 1).try_cast("int"))
    return F.when(text.rlike(r"^\d{4}$"), make(text.try_cast("int"), F.lit(1), F.lit(1))).when(text.rlike(words), spoken).otherwise(numeric_date(text))


def table_date(value: Column) -> Column:
    """``d/m/y`` in a table's cell, else an ISO date or timestamp."""
    value = F.trim(value)
    return F.coalesce(numeric_date(value), F.try_to_timestamp(value).cast("date"))


def age(birth: Column, reference: Column) -> Column:
    """Full years."""
    early = (F.month(reference) < F.month(birth)) | ((F.month(reference) == F.month(birth)) & (F.dayofmonth(reference) < F.dayofmonth(birth)))
    return F.year(reference) - F.year(birth) - F.when(early, 1).otherwise(0)


def _rounded(days: Column, unit: int) -> Column:
    return F.floor(days / unit + 0.5).cast("string")


def relative(days: Column) -> Column:
    """How long ago, or until, ``days`` is."""
    past = F.when(days < 7, F.concat(F.lit("hace "), days.cast("string"), F.lit(" días")))
    past = past.when(days < 30, F.concat(F.lit("hace "), _rounded(days, 7), F.lit(" semanas"))).when(days < 365, F.concat(F.lit("hace "), _rounded(days, 30), F.lit(" meses")))
    past = past.otherwise(F.concat(F.lit("hace "), _rounded(days, 365), F.lit(" años")))
    ahead = -days
    future = F.when(ahead < 7, F.concat(F.lit("en "), ahead.cast("string"), F.lit(" días")))
    future = future.when(ahead < 30, F.concat(F.lit("en "), _rounded(ahead, 7), F.lit(" semanas"))).when(ahead < 365, F.concat(F.lit("en "), _rounded(ahead, 30), F.lit(" meses")))
    future = future.otherwise(F.concat(F.lit("en "), _rounded(ahead, 365), F.lit(" años")))
    return F.when(days == 0, "hoy").when(days == 1, "hace 1 día").when(days == -1, "mañana").when(days > 0, past).otherwise(future)


def since_visit(days: Column) -> Column:
    """The interval from one visit to the next."""
    counted = lambda unit, one, many: F.concat(_rounded(days, unit), F.when(F.floor(days / unit + 0.5) > 1, many).otherwise(one))
    return (
        F.when(days == 0, "mismo día que")
        .when(days == 1, "1 día después de")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" días después de")))
        .when(days < 30, F.concat(counted(7, " semana", " semanas"), F.lit(" después de")))
        .when(days < 365, F.concat(counted(30, " mes", " meses"), F.lit(" después de")))
        .otherwise(F.concat(counted(365, " año", " años"), F.lit(" después de")))
    )
