"""Deterministic relations of notes (from customers) and visits (from orders); one SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DAY = "lpad(cast(day({0}) as string), 2, '0') || '/' || lpad(cast(month({0}) as string), 2, '0') || '/' || cast(year({0}) as string)"


def _pick(values: str, by: str) -> str:
    return f"split_part('{values}', ',', cast({by} % {values.count(',') + 1} as int) + 1)"


#: One note for each customer; its template turns with the customer's key.
TEMPLATES = [
    "'Paciente ' || nom || ' ' || ap1 || ', DNI ' || dni || ', acude el ' || dia || '. Dolor 8/10 y 2-3/10. Tel: ' || tel || '. Vive en ' || ciu || '.'",
    "'Intervención del ' || dia || ' por Dr. ' || nom2 || ' ' || ap2 || ' y Dra. Patricia ' || ap1 || '. Firma el Dr. ' || ap2 || '. Hospital Virgen del Rocío de ' || ciu || '. NHC: 2024/0' || num5 || '.'",
    "'NIE X' || substr(dni, 2) || '. Afiliación 28' || num5 || '12345, 28/' || substr(dni, 1, 8) || '/10 y 12 ' || substr(dni, 1, 8) || ' 90. Colegiado: 28/' || num5 || '. Teléfono: ' || tel || ' y Tfno 9' || num5 || ' 12.'",
    "'Nombre: ' || nom || ' ' || ap1 || ' ' || ap2 || nl || 'DNI: ' || dni || ' provisional' || nl || 'Domicilio: Calle Mayor ' || num5 || ', ' || ciu || nl || 'C.P. ' || num5 || '. Email: user.' || num5 || '@mail.es, correo otro' || num5 || '@salud.org'",
    "'Madre (Rosa ' || ap1 || ', 68 años). Padre: José ' || ap2 || '. Familiar: ' || nom || ' ' || ap1 || '. Contacto: Telefónico. Avisar (Elena ' || ap2 || ', 40 años) o hermana mayor (sin datos). Hijo: Luis ' || ap1 || '.'",
    "'Visto el 3 de ' || mes || ' de 2024 y el 18 de mayo del 2023; revisión en junio de 2025 y ' || mes || ' 2022. Diagnosticada en 2019 y desde 20' || substr(num5, 4, 2) || '. Año: 2011. No vale 31/13/2024 ni 40/02/2024; sí 31/02/2024 y 15/03/99 y ' || dia || '.'",
    "'Diagnóstico de síndrome de Wolfram, caso único. Alcalde del municipio y Hermano gemelo de ' || nom || ' ' || ap1 || '. Profesión: Maestra de primaria en ' || ciu || ', jubilada. Enfermedad de Parkinson en ' || nom || ' Wilson ' || ap1 || '.'",
    "'Ref: AB' || num5 || '. Código visado: VD2024-SEV-' || num5 || '. Otro XY24-AB-' || num5 || '. CIP: ABCD' || num5 || '67890. Historia ' || num5 || ', H.C. ' || num5 || '/AB1 y 2023-4' || num5 || '. Tarjeta Sanitaria 1234' || num5 || '.'",
    "'Derivado a H.U. La Paz desde Centro de Salud Los Rosales con informe. Hospital General de ' || ciu || ' el 3 de mayo. Ingresado en Miguel Servet; seguimiento en Hospital La Paz y Hospital Infanta Elena. Consultorio Norte por la tarde.'",
    "'Reside en barrio de Triana y antes en ' || ciu || '; municipio de Albarracín, zona de ' || ap1 || '. Natural de Palma de Mallorca, vecino de Malaga, Avila, Ávila y ' || ciu || '. Avenida de ' || ap2 || ' 7, distrito Salamanca. Paseo largo de la tarde'",
    "'Mª José Ruiz Gil y Fco. ' || nom || ' ' || ap1 || ' toman 500 mg cada 8 horas. Tratamiento de ' || nom || ' ' || ap2 || '. Paciente ' || nom || ' de la ' || ap1 || ' García refiere mejoría. María del Carmen ' || ap2 || ' normal.'",
    "'Paciente estable que refiere dolor. El paciente es ' || nom || ' ' || ap1 || ' y ' || ap2 || '. Auxiliar derivada, Enfermera Lucía ' || ap1 || ' desde planta, Técnico Residente Turno, Psicóloga Marta Sol. Fisioterapeuta Iker.'",
    "'😀 Ana ' || ap1 || ' con DNI ' || dni || ' en ' || ciu || ', Toledo y Sevilla; luego Toledo, ' || ciu || ' y Jerez de la Frontera. Centro Médico Sur de ' || ciu || ', Clínica Santa Elena'",
    "'Firmado por ' || nom || ' ' || ap2 || '. Escala de ' || nom || ' ' || ap1 || '. Hospital de ' || ciu || '. Médico: Dra. ' || nom2 || ' ' || ap1 || ' ' || ap2 || ', valorado por Dr. ' || ap1 || ' y Doctora ' || nom2 || ' ' || ap1 || '. Doctor Tal Cual Otro Mas.'",
    "'Citas: ' || dia || ', ' || dia2 || ', ' || dia3 || ', ' || dia || ' y 01/01/2026; próxima 02/01/2026 o 20/02/2026. Nacido el 08/05/1978. Hospital de día de ' || ciu || '. Abuela (Carmen ' || ap2 || ') y Abuela: ' || nom || '.'",
    "'  ' || nl || 'Sin datos. Valores 12345 99999 00999, tel +34 ' || tel || ' y ' || tel || '. correo@x.es ' || nl || 'Juan Carlos ' || ap1 || ' acude con esposa: Ana ' || ap2 || '. Dirección: Plaza del Ayuntamiento 1, ' || ciu || '. Único paciente.'",
]

NOTES = f"""
select note_id, case {' '.join(f'when note_id % {len(TEMPLATES)} = {i} then {t}' for i, t in enumerate(TEMPLATES))} end as text
from (select key as note_id, chr(10) as nl,
  {_pick('Ana,Luis,Carmen,Pedro,Lucía,Jorge,María del Carmen,Xurxo', 'key')} as nom, {_pick('Juan,Elena,Miguel,Rocío,Zoe', 'other')} as nom2,
  {_pick('García,López,Toledo,Barrera,Martínez,Zubiri,Ruiz', 'key')} as ap1, {_pick('Sánchez,Peña,Ibarra,Gómez,Vidal', '(key + other)')} as ap2,
  {_pick('Sevilla,Teruel,Barcelona,Palencia,Vilafranca,Jaén', '(other + key)')} as ciu,
  {_pick('enero,febrero,marzo,abril,mayo,junio,julio,agosto,septiembre,octubre,noviembre,diciembre', 'other')} as mes,
  lpad(cast(key % 100000000 as string), 8, '0') || substr('TRWAGMYFPDXBNJZSQVHLCKE', cast(key % 23 as int) + 1, 1) as dni,
  lpad(cast(other % 100000 as string), 5, '0') as num5,
  '6' || lpad(cast(key % 100 as string), 2, '0') || '-' || lpad(cast(other % 1000 as string), 3, '0') || '-' || lpad(cast(key % 1000 as string), 3, '0') as tel,
  {_DAY.format('day')} as dia, {_DAY.format("(day + interval '9' day)")} as dia2, {_DAY.format("(day + interval '75' day)")} as dia3
from (select c_custkey as key, c_custkey * 7 + c_nationkey as other, date '2019-01-31' + cast(c_custkey * 13 % 2500 as int) as day from customer) as c) as base"""

#: A row for each order: patients with visits, centres and names, some of them blank.
VISITS = f"""
select o_orderkey as fila, case when o_orderkey % 97 = 0 then ' ' else cast(o_custkey as string) end as nhc,
  {_pick('Ana,Luis,Carmen,Pedro', 'o_custkey')} as nombre, lpad(cast(o_custkey % 100000000 as string), 8, '0') || 'K' as dni,
  lpad(cast(o_custkey % 28 + 1 as string), 2, '0') || '/' || lpad(cast(o_custkey % 12 + 1 as string), 2, '0') || '/' || cast(1930 + o_custkey % 80 as string) as fecha_nacimiento,
  {_DAY.format('o_orderdate')} as fecha_visita, cast(round(o_totalprice) as bigint) as valor, case when o_orderkey % 3 = 0 then upper({_pick('H.U. Badajoz,La Paz,Clinica Sur,', '(o_orderkey - o_orderkey % 7)')}) else {_pick('H.U. Badajoz,La Paz,Clinica Sur,', '(o_orderkey - o_orderkey % 7)')} end as centro
from orders"""

_SYLLABLES = "ba,ce,di,fo,gu,ha,je,ki,lo,mu,na,pe,qui,ro,su,ta,ve,xi,yo,zu"


def _made(key: str) -> str:
    """A made-up name of four syllables, another for each key below 160,000."""
    parts = [_pick(_SYLLABLES, f"floor({key} / {20**i}e0)") for i in range(4)]
    return f"(upper(substr({parts[0]}, 1, 1)) || substr({parts[0]}, 2) || {' || '.join(parts[1:])})"


#: A dictionary that grows with the customers: one to three places for each.
GAZETTEER = f"""
select 'cities' as kind, {_made('c_custkey')} as entry from customer union all
select 'cities', 'Villa ' || {_made('c_custkey')} from customer where c_custkey % 3 = 0 union all
select 'cities', {_made('c_custkey')} || ' del Rey (' || substr('NSEO', cast(c_custkey % 4 as int) + 1, 1) || ')' from customer where c_custkey % 5 = 0"""

#: A note for each customer that names places which are in the dictionary, within others, or not in it.
GAZETTEER_NOTES = f"""
select c_custkey as note_id, 'Vive en ' || {_made('c_custkey + 1')} || ', antes en Villa ' || {_made('c_custkey')} || ' del Rey (' || substr('NSEO', cast(c_custkey % 4 as int) + 1, 1) || ') y ' || upper({_made('c_custkey')}) || ' DEL REY (n); no en ' ||
  {_made('c_custkey')} || 'x, ni 3' || {_made('c_custkey')} || ' o ' || {_made('c_custkey + 80000')} || '. ' || {_made('c_custkey + 3')} as text
from customer"""

#: The first two words of each benchmark item, as a dictionary.
OPENINGS = "select distinct 'districts' as kind, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) as entry from benchmark where text like '% % %'"

#: The visits as lines of a CSV file with hostile cells: doubled quotes, separators in quotes, quotes inside of cells, blanks
#: around, short rows, and rows with more cells than the header.
CSV_LINES = f"""
select fila, cast(fila as string) || ';"x;""' || nombre || '""' || '"' || case when fila % 3 = 0 then '' else
  ';  ' || substr(dni, 1, 3) || '"; ' || substr(dni, 4, 2) || '"' || substr(dni, 6) || ' ' || ';"' || centro || ';" ' || case when fila % 5 = 0 then ';beyond' else '' end end as line from ({VISITS}) as v"""
#: Their cells.
CSV_CELLS = f"""
select cast(fila as varchar) as fila, 'x;"' || nombre || '"' as "nom;bre", case when fila % 3 > 0 then substr(dni, 1, 3) || '; ' || substr(dni, 4) end as dni,
  case when fila % 3 > 0 then trim(centro || ';') end as centro, case when fila % 3 > 0 and fila % 5 = 0 then 1 else 0 end as beyond from ({VISITS}) as v"""

_HEADERS = "NHC,Nombre,Apellidos,nombre_completo,DNI,Fecha_Nacimiento,Fecha_Visita,PASI,Tratamiento,Centro,Medico,a,b,c,d,e,f,Teléfono,cp,mail"

#: A cell for each visit: a header, and a value that fits it or not.
CELLS = f"""
select {_pick(_HEADERS, 'fila')} as name, case cast(floor(fila / 20e0) as int) % 10 when 0 then lpad(trim(nhc), 7, '0') when 1 then dni when 2 then fecha_visita when 3 then centro when 4 then nombre when 5 then '' when 6 then null
  when 7 then nombre || ' con un texto de más de treinta caracteres' when 8 then nombre || cast(fila as string) || '@mail.es' else '6' || lpad(cast(fila % 100000000 as string), 8, '0') end as value from ({VISITS}) as v"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(CELLS)


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(CSV_LINES)


def gazetteer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The notes that name places, and the dictionary of these."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    keys.repartition(spark.sparkContext.defaultParallelism, "c_custkey").createOrReplaceTempView("customer")
    return spark.sql(GAZETTEER_NOTES), spark.sql(GAZETTEER)


def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").createOrReplaceTempView("benchmark")
    return spark.sql(OPENINGS)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A small file is one partition, but each note costs milliseconds: deal the keys out before notes are made of them.
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    keys.repartition(spark.sparkContext.defaultParallelism, "c_custkey").createOrReplaceTempView("customer")
    return spark.sql(NOTES)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(VISITS)
