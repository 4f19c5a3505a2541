"""Notes: worked examples, negative cases and invariants."""

import random
import time

import pytest
from pyspark.sql import functions as F

from nubla.operators.detect import find
from nubla.operators.dictionaries import load
from nubla.operators.resolve import resolve
from nubla.operators.rules import rules
from nubla.operators.substitute import _like, numbered, same_professional
from nubla.plans.pipeline import Config, pseudonymise, stats

NOTES = {
    1: "Acude por fiebre. La paciente Lucía Romero, con DNI 30970148B, es alérgica desde 2019. Vive en Toledo y la atendió el Hospital Severo Ochoa. Avisar al 654-321-987.",
    2: "Cirugía el 02/05/2024. Firma el Dr. Álvaro Núñez Prieto con la Dra. Irene Vega. Consiente la paciente María del Carmen López el 09/05/2024, Hospital General de Segovia, NHC: 2024/089756. Móvil: 612-345-678.",
    3: "Profesión: Bibliotecaria de instituto. Escribir a carmen.rodriguez@email.com. Alta el 03/02/2024, vuelve el 02/03/2024.",
    4: "Caso único con síndrome de Wolfram. Alcaldesa del municipio de Benasque. Hermana gemela de Julia Soler. DNI 25147896K, NHC: 2023-456789, fijo 978-123-456. Ingresa en Hospital Miguel Servet.",
    5: "Llega al Hospital La Fe desde el distrito de Nervión, Valencia. CIP: ABC1234567890, SIP: 123456789012.",
    6: "Dolor 8/10 y 2-3/10; 12/13/2024 no es fecha; 18 de marzo del 2024 y marzo de 2024 quedan. CP 99999 y 00999.",
    7: "Paciente Ana Barrera Cabello. En Ávila y Mataró.",
    8: "",
    9: None,
    10: "😀 DNI 12345678A y " + ", ".join(f"vecino de Pueblo{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(3)),
}


@pytest.fixture(scope="module")
def done(spark):
    notes = spark.createDataFrame(list(NOTES.items()), "id int, text string")
    return {strict: {r["id"]: r for r in pseudonymise(notes, Config(strict=strict)).withColumns(stats(F.col("entities"))).collect()} for strict in (False, True)}


def labels(row):
    return [(e["text"], e["transformed"]) for e in row["entities"]]


def test_minimum_counts(done):
    r = done[False]
    assert r[1]["nombres"] >= 1 and r[1]["identificadores"] >= 2 and r[1]["ubicaciones"] >= 2 and r[1]["fechas"] >= 1
    assert r[2]["nombres"] >= 3 and r[2]["fechas"] >= 2 and r[2]["ubicaciones"] >= 1
    assert r[3]["sospechosos"] >= 1 and r[4]["sospechosos"] >= 3


def test_nothing_leaks(done):
    for i, words in {1: ["30970148B", "654-321-987", "2019"], 2: ["María del Carmen López", "2024/089756"], 3: ["carmen.rodriguez@email.com"], 4: ["síndrome de Wolfram", "25147896K", "2023-456789", "978-123-456"], 5: ["ABC1234567890", "123456789012"]}.items():
        assert not [w for w in words if w in done[False][i]["processed"]]


def test_strict(done):
    text = " ".join(done[True][i]["processed"] for i in (4, 5))
    assert "[dato_sensible]" in text and "Zona Geografica" in text and "Centro Sanitario" in text


def test_labels(done):
    assert labels(done[False][2]) == [("02/05/2024", "Visita 1 (hace 2 años)"), ("Dr. Álvaro Núñez Prieto", "Profesional Sanitario 2"), ("Dra. Irene Vega", "Profesional Sanitario 1"), ("María del Carmen López", "Paciente Mujer"), ("09/05/2024", "Visita 2 (1 semana después de Visita 1)"), ("Hospital General de Segovia", "Centro A"), ("2024/089756", ""), ("612-345-678", "")]
    assert ("02/03/2024", "Visita 2 (4 semanas después de Visita 1)") in labels(done[False][3])
    assert labels(done[False][5]) == [("La Fe", "Centro A"), ("Nervión", "Ciudad B"), ("Valencia", "Ciudad A"), ("ABC1234567890", ""), ("123456789012", "")]


def test_confidence(done):
    found = {e["text"]: round(e["confidence"], 2) for e in done[False][2]["entities"]}
    assert found["Dr. Álvaro Núñez Prieto"] == 0.7 and found["Dra. Irene Vega"] == 0.85 and found["María del Carmen López"] == 1


def test_negative(done):
    assert labels(done[False][6]) == [("18 de marzo del 2024", "18 de marzo del 2024"), ("marzo de 2024", "marzo de 2024")]
    assert not any("Ávila" in t or "Mataró" in t for t, _ in labels(done[False][7]))
    assert "Ana Barrera Cabello" in done[False][7]["processed"]


def test_empty(done):
    assert done[False][8]["processed"] == done[False][9]["processed"] == "" and done[False][9]["total"] == 0


def test_offsets_are_code_points(done):
    for row in done[False].values():
        text, at = NOTES[row["id"]] or "", 0
        for e in row["entities"]:
            assert text[e["start"] : e["end"]] == e["text"] and e["start"] >= at
            at = e["end"]


def test_unicode_boundaries(spark):
    notes = spark.createDataFrame([(1, "Nació en Ávila y en Mataró.")], "id int, text string")
    assert [e["text"] for e in pseudonymise(notes, Config(boundary="unicode")).first()["entities"]] == ["Ávila", "Mataró"]


def test_many_spans(spark):
    """Time is near linear in a note's matches: 2,000 addresses, all of them replaced."""
    text = " ".join(f"a{i}@mail.es" for i in range(2_000))
    found = find("text", next(r for r in rules() if r.name == "email"))
    rows = spark.createDataFrame([(text,)], "text string").select(F.inline(F.expr(found)))
    assert rows.count() == 2_000 and rows.agg(F.max("end")).first()[0] == len(text)


def test_large_dictionaries(spark, tmp_path):
    """50,000 names from a file: all of them are known, in the rules and in scores."""
    names = ["X" + "".join("abcdefghij"[int(c)] for c in f"{i:05d}") for i in range(50_000)]
    (tmp_path / "names.txt").write_text("\n".join([*names, "", names[0]]), encoding="utf-8")
    words = load(spark, women=str(tmp_path / "names.txt"), cities=spark.createDataFrame([("Villaseca",), (" ",)], "c string"))
    assert words.sizes()["women"] == 50_000 and words.cities == ["Villaseca"]
    notes = spark.createDataFrame([(1, f"Consulta de {names[49_999]} García Pérez en Villaseca y Badajoz.")], "id int, text string")
    found = {e["text"]: e["type"] for e in pseudonymise(notes, Config(words=words)).first()["entities"]}
    assert found == {f"{names[49_999]} García Pérez": "NOMBRE", "Villaseca": "UBICACION", "Badajoz": "UBICACION"}


def test_rules_by_literal_spans(spark):
    """Spans stated by hand, apart from the patterns: what is found in short texts, and where."""
    cases = {"dni": ("a 12345678Z b", [(2, 11)]), "nie": ("X1234567L", [(0, 9)]), "nuss_slashed": ("28/12345678/40", [(0, 14)]), "email": ("😀 a.b@c.es", [(2, 10)]), "postal_code": ("CP 28001, 99999", [(0, 8)]), "date_numeric": ("el 31/12/2023 o 32/01/2024", [(3, 13)]), "date_partial": ("en mayo de 2021", [(3, 15)]), "year_context": ("desde 2019", [(6, 10)]), "phone": ("tel 612 345 678", [(4, 15)]), "hospital_dict": ("ingresado en La Paz", [(13, 19)]), "relative_age": ("(Ana Ruiz, 30 años)", [(0, 19)]), "singularidad": ("es un caso único", [(6, 16)])}
    for name, (text, spans) in cases.items():
        rule = next(r for r in rules() if r.name == name)
        rows = spark.createDataFrame([(text,)], "text string").select(F.inline(F.expr(find("text", rule)))).collect()
        assert [(r["start"], r["end"]) for r in rows] == spans, name


def test_whole_long_note(spark):
    text = "dolor leve. " * 84_000 + "DNI 12345678Z."
    done = pseudonymise(spark.createDataFrame([(1, text)], "note_id long, text string")).select("processed").first()["processed"]
    assert len(text) > 1_000_000 and done.startswith("dolor leve. ") and len(done) > 1_000_000 and "DNI" in done[-40:] and "12345678Z" not in done


def long_note(lines):
    syllables = "ba ce di fo gu ha je ki lo mu".split()
    made = lambda i: "".join(syllables[int(d)] for d in f"{i:04d}").capitalize()
    people, names = "Ana Luis Carmen Pedro".split(), "García López Sánchez Ruiz Gómez".split()
    return "\n".join(f"Paciente {people[i % 4]} {names[i % 5]}, DNI {10000000 + i}A, acude el {i % 28 + 1:02d}/{i % 12 + 1:02d}/{1950 + i % 70} con Dr. {made(i)} {names[i % 3]}. Vive en Sevilla, Hospital {made(i * 7 % 9999)}." for i in range(lines))


def test_long_notes_take_linear_time(spark):
    """Nearly 8,000 entities, of them 1,300 professionals, hospitals and dates each: seconds beyond planning, and the labels of a
    note's end, from which numbers run, are those of its last lines by themselves."""
    took, rows = {}, {}
    for lines in (20, 1300):
        df = spark.createDataFrame([(1, long_note(1300).split("\n", 1300 - lines)[-1])], "id int, text string")
        query = pseudonymise(df).select("processed", "entities")
        query._jdf.queryExecution().executedPlan()
        start = time.time()
        rows[lines] = query.first()
        took[lines] = time.time() - start
    assert len(rows[20]["entities"]) == 120 and len(rows[1300]["entities"]) == 7800
    assert took[1300] - took[20] < 8, took  # 5 s on a free machine
    last = [[(e["text"], e["transformed"]) for e in rows[n]["entities"][-120:] if e["subtype"] in ("profesional", "paciente")] for n in rows]
    assert last[0] == last[1] and "Profesional Sanitario 1" in dict(map(reversed, last[0]))


def packed_by_hand(spans):
    rank = lambda s: (-(3 if s[2] == "UBICACION" else 2 if s[2] == "IDENTIFICADOR" or s[3] == "familiar" else 1 if s[2] == "SOSPECHOSO" or s[3] == "profesional" else 0), -s[4], s[0] - s[1], s[5], s[0])
    kept = []
    for s in sorted((s for s in spans if 0 <= s[0] < s[1]), key=rank):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(k[:2] for k in kept)


def test_packing_by_hand(spark):
    """Chains of overlaps, nested, equal and touching spans, across more blocks than one."""
    rng = random.Random(4)
    kinds = [("UBICACION", "ciudad"), ("IDENTIFICADOR", "dni"), ("NOMBRE", "familiar"), ("NOMBRE", "paciente"), ("NOMBRE", "profesional"), ("FECHA", "ano"), ("SOSPECHOSO", "x")]
    notes = []
    for n, width in ((0, 9), (1, 9), (30, 40), (400, 900), (400, 3000), (1000, 20_000)):
        starts = [rng.randint(-1, width) for _ in range(n)]
        notes.append([(a, a + rng.randint(0, 12), *rng.choice(kinds), rng.choice([0.5, 0.9]), i % 9) for i, a in enumerate(starts)])
    schema = "id int, candidates array<struct<start:int,end:int,type:string,subtype:string,confidence:double,rule:int>>"
    got = spark.createDataFrame(list(enumerate(notes)), schema).select("id", resolve("candidates").alias("r")).collect()
    for r in got:
        assert [(s["start"], s["end"]) for s in r["r"]] == packed_by_hand(notes[r["id"]])


def test_numbers_of_professionals_and_centres(spark):
    keys = ["juan perez gil", "gil", "ana gil", "perez", "j perez gil", "ez", "ana", "mariana", "rosa ruiz", "ruiz rosa", "rosa ruiz", "x gil perez"]

    def by_hand(same):
        known, out = [], {}
        for k in keys:
            near = [n for o, n in known if o == k] or [n for o, n in known if same(k, o)] or [max((n for _, n in known), default=0) + 1]
            known.append((k, near[0]))
            out.setdefault(k, near[0])
        return out

    def same(a, b):
        short, long = sorted((a.split(), b.split()), key=len) if len(a.split()) != len(b.split()) else (a.split(), b.split())
        rest = lambda t: t[1:] or t
        common = [w for w in rest(long) if w in rest(short)]
        return a == b or " ".join(long).endswith(" ".join(short)) or (len(short) == 1 and short[0] in long) or (len(common) == len(rest(short)) and bool(common))

    row = spark.createDataFrame([(keys,), ([],)], "k array<string>")
    for rule, own in ((same_professional, same), (_like, lambda a, b: a in b or b in a)):
        got = [(r[0]["keys"], r[0]["numbers"]) for r in row.select(numbered(F.col("k"), rule)).collect()]
        assert dict(zip(*got[0], strict=True)) == by_hand(own) and got[1] == ([], [])
