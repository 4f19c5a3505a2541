"""Dictionaries in tables: against the same lists in the plan, against plain Python, and at a size no plan could hold."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from nubla.operators.detect import detect
from nubla.operators.dictionaries import Dictionaries, as_table, of_table, read
from nubla.operators.lookup import hits, split_hits
from nubla.plans.pipeline import Config, pseudonymise
from nubla.plans.queries import QUERIES
from nubla.plans.relations import notes


@pytest.mark.parametrize("boundary,strict", [("ascii", False), ("unicode", True)])
def test_tables_give_what_lists_give(spark, small, boundary, strict):
    found = notes(spark, small)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "…"), (-4, "Dr. garcía"), (-5, "Ana"), (-5, "Ana")], found.schema)
    result = []
    for words in (Dictionaries(), of_table(as_table(spark))):
        done = pseudonymise(found.unionByName(odd), Config(boundary=boundary, strict=strict, words=words))
        assert "_known" not in done.columns
        result.append(sorted(map(str, done.select("note_id", "processed", "entities", "discarded").collect())))
    assert result[0] == result[1] and len(result[0]) == found.count() + 6


def hits_by_hand(text, entries, boundary):
    word = r"[A-Za-z0-9_]" if boundary == "ascii" else r"\w"
    edge = f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
    out = set()
    for kind, entry in entries:
        exact = kind in ("women", "men", "unisex")
        pattern = re.compile(edge + re.escape(entry) + ("" if exact else edge), 0 if exact else re.IGNORECASE)
        at = 0
        while m := pattern.search(text, at):
            inside = m.end() < len(text) and text[m.end()].isalnum() and entry[-1].isalnum()
            inside |= m.start() > 0 and text[m.start() - 1].isalnum() and entry[0].isalnum()
            if not inside:  # whole words, whatever the edges
                out.add((m.start(), m.end(), kind))
            at = m.start() + 1
    return out


@pytest.mark.parametrize("boundary", ["ascii", "unicode"])
def test_hits_by_hand(spark, boundary):
    """Entries within others, with marks in them and at their ends, with accents, and texts of these and what is like them."""
    rng = random.Random(3)
    entries = [("cities", "Villa"), ("cities", "Villa Alta"), ("cities", "Alta del Mar"), ("districts", "San-Blas"), ("districts", "a'b"), ("hospitals", "H.U. Sol"), ("hospitals", "Sol (Norte)"), ("women", "Ana"), ("women", "Ana María"), ("men", "José"), ("cities", "Ávila"), ("districts", "¡Ole!"), ("hospitals", "3 de Mayo")]
    stock = [e for _, e in entries] + ["villa", "VILLA ALTA", "x", "Ana", "ana", "María", "del", "mar", ",", ".", "(", "_", "Villas", "San Blas", "san-blas", "José_", "ávila", "Sol (norte)", "H.U.  Sol"]
    texts = ["".join(rng.choice(stock) + rng.choice([" ", " ", "", "\n", ", "]) for _ in range(25)) for _ in range(150)]
    table = spark.createDataFrame([*entries, *entries, ("women", " "), ("men", None), ("other", "Villa"), ("cities", "--")], "kind string, entry string")
    got = {(i, *t) for i, *t in map(tuple, hits(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), table, "id", boundary=boundary).filter("start >= 0 and kind <> 'unaccented'").select("id", "start", "end", "kind").collect())}
    assert got == {(i, *h) for i, t in enumerate(texts) for h in hits_by_hand(t, entries, boundary)} and len(got) > 500


def test_plans_do_not_grow_with_entries(spark, tmp_path):
    """A hundred thousand places and names from files: the plan is that of ten, and all that are named are found."""
    made = lambda i: "".join("ba ce di fo gu ha je ki lo mu".split()[int(d)] for d in f"{i:05d}").capitalize()
    sizes = []
    for n in (10, 100_000):
        for kind, extra in (("cities", ""), ("women", "a"), ("surnames", "ez")):
            (tmp_path / f"{kind}{n}.txt").write_text("\n".join(made(i) + extra for i in range(n)))
        words = of_table(read(spark, **{k: str(tmp_path / f"{k}{n}.txt") for k in ("cities", "women", "surnames")}))
        rows = [(i, f"Paciente {made(i)}a {made(i + 1)}ez, de {made(i)} y {made(i)}x.") for i in range(0, n, n // 10)]
        done = pseudonymise(spark.createDataFrame(rows, "id int, text string"), Config(words=words))
        sizes.append(len(done._jdf.queryExecution().optimizedPlan().toString()))
        found = {r["id"]: {(e["subtype"], e["text"]) for e in r["entities"]} for r in done.collect()}
        assert all({("paciente", f"{made(i)}a {made(i + 1)}ez"), ("ciudad", made(i))} <= found[i] and ("ciudad", f"{made(i)}x") not in found[i] for i, _ in rows)
    assert abs(sizes[1] - sizes[0]) < 0.03 * sizes[0], sizes  # the kind of join differs


def test_a_third_of_all_notes_alike(spark):
    rows = [(i, "Vive en Sevilla.") for i in range(500)] + [(500 + i, f"Vive en Sevilla {i}.") for i in range(1000)]
    docs = spark.createDataFrame(rows, "id int, text string").repartition(8)
    found = detect(docs, of_table(as_table(spark)), only={"city_dict"})
    assert found.count() == 1500 and found.filter(F.size("candidates") == 1).count() == 1500


def test_hits_by_splitting(spark, tmp_path):
    """The registered query against its SQL: entries that overlap themselves, edges beside accented letters, marks and blanks
    at their ends, letters whose lower case is longer or depends on their place, and notes of one key."""
    rng = random.Random(5)
    openings = ["the the", "of the, a b: of the, a b; of the, a b. x y", "a a", "de í", "et une", "a\\E b", "la. é", "x. y", "é ñ", "ΣΑΣ İ", "_ b", "of, ", " ", "as a", "😀 x"]
    stock = [*openings, "the", "THE", "bathe", "a", "b", "de ímpetu", "prêt une", "une", "é", "İ", "σας i", "a éa ñ", "é ñb", "as", "asa", "_", "of", "x", "y", "\n"]
    texts = [None, "", "é ñ", "aé ñ", "the the the", "bathe the the the", "İİ the the", "a a a a a", "ΣΑΣ İ"]
    texts += ["".join(rng.choice(stock) + rng.choice([" ", " ", "", ", "]) for _ in range(30)) for _ in range(200)]
    spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(f"{o} more words",) for o in openings], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    query, sql = QUERIES["dictionary_hits"]
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, query(spark, str(tmp_path)).select("doc_id", "span_start", "span_end", "words").collect()))
    assert got == sorted(con.execute(f"select doc_id, span_start, span_end, words from ({sql})").fetchall()) and len(got) > 500
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = split_hits(docs, spark.createDataFrame([(o,) for o in openings] + [(None,), ("",)], "entry string"), "id").collect()
    assert openings[1] in {r["entry"] for r in found} and all(r["match"] == texts[r["id"]][r["start"] : r["end"]] for r in found)
