"""The pipeline: each stage on its predecessor's rows, planted cases, and the result against what goes in."""

import random

import pytest

import corpus_pipeline
from nubla.llm import packing, queries

from .test_text_operators import by_hand, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    rows = [(i, "\n".join(words(rng, 40) for _ in range(3)), "en", f"s{i % 3 and 1}") for i in range(200)]
    passage = "\n".join(words(rng, 30) for _ in range(6))
    rows[50] = (50, rows[10][1], "en", "s0")
    rows[51] = (51, " ".join(w if k % 90 else "zz" for k, w in enumerate(rows[11][1].replace("\n", " \n ").split(" "))).replace(" \n ", "\n"), "en", "s1")
    rows[60] = (60, rows[60][1] + "\n" + passage, "en", "s1")
    rows[61] = (61, rows[61][1] + "\n" + passage, "en", "s1")
    rows = [(i, t + (" you moron, worthless scum" if i % 10 == 9 else ""), lang, s) for i, t, lang, s in rows]
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 9)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, lines, near, mixed = seen
    assert set(toxic) == {i for i in range(200) if i % 10 != 9}
    assert lines[10] == toxic[10] and lines[50] == "" and lines[61] == toxic[61].rsplit("\n", 6)[0] and lines[60] == toxic[60]
    expected = by_hand(sorted(lines.items()))
    assert set(near) == {i for i in lines if expected[i] == i} and 51 not in near
    assert set(mixed) == set(near)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    ids = packing.encoder(packing.default_vocabulary())
    assert sum(p["length"] for p in pieces) == sum(len(ids(r["text"] or "")) + 1 for r in docs.collect())


def test_odd_rows(spark, folder):
    """Nulls in any column, empty and very long texts, repeated rows, and empty tables, through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " " * 300_000 + "end"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", None, "a", 10), (None, None, None, None, None), (3, "same text", "en", "b", 9), (3, "same text", "en", "b", 9), (4, long, "en", "a", len(long))]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, folder).cache()
            if name in ("toxicity", "line_dedup"):
                assert sorted(str(tuple(r)) for r in docs.collect()) == sorted(map(str, data))
            if name == "near_dedup":  # a null text is an empty one
                assert sorted(map(str, (r["doc_id"] for r in docs.collect()))) == sorted(map(str, [1, None, None, 3, 4] if data else []))
            if name == "mixing":
                assert docs.columns == before.columns and {str(r) for r in docs.collect()} == {str(r) for r in before.collect()}
        assert docs.groupBy("doc_id").count().count() == (4 if data else 0)


def test_columns_of_any_name(spark, folder):
    """Columns with dots, quotes and the operators' own names pass through every stage but the last, with very long texts."""
    names = ["a.b", "q`r", "_id", "_gone", "n", "key", "rep", "_mix", "Text 2", "form"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    rng = random.Random(14)
    texts = [words(rng, 30) for _ in range(6)] + ["\n".join(words(rng, 12) for _ in range(4000))] * 2
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns[5:] == names and docs.count() >= 6, name
        assert all(r[5 + j] == f"{n}{r['doc_id']}" for r in docs.collect() for j, n in enumerate(names)), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_run(spark, folder):
    """The whole run is what the stages give one after another, and its pieces hold every token of the mixture once."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
    ids = packing.encoder(packing.default_vocabulary())
    expected = {}
    for r in docs.collect():
        expected[r["doc_id"]] = expected.get(r["doc_id"], 0) + len(ids(r["text"] or "")) + 1
    pieces = corpus_pipeline.run(spark, folder).collect()
    got = {}
    for p in pieces:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == expected
    full = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == full.get(p["sequence_id"], 0)
        full[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n == packing.SEQ_LEN for s, n in full.items() if s < max(full))


def test_names():
    found = [*queries.queries(), *queries.oracle_sql()]
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)} and all(n in queries.queries() for n in found)
