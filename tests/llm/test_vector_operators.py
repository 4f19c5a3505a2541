"""Operators over vectors against brute force, and what they do with odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from nubla.llm import vector_dedup, vector_search
from nubla.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int, pivot string, rep string, n string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 32))
    x[500:560] = x[3] + rng.standard_normal((60, 32)) * 0.12
    x[600:640] = x[7]
    for i in range(700, 760):
        x[i] = x[i - 1] + rng.standard_normal(32) * 0.15
    return [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]


ODD = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] + [1.0] * 31), (2003, [float("inf")] + [1.0] * 31), (2004, [None] + [1.0] * 31), (2005, []), (None, [1.0] * 32), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]


def cosines(rows):
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


def test_dedup(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)  # pairs of blocks
    near = cosines(rows) >= vector_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    found = {r["vec_id"]: r for r in vector_dedup.deduplicate(table(spark, rows + ODD)).collect() if r["vec_id"] is not None}
    links = np.array([found[i]["n_links"] for i, _ in rows])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum()
    label = np.arange(len(rows))
    for _ in range(200):
        label = np.array([min(label[near[i]].min(initial=label[i]), label[i]) for i in range(len(rows))])
    assert sum(found[i]["component_id"] != label[i] for i, _ in rows) <= 3
    for i in range(2000, 2006):
        assert found[i]["n_links"] == 0 and found[i]["kept"]
    assert found[2007]["component_id"] == 2006 and found[2006]["n_links"] == 1


def test_dedup_repeats_and_empty(spark, rows):
    out = vector_dedup.deduplicate(table(spark, [rows[0]] * 3 + rows[1:20])).filter("vec_id = 0").collect()
    assert [(r["n_links"], r["kept"]) for r in out] == [(2, True)] * 3
    assert vector_dedup.deduplicate(table(spark, [])).count() == 0


def test_dedup_of_a_large_group(spark):
    """A third of the rows are near copies of each other, not all of them links."""
    rng = np.random.default_rng(5)
    x, size = rng.standard_normal((30_000, 64)), 10_000
    x[:size] = x[0] / np.linalg.norm(x[0]) + rng.standard_normal((size, 64)) * 0.0285
    x = x.astype(np.float32)
    rows = pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})
    found = vector_dedup.deduplicate(spark.createDataFrame(rows)).toPandas().sort_values("vec_id")
    unit = x[:size].astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = np.concatenate([(unit[i : i + 1000] @ unit.T >= vector_dedup.THRESHOLD).sum(1) - 1 for i in range(0, size, 1000)])
    links = found["n_links"].to_numpy()
    assert (links[:size] <= near).all() and links[:size].sum() >= 0.97 * near.sum() and links[size:].sum() == 0
    assert (found["component_id"][:size][near > 0] == 0).mean() > 0.99


def test_dedup_with_many_reference_points(spark, monkeypatch):
    """Pairs just above the threshold among vectors without clusters, with 4,096 reference points."""
    monkeypatch.setattr(vector_dedup, "ROWS_PER_PIVOT", 2)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((8_200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(600):
        step = rng.standard_normal(64)
        step -= step @ x[i] * x[i]
        x[4_000 + i] = x[i] * 0.953 + step / np.linalg.norm(step) * np.sqrt(1 - 0.953**2)
    rows = pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))})
    found = vector_dedup.deduplicate(spark.createDataFrame(rows)).toPandas()
    near = [(x[i : i + 1000] @ x.T >= vector_dedup.THRESHOLD).sum() - min(1000, len(x) - i) for i in range(0, len(x), 1000)]
    assert 0.9 * sum(near) <= found["n_links"].sum() <= sum(near) and sum(near) >= 1200


def by_hand(rows, asked, k=5):
    c, ids = cosines(rows), [i for i, _ in rows]
    out = {}
    for q in asked:
        order = sorted((i for i in ids if i != q), key=lambda i: (-round(c[q, i], 12), i))
        out[q] = order[:k]
    return out


def test_search_is_exact(spark, rows):
    every = table(spark, rows + ODD)
    got = vector_search.nearest(every, every.filter("vec_id % 50 = 0"), shard_rows=250).orderBy("query_id", "rank").collect()
    expected = by_hand(rows, range(0, 900, 50))
    c = cosines(rows)
    for q, names in expected.items():
        own = [r for r in got if r["query_id"] == q]
        assert [r["vec_id"] for r in own] == names and [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - c[q, r["vec_id"]]) < 1e-12 for r in own)
    assert not [r for r in got if r["query_id"] in (2000, 2001, 2002, 2003, 2004, 2005)]


def test_relaxed_search(rows):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    tree = vector_search.Tree(ids, x, leaf=16)
    exact, relaxed = tree.search(ids[::50], x[::50], 5)[1], tree.search(ids[::50], x[::50], 5, factor=0.6)[1]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact, relaxed, strict=True)]) > 0.5


def test_search_in_blocks(spark, rows, monkeypatch):
    """Blocks of queries and shards of candidates, and repeated ids, of which the smallest vector counts."""
    monkeypatch.setattr(vector_search, "CHUNK", 20)
    every = table(spark, [*rows, (1, [9.0] * 32), (51, [9.0] * 32)])
    got = vector_search.nearest(every, every.filter("vec_id % 10 = 1"), shard_rows=200).orderBy("query_id", "rank").collect()
    once = [(i, min(v, [9.0] * 32) if i in (1, 51) else v) for i, v in rows]
    expected = by_hand(once, range(1, 900, 10))
    assert {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in expected} == expected


def test_search_few_and_empty(spark, rows):
    few = table(spark, rows[:3] + rows[:1])
    assert [(r["rank"], r["query_id"]) for r in vector_search.nearest(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 0), (2, 0)]
    none = table(spark, [])
    assert vector_search.nearest(none, none).count() == 0 and vector_search.nearest(few, none).count() == 0


def test_extreme_components(spark):
    """Vectors of doubles whose squares are beyond what doubles hold link and are found as the same directions in middle sizes."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 8))
    base[20:] = base[:20] + rng.standard_normal((20, 8)) * 0.01
    scale = np.array([1e200, 1e-200, 1.0, 1e-310, 1e300])[np.arange(40) % 5][:, None]
    made = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>") for m in (base, base * scale)]
    for run in (lambda df: vector_dedup.deduplicate(df), lambda df: vector_search.nearest(df, df.filter("vec_id % 5 < 3"), 3)):
        a, b = (sorted(map(tuple, run(df).collect())) for df in made)
        assert len(a) == len(b) and all(np.allclose(np.array(x, float), np.array(y, float), atol=1e-4) for x, y in zip(a, b, strict=True))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (100, 102), (7, 7)] + [(200, 200 + i) for i in range(1, 50)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 250)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components_in_rounds_and_in_one_task(spark, few):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in rng.permutation(300).tolist() if i % 60 != 59] + [(1000, int(i)) for i in rng.integers(1001, 1100, 150)] + [(5, 5)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), few).collect()}
    assert found == {i: i // 60 * 60 for i in range(300)} | {1000: 1000} | {b: 1000 for a, b in links if a == 1000}


def test_few_links_take_few_jobs(spark):
    """Rounds of jobs over few rows took the driver's memory."""
    spark.sparkContext.setJobGroup("few-links", "")
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert components(links).count() == 301
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 12
