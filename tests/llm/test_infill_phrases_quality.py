"""Infilling and phrases against plain Python, the quality classifier's parts and its accuracy, and odd rows in all three."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from nubla.llm import common, infill, phrases, quality

from .test_text_operators import empty, odd, table, words  # noqa: F401

MIXED = ["", "a", "é", "日本語", "naïve 😀 text\nwith\tall  kinds\r\n\nof breaks ", "<P> inside", "x<S", "👩‍👩‍👧", "<<M", "end<P", "one two\nthree", "\n", "  lead"]


# Infilling


def split_units(text, unit):
    if unit == "char":
        return list(text)
    found = {"word": r"(?s)[ \t\n\r]*[^ \t\n\r]*[ \t\n\r]*(?=[^ \t\n\r]|\Z)", "line": r"(?s)[\n\r]*[^\n\r]*[\n\r]*(?=[^\n\r]|\Z)"}[unit]
    parts, at = [], 0
    while at < len(text):  # units tile the text; one begins at the first character and after each break
        end = re.compile(r"[ \t\n\r](?=[^ \t\n\r])" if unit == "word" else r"[\n\r](?=[^\n\r])").search(text, at)
        end = end.end() if end else len(text)
        parts.append(text[at:end])
        at = end
    assert re.compile(found)
    return parts


def infilled(doc_id, text, seed=1, unit="char", plain_from=90, spm_below=20, sentinels=("<P>", "<S>", "<M>")):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = split_units(text, unit)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in sentinels) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    pre, suf, mid = sentinels
    return (n, "spm", a, b - a, suf + s + pre + p + mid + m) if h4 % 100 < spm_below else (n, "psm", a, b - a, pre + p + suf + s + mid + m)


@pytest.mark.parametrize("unit,seed,plain_from,spm_below", [("char", 1, 90, 20), ("word", 7, 100, 50), ("line", 3, 60, 0)])
def test_infill(spark, unit, seed, plain_from, spm_below):
    rng = random.Random(1)
    rows = [(i, rng.choice(MIXED) if i % 3 else words(rng, i % 50, "es") + rng.choice(MIXED), "en", "a") for i in range(400)]
    docs = table(spark, rows)
    done = infill.restore(infill.fill_in_middle(docs, seed, unit=unit, plain_from=plain_from, spm_below=spm_below))
    assert done.columns[: len(docs.columns)] == docs.columns and done.columns[-1] == "restored"
    assert done.columns[-6:-1] == ["n_", "form", "prefix", "middle", "output"]
    forms = collections.Counter()
    for r in done.collect():
        assert tuple(r[c] for c in done.columns[-6:-1]) == infilled(r["doc_id"], r["text"], seed, unit, plain_from, spm_below)
        assert r["restored"] == r["text"] and r["n"] == "x"
        forms[r["form"]] += 1
    assert forms["psm"] > 50 and (forms["spm"] > 20) == (spm_below > 0)


def test_infill_of_odd_rows(spark, odd, empty):  # noqa: F811
    done = infill.restore(infill.fill_in_middle(odd)).collect()
    assert len(done) == odd.count() and all((r["text"] or "") == r["restored"] for r in done)
    assert all((r["n_"], r["form"], r["prefix"], r["middle"], r["output"]) == infilled(r["doc_id"], r["text"]) for r in done)
    assert infill.restore(infill.fill_in_middle(empty)).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("aba", "c", "d"), ("<P", "P>", "<M>"), ("x<P>", "<P>", "<M>"), ("", "a", "b")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(odd, sentinels=bad)
    own = infill.restore(infill.fill_in_middle(odd, sentinels=("[pre]", "{suf}", "(mid)")), sentinels=("[pre]", "{suf}", "(mid)")).collect()
    assert all((r["text"] or "") == r["restored"] for r in own)


def test_infill_with_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "some text", "x", None)], "doc_id long, text string, `a.b` string, `q``r` string")
    done = infill.restore(infill.fill_in_middle(docs))
    assert done.columns[:4] == docs.columns and done.columns[-1] == "restored" and done.first()["restored"] == "some text"


def test_infill_kernel_on_slices():
    """A slice of an array, as Arrow batches hold them, with texts before and after it."""
    texts = pa.array(["before é", *MIXED, None, "after"])[1:-1]
    draws = np.column_stack([np.arange(len(texts)) * k for k in (7, 3, 1, 9)])
    done = infill.infill(texts, draws)
    assert infill.restored(done["output"], done["form"]).to_pylist() == [*MIXED, ""]
    assert done["n"].to_pylist() == [len(t) for t in [*MIXED, ""]]


# Phrases


def mined_by_hand(docs, least, first, cover):
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            found = re.findall(r"[^ \t]+", piece)
            sizes[lang or "und"] += len(found)
            for k in range(1, 5):
                for i in range(len(found) - k + 1):
                    counts[lang or "und"][tuple(found[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) for q in [p[i : i + k]] if 100 * a >= cover * f[q]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def texts_with_phrases(rng, n):
    stock = ["in the end of", "at the end of the day", "New York City", "señor don José", "a b c d e f", "the the the the the the", "x\x01y z", "x y z"]
    return [(" ".join(rng.choice(stock) if rng.random() < 0.4 else rng.choice("the of and to cat dog Ñu río".split()) + rng.choice(["", "", ",", ".", "\n", "\t"]) for _ in range(40)), rng.choice(["en", "en", "es", None])) for _ in range(n)]


@pytest.mark.parametrize("hot_rows,hot_share,bits", [(1_000_000, 2000, 1 << 28), (20, 2, 1 << 28), (1_000_000, 2000, 64), (3, 1, 64)])
def test_phrases(spark, monkeypatch, hot_rows, hot_share, bits):
    """Against brute force: with no hot prefix and with nearly all hot, with filters that hold all pairs and saturated ones."""
    monkeypatch.setattr(phrases, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(phrases, "HOT_SHARE", hot_share)
    monkeypatch.setattr(phrases.Filter.__init__, "__defaults__", (bits,))
    monkeypatch.setattr(phrases, "GROUP_ROWS", 8)
    texts = texts_with_phrases(random.Random(2), 120)
    docs = table(spark, [(i, t, lang, "a") for i, (t, lang) in enumerate(texts)]).repartition(3)
    got = sorted(map(tuple, phrases.collocations(docs, 5, 60, 80).collect()))
    assert got == mined_by_hand(texts, 5, 60, 80) and len(got) > 80


def test_written_tables_leave_nothing_shuffled(spark):
    """Else what is shuffled for one step lies on disk beside the next one's."""
    files = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n").split("\n"))
    before = files()
    counted = common.table(spark.range(5000).selectExpr("id % 100 as k").groupBy("k").count(), "counted")
    assert len(counted.collect()) == 100
    left = lambda: [f for f in files() - before if f.startswith("shuffle") and "data" in f]
    deadline = time.time() + 20
    while left() and time.time() < deadline:
        time.sleep(0.2)
    assert not left()


def test_phrases_of_odd_rows(spark, odd, empty):  # noqa: F811
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert sorted(map(tuple, phrases.collocations(odd, 2).collect())) == mined_by_hand(rows, 2, 2000, 80)
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None, None), (2, " ", "en", "a"), (3, "one", "en", "a")])).count() == 0


def test_scores_beyond_64_bits(spark):
    """The arithmetic of scores on counts whose products pass 64 bits."""
    got = spark.sql(f"select cast((cast(a as decimal(20, 0)) * {phrases.SCALE}) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long) as s from values (9000000000000000001L, 9000000000000000005L, 9000000000000000123L) as t(a, l, r)").first()[0]
    assert got == 2_000_000 * 9000000000000000001 // (9000000000000000005 + 9000000000000000123)


# Quality


def test_word_vectors(spark):
    """Sums of index vectors of what is around each word, over chunks of words and texts, against plain Python."""
    rng = random.Random(3)
    texts = [words(rng, n) for n in (0, 1, 2, 3, 40, 400)] + [None, "é  ñ\tx\n"]
    monkey = quality.WORDS
    quality.WORDS = 16
    try:
        sums, count = np.zeros((quality.BUCKETS, quality.SIZE)), np.zeros(quality.BUCKETS)
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
        (got,) = quality._sums([batch])
    finally:
        quality.WORDS = monkey
    for t in texts:
        hashed, _ = quality.word_hashes(pa.array([t or ""]))
        assert len(hashed) == len((t or "").split())
        own = quality.index_vectors(hashed)
        for i, b in enumerate(quality._buckets(hashed)):
            count[b] += 1
            sums[b] += sum((own[j] for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)) if j != i), np.zeros(quality.SIZE))
    at = got.column("bucket").to_numpy()
    assert (got.column("n").to_numpy() == count[at]).all() and count.sum() == got.column("n").to_numpy().sum()
    assert (np.column_stack([got.column(c).to_numpy() for c in quality.COLUMNS]) == sums[at]).all()


def test_pooling_does_not_depend_on_chunks():
    rng = np.random.default_rng(1)
    known = quality.Vectors(rng.standard_normal((quality.BUCKETS, quality.SIZE)).astype(np.float32), rng.random(quality.BUCKETS).astype(np.float32))
    texts = pa.array([words(random.Random(i), n) for i, n in enumerate((0, 1, 2, 5, 300))] + ["a a a a"])
    whole, monkey = quality.pooled(known, texts), quality.WORDS
    quality.WORDS = 7
    try:
        assert np.allclose(quality.pooled(known, texts), whole, atol=1e-9)
    finally:
        quality.WORDS = monkey
    assert (whole[0] == 0).all() and np.isfinite(whole).all()


def test_gradients_and_temperature():
    rng = np.random.default_rng(2)
    x, y, w = rng.standard_normal((20, 4)), (rng.random(20) < 0.5).astype(float), rng.random(20)
    net = quality.Network(x.mean(0), x.std(0), rng.standard_normal((4, 3)), rng.standard_normal(3), rng.standard_normal(3), np.array(0.3))
    loss = lambda: float((w * (np.logaddexp(0, net.logits(x)) - y * net.logits(x))).sum() / w.sum())
    grads = quality.gradients(net, x, y, w)
    for p, g in zip((net.w1, net.b1, net.w2, net.b2), grads, strict=True):
        for at in np.ndindex(p.shape):
            before = loss()
            p[at] += 1e-6
            assert abs((loss() - before) / 1e-6 - np.asarray(g)[at]) < 1e-4
            p[at] -= 1e-6
    z = rng.standard_normal(20_000) * 3
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z / 2.5))).astype(float)
    assert abs(quality.temperature(z, y, np.ones(20_000)) - 2.5) < 0.15


def test_quality(spark, odd, empty):  # noqa: F811
    """Held-out accuracy on texts whose words stand in different company; probabilities fit their frequencies."""
    rng = random.Random(4)

    def text(good):
        made = words(rng, rng.randint(20, 60)).split()
        return " ".join(made) if good else " ".join(w + rng.choice(["***", "###"]) for w in made)

    rows = [(i, text(i % 4 != 0), "en", "a") for i in range(700)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 700 and len(held) > 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= quality.THRESHOLD) for r in out)
    found = quality.score(odd, model).collect()
    assert len(found) == odd.count() and len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(empty, model).count() == 0
    for marks in ([], [(1, 1, 0), (None, 0, 0)]):
        few = quality.fit(odd, spark.createDataFrame(marks, labels.schema))
        assert few.network is None and all(0 < r["score"] < 1 for r in quality.score(odd, few).collect())
    assert quality.fit(empty, labels).network is None


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 15, ("en", "es")[i % 2]), "en", "a") for i in range(120)]
    docs, schema = table(spark, rows), "doc_id long, quality int, toxic int"
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    fits = [quality.fit(docs, spark.createDataFrame([(i, (i % 2) ^ (flip and i in held), 0) for i, *_ in rows], schema)) for flip in (False, True)]
    assert all((a == b).all() for a, b in zip(*((f.network.w1, f.network.w2) for f in fits), strict=True))
