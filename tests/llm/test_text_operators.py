"""Operators over texts: results against brute force, and nulls, ties, repeats, extra columns and empty tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubla.llm import language_id, licenses, line_dedup, minhash_dedup, mixing, packing, secrets, toxicity

CLASHING = ["start", "length", "queue", "key", "rep", "n", "lines", "band", "block", "h", "s", "tokens", "place", "epoch", "weight", "row", "_n", "_id", "_key", "_gone", "_lines", "_removed", "_named", "_source", "_tokens", "_place", "_block", "_epoch", "_weight", "_mix", "_nth", "_before"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
EXTRA = ("x",) * len(CLASHING)


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with columns whose names the operators use, too."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], SCHEMA)


def words(rng, n, of="en"):
    parts = {"en": ["the", "th", "er", "ing", "and", "ly"], "es": ["ción", "los", "que", "ñ", "ado", "ía"]}[of]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows."""
    long = words(random.Random(5), 30_000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "no id", "en", "a"), (3, "!!! 123", "en", None), (4, "same text here", "es", "b"), (4, "same text here", "es", "b"), (5, long, "en", "a"), (6, "same text here", "es", "b")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# Packing


def check_pieces(pieces, docs):
    encode = packing.encoder(packing.default_vocabulary())
    by = collections.defaultdict(list)
    for p in pieces:
        by[p["doc_id"], p["doc_tokens"]].append(p)
    for doc_id, text in docs:
        ids = np.append(encode(text or ""), 1).astype("<u4")
        own = sorted(by[doc_id, len(ids)], key=lambda p: p["start"])
        assert sum(p["length"] for p in own) % len(ids) == 0 and own
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    at = collections.defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at[p["sequence_id"]] and p["length"] > 0
        at[p["sequence_id"]] += p["length"]
    assert max(at.values()) <= packing.SEQ_LEN and sum(n < packing.SEQ_LEN for n in at.values()) <= 1


def test_encoder_gives_the_library_s_ids():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    library, own = Tokenizer.from_file(path), packing.encoder(path)
    for text in ["", "Hello  wörld\n\n 12345 é😀", "a<|endoftext|>b", words(random.Random(0), 300), words(random.Random(0), 300, "es"), " \t x" * 50]:
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_on_very_long_runs():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    library, own = Tokenizer.from_file(path), packing.encoder(path)
    for text in [" " * 1_000_000, "a" * 1_000_000, "\n\t" * 50_000 + "x", "a b" + "\u3000" * 100_000, "é\u0301\u200d中١½😀\x85\x1c" * 2_000, "don't stop'll " + "." * 9_000]:
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_unbroken_runs():
    """Only runs send a text to the slower reader, not many short blanks; a run may lie anywhere."""
    n = packing.RUN
    assert not packing._unbroken("a  " * n) and not packing._unbroken("ab \n" * n) and not packing._unbroken("x" * (n - 1))
    for run in ("x" * n, " \n" * (n // 2)):
        assert all(packing._unbroken("a b " * k + run + " c d" * k) for k in range(0, 3 * n, 701))


def test_packing_of_very_long_texts(spark):
    rows = [(1, " " * 1_000_000), (2, "x" * 300_000), (3, "one two"), (4, "word " * 200_000)]
    check_pieces(packing.pack(table(spark, [(i, t, "en", "a") for i, t in rows])).collect(), rows)


def test_packing_of_many_sources(spark):
    """Each of 5,000 sources is a queue of its own."""
    pieces = packing.pack(table(spark, [(i, f"text {i} " + "again " * (i % 7 * 10), "en", f"s{i % 5000}") for i in range(8_000)])).toPandas()
    check_pieces(pieces.to_dict("records"), [(i, f"text {i} " + "again " * (i % 7 * 10)) for i in range(8_000)])
    weights = pieces.groupby("source")["length"].sum()
    got = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0)
    due = np.outer(np.arange(1, len(got)) * packing.SEQ_LEN, weights[got.columns] / weights.sum())
    assert abs(got.cumsum().to_numpy()[:-1] - due).max() <= 2


def test_packing(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_pieces(packing.pack(odd).collect(), rows)
    assert packing.pack(empty).count() == 0
    assert packing.pack(odd, with_ids=True).filter("length(ids) <> 4 * length").count() == 0


def test_packing_mixture(spark):
    rng = random.Random(1)
    docs = table(spark, [(i, words(rng, rng.randint(20, 400)), "en", "a" if i % 3 else "b") for i in range(300)])
    pieces = packing.pack(docs).toPandas()
    shares = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0)[:-1]
    assert (shares.max() - shares.min()).max() <= 1
    half = packing.pack(docs, targets={"a": 0.5, "b": 0.5}).toPandas().pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0)
    both = half[(half["a"] > 0) & (half["b"] > 0)][:-1]
    assert ((both["a"] - 1024).abs() <= 1).all()


def test_served_adds_up():
    totals, weights = np.array([5000, 70, 1]), np.array([0.9, 0.09, 0.01])
    got = packing.served(totals, weights, np.arange(5), 1024)
    assert got.sum(1).tolist() == [0, 1024, 2048, 3072, 4096] and (np.diff(got, axis=0) >= 0).all()


# Licences


def test_licenses(spark, odd, empty):
    known = licenses.known(spark)
    shouting = "Copyright (c) 2020 Someone\n\n" + licenses.MIT.upper().replace(",", " ;").replace("\n\n", "\n \n")
    docs = table(spark, [(1, shouting, "en", "a"), (2, "Hi.\nReleased under the MIT License.\nLICENSED UNDER CC BY-NC 4.0", "en", "a"), (3, licenses.MIT + " more", "en", "a"), (2, "Hi.\nReleased under the MIT License.\nLICENSED UNDER CC BY-NC 4.0", "en", "a")])
    assert sorted(tuple(r) for r in licenses.scan(docs, known).collect()) == [(1, 0, "MIT"), (2, 2, "MIT"), (2, 2, "MIT"), (2, 3, "CC-BY-NC-4.0"), (2, 3, "CC-BY-NC-4.0")]
    assert licenses.scan(odd, known).count() == licenses.scan(empty, known).count() == 0
    assert all(re.search(licenses.TRIGGER, t) for _, t in licenses.known_texts())
    own = licenses.known(spark, [("Own", "Do as you like.")])
    assert [tuple(r) for r in licenses.scan(table(spark, [(1, "x\n  DO as, you; like!", "en", "a")]), own).collect()] == [(1, 2, "Own")]


def test_full_licenses(spark):
    """Longer licences in capitals, indented and with other marks, and not with one word changed."""
    texts = {f.stem: f.read_text(encoding="utf-8") for f in licenses.TEXTS.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0"} <= set(texts)
    rows = [(i, "Copyright (C) 2031 Someone Else\n\n" + re.sub("(?m)^", " * ", t.upper().replace(",", " ;")), "en", "a") for i, t in enumerate(texts.values())]
    rows += [(100 + i, t.replace("license", "licence", 1).replace("the", "thee", 1), "en", "a") for i, t in enumerate(texts.values())]
    found = {r["doc_id"]: r["license"] for r in licenses.scan(table(spark, rows), licenses.known(spark)).filter("line = 0").collect()}
    assert found == dict(enumerate(texts))


def test_licenses_by_short_notices(spark):
    text = "Released under MIT.\nReleased under CC BY 4.0.\n// SPDX-License-Identifier: GPL-3.0-or-later\nDistributed under CC BY-SA 4.0.\nReleased under pressure."
    found = licenses.scan(table(spark, [(1, text, "en", "a"), (2, licenses.ZLIB, "en", "a"), (3, "# Copyright 2020 Someone\n" + licenses.APACHE_NOTICE, "en", "a")]), licenses.known(spark)).collect()
    assert sorted((r["doc_id"], r["line"], r["license"]) for r in found) == [(1, 1, "MIT"), (1, 2, "CC-BY-4.0"), (1, 3, "GPL-3"), (1, 4, "CC-BY-SA-4.0"), (2, 0, "Zlib"), (3, 0, "Apache-2.0")]


# Mixing


def mixed_by_hand(rows, repeats):
    """(doc_id, epochs) by source for one block a source, in plain Python."""
    size = lambda t: max(1, len(re.findall(r"[^ \t\n\r]+", t or "")))
    place = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:15], 16)
    by = collections.defaultdict(list)
    for i, t, _, s in rows:
        by[s or ""].append((place(i), i, size(t)))
    totals = {s: sum(n for *_, n in own) for s, own in by.items()}
    a = mixing.exponent(collections.Counter(totals.values()), repeats)
    out = {}
    for s, own in by.items():
        epochs, upto = (totals[s] / max(totals.values())) ** (a - 1), 0
        for _, i, n in sorted(own):
            upto += n
            out[i] = int(epochs) + (2 * upto - n <= 2 * (epochs - int(epochs)) * totals[s])
    return out


def test_mixing(spark, odd, empty):
    rng = random.Random(2)
    docs = table(spark, [(i, words(rng, 50), "en", "big" if i < 800 else f"s{i % 4}") for i in range(1000)])
    out = mixing.mix(docs, block_tokens=1000)
    assert out.columns[:-1] == docs.columns and out.columns[-1] == "_mix_" and out.filter("_mix <> 'x' or _tokens <> 'x' or block <> 'x'").isEmpty()
    out = out.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"), F.sum("_mix_.tokens").alias("t"), F.max("_mix_.weight").alias("w"), F.max("_mix_.epoch").alias("e")).collect()
    total = sum(r["t"] for r in out)
    for r in out:
        assert r["d"] == (800 if r["source"] == "big" else 50) and abs(r["t"] / total - r["w"]) < 0.01
        assert r["e"] == (1 if r["source"] == "big" else 2)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()


@pytest.mark.parametrize("broadcast", [48 << 20, 1])
def test_mixing_of_many_sources(spark, monkeypatch, broadcast):
    """5,000 sources, each with its own weight; also where their table is too large to be broadcast."""
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", broadcast)
    rows = [(i, "w " * (1 + i % 11), "en", f"s{i % 5000}" if i < 9000 else "hot") for i in range(12_000)]
    out = mixing.mix(table(spark, rows), repeats=3.0).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == mixed_by_hand(rows, 3.0)


def test_exponent():
    a = mixing.exponent({100: 1, 10: 1, 1: 1}, repeats=2)
    assert abs(100 ** (1 - a) - 2) < 1e-9
    a = mixing.exponent({100: 1, 10: 2, 1: 1}, repeats=None, entropy=0.9)
    w = np.array([v**a for v in (100, 10, 10, 1)])
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.9 * np.log(4)) < 1e-9
    assert mixing.exponent({5: 1}) == mixing.exponent({}) == 1.0


# Secrets

BASE = {"assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def base_spans(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in p.finditer(text) if (len(m.group(1)) >= 6 if k == "assign" else len(m.group()) >= {"access": 20, "hex": 24}[k])]
    return [(list(BASE)[k], a, b) for a, k, b in sorted(found)]


def test_secrets(spark, odd, empty):
    key = "".join(random.Random(3).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    texts = ["😀 password= secret: token: abcdef token='x.y=z_1' AKIA" + "A1" * 9 + " " + "0af" * 9, f"key {key} and aaaaaaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaaaaaa", "API_KEY = 'abc-def-123' passwd:short api key", "deadbeef" * 2]
    rows = {r["doc_id"]: [(secrets.KINDS[s["kind"]], s["start"], s["end"]) for s in r["found"]] for r in secrets.scan(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert [s for s in rows[i] if s[0] != "random"] == base_spans(t)
    assert [texts[1][a:b] for k, a, b in rows[1] if k == "random"] == [key]
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(empty).count() == 0


def test_secrets_without_digits(spark):
    keys = ["".join(random.Random(i).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=20)) for i in range(50)]
    texts = [f"key {k} end" for k in keys] + ["see xyzxyzxyzxyzxyzxyzxyzxyzxyz", "see AbAbAbAbAbAbAbAbAbAbAbAbAbAbAb"]
    found = {r["doc_id"]: [(secrets.KINDS[s["kind"]], s["start"], s["end"]) for s in r["found"]] for r in secrets.scan(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert sum(found[i] == [("random", 4, 24)] for i in range(50)) >= 40 and not found[50] and not found[51]


def test_secrets_of_many_matches(spark):
    """Time grows with the text, not with the square of its matches."""
    text = " ".join(f"token={i:08d}" for i in range(16_000))
    start = time.monotonic()
    found = secrets.scan(table(spark, [(1, text, "en", "a")])).first()["found"]
    assert time.monotonic() - start < 30 and len(found) == 16_000 and found[-1]["end"] == len(text)


def test_battery_by_hand(spark):
    """Every p-value against the same three tests and Fisher's method in plain Python."""
    rng = random.Random(12)
    strings = ["".join(rng.choices("0123456789abcdef", k=rng.randint(24, 80))) for _ in range(30)] + ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=30)) for _ in range(10)] + ["".join(rng.choices("abcXYZ019", k=40)) for _ in range(10)]
    upper = lambda z: 1 / (1 + math.exp(min(700.0, 1.5976 * z + 0.07056 * z**3)))
    chi = lambda x, df: upper(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)

    def p_value(text, encoding):
        alphabet, n = secrets.ALPHABETS[encoding], len(text)
        x = [alphabet.index(c) for c in text]
        cells = collections.Counter(v * secrets.CELLS // len(alphabet) for v in x)
        uniform = sum((cells[k] - n / secrets.CELLS) ** 2 / (n / secrets.CELLS) for k in range(secrets.CELLS))
        high = [v * 2 >= len(alphabet) for v in x]
        ones, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        expected = 1 + 2 * ones * (n - ones) / n
        spread = max((expected - 1) * (expected - 2) / (n - 1), 1e-9) ** 0.5
        mean = sum(x) / n
        serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / max(sum((v - mean) ** 2 for v in x), 1e-9) * n**0.5
        ps = [chi(uniform, secrets.CELLS - 1), 0.0 if expected < 2 else min(1, 2 * upper(abs((runs - expected) / spread))), min(1, 2 * upper(abs(serial)))]
        return chi(sum(-2 * math.log(max(p, 1e-12)) for p in ps), 6)

    for r in secrets.battery(spark.createDataFrame([(s,) for s in strings], "match string")).collect():
        assert abs(r["p"] - p_value(r["match"], r["encoding"])) < 1e-9


def test_battery_tells_random_strings(spark):
    rng = random.Random(4)
    strings = [("r", "".join(rng.choices("0123456789abcdef", k=40))) for _ in range(200)] + [("f", ("0123456789abcdef" * 3)[i % 16 :][:30]) for i in range(50)]
    left = secrets.not_rejected(secrets.battery(spark.createDataFrame(strings, "kind string, match string"))).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in left}["r"] >= 185 and "f" not in {r["kind"] for r in left}


# Line dedup


def chunks_by_hand(lines):
    """(first, last, whether the rolling hash ends it) of the chunks of lines, by their places from 0."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in lines]
    chunks, first = [], 0
    for i in range(len(lines)):
        rolled = 0
        for back in range(min(line_dedup.WINDOW, i + 1)):
            rolled ^= h[i - back] >> back
        if rolled % line_dedup.DIVISOR == 0 or i + 1 == len(lines):
            chunks.append((first, i, rolled % line_dedup.DIVISOR == 0))
            first = i + 1
    return chunks


def removed_by_hand(docs):
    """Lines that go, by the rule in plain Python: {(doc_id, text): numbers from 1}."""
    places, out = collections.defaultdict(list), collections.defaultdict(set)
    keys = sorted({(line_dedup.LAST if i is None else i, hashlib.md5(t.encode()).hexdigest(), i, t) for i, t in docs if t is not None}, key=lambda k: k[:2])
    own = []
    for *_, text in keys:
        lines = [(n, x) for n, x in enumerate(text.split("\n"), 1) if x.strip(" ")]
        size = [x.count(" ") + 1 for _, x in lines]
        pieces = {(a, b, True) for a, b, _ in chunks_by_hand([x for _, x in lines]) if b > a and sum(size[a : b + 1]) >= line_dedup.LEAST}
        pieces |= {(i, i, True) for i, n in enumerate(size) if n >= line_dedup.LONG} | {(i, i + 1, False) for i in range(len(lines) - 1)}
        own.append((lines, size, pieces))
        for a, b, _ in pieces:
            places["\n".join(x for _, x in lines[a : b + 1])].append((len(own), a))
    for k, (*_, doc, text) in enumerate(keys):
        lines, size, pieces = own[k]
        runs = []
        for a, b, sure in sorted(p for p in pieces if min(places["\n".join(x for _, x in lines[p[0] : p[1] + 1])]) < (k + 1, p[0])):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], b), runs[-1][2] or sure)
            else:
                runs.append((a, b, sure))
        for a, b, sure in runs:
            if sure or sum(size[a : b + 1]) >= line_dedup.RUN:
                out[doc, text] |= set(range(lines[a][0], lines[b][0] + 1))
    return out


def check_lines(spark, docs):
    """The result against the rule by hand; the texts that stay."""
    expected = removed_by_hand(docs)
    made = table(spark, [(i, t, "en", "a") for i, t in docs])
    done = line_dedup.remove_repeats(made)
    assert done.columns[:-2] == made.columns and done.filter("_removed <> 'x' or _lines <> 'x' or key <> 'x'").isEmpty()
    left = []
    for i, t in docs:
        gone = expected.get((i, t), ())
        left.append((i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in gone)))
    assert sorted(map(str, left)) == sorted(str((r["doc_id"], r["text"])) for r in done.collect())
    return left


def test_line_dedup(spark, odd, empty):
    rng = random.Random(6)
    passage = [words(rng, n) for n in (12, 3, 2, 12, 4, 12)]
    docs = [(i, "\n".join([words(rng, 5) for _ in range(rng.randint(0, 3))] + passage * (i % 2) + [""] * (i % 3) + [words(rng, 70 if i % 5 == 0 else 6)] + (passage[:3] if i == 8 else []) + ["la la"] * (i % 4))) for i in range(40)]
    left = check_lines(spark, docs + docs[:3])
    assert sum(t.count(passage[0]) for _, t in left) <= 3 and sum(t != d for (_, t), (_, d) in zip(left, docs, strict=False)) >= 19
    kept = line_dedup.remove_repeats(odd).collect()
    assert sorted((r["text"] is None, r["text"] or "") for r in kept) == sorted((r["text"] is None, r["text"] or "") for r in odd.collect())
    assert line_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("ids", [(5, 9, 9), (None, None, None), (5, None, None)])
def test_line_dedup_by_row(spark, ids):
    """Rows that share an id, or have none, are documents of their own: what is in one text only stays."""
    rng = random.Random(7)
    a, b = ("\n".join(words(rng, 6) for _ in range(40)) for _ in range(2))
    left = check_lines(spark, list(zip(ids, (a, a, b), strict=True)))
    assert any(t == b for _, t in left) and any(t == a for _, t in left)


def test_line_dedup_finds_passages(spark):
    """Of passages over 50 words that two documents share nothing stays, however they are divided into lines."""
    rng, docs, sizes = random.Random(8), [], [(1, 60), (2, 30), (3, 20), (4, 15), (6, 12), (10, 6), (20, 3)]
    for k, (n, size) in enumerate(sizes * 15):
        passage = [words(rng, size) for _ in range(n)]
        docs += [(2 * k + j, "\n".join([words(rng, 9), words(rng, 4), *passage, words(rng, 5), words(rng, 11)])) for j in (0, 1)]
    left = check_lines(spark, docs)
    for m, (n, size) in enumerate(sizes):
        own = [k for k in range(len(docs) // 2) if k % len(sizes) == m]
        gone = [1 - (left[2 * k + 1][1].count("\n") + 1 - 4) / n for k in own]
        assert np.mean(gone) > 0.99, (n, size, gone)


def test_line_dedup_ends_chunks_by_the_rolling_hash(spark):
    """Inside of texts every end is the rolling hash's, and what is inserted moves only ends beside it."""
    rng = random.Random(12)
    lines = [words(rng, rng.choice((2, 6, 40, 70))) for _ in range(400)]
    data = spark.createDataFrame([("\n".join(lines),), ("\n".join([*lines[:200], "here is more", *lines[200:]]),)], "text string")
    full = line_dedup._full(F.col("text"))
    ends = [set(r[0]) for r in data.select(line_dedup._let(F.transform(full, lambda s: line_dedup._line_hash(s["line"])), line_dedup._ends)).collect()]
    hashed = [b + 1 for _, b, rolled in chunks_by_hand(lines) if rolled]
    assert len(set(hashed) & ends[0]) >= 0.9 * len(ends[0]) and ends[0] == set(hashed) | {400}
    assert {e for e in ends[0] if e <= 200} == {e for e in ends[1] if e <= 200}
    assert {e + 1 for e in ends[0] if e > 201} == {e for e in ends[1] if e > 202}


def test_line_dedup_leaves_ordinary_lines(spark):
    """A pair of short lines that many documents have stays, beside others and by itself."""
    rng, pair = random.Random(13), ["All rights are reserved by us", "See the file for more details"]
    docs = [(i, "\n".join([words(rng, 9), *pair, words(rng, 8), *([words(rng, 3), *pair] if i % 3 == 0 else []), *pair[:1]])) for i in range(60)]
    assert check_lines(spark, docs) == docs


def test_line_dedup_of_very_long_texts(spark):
    rng = random.Random(9)
    lines = [words(rng, 4) for _ in range(30_000)]
    left = check_lines(spark, [(1, "\n".join(lines)), (2, "\n".join(["first here", *lines[5_000:]])), (3, "\n" * 20_000)])
    assert len(left[1][1]) < 200 and left[0][1] == "\n".join(lines)


# Toxicity and languages


def test_grammar_marks_clauses():
    read = toxicity.Model({w: c for c, t in toxicity.SEED.items() for w in t.split()}).reader()
    at = lambda t: [i for i in range(1, 9) if read(t)[i] > 0]
    assert at("a moron here") == [1] and at("you are a moron") == [2] and at("this is not a moron") == [3]
    assert at("moron, that is what you are") == [2] and at("a moron. you") == [1]
    assert at("he said moron") == [4] and at("I kill you") == [6] and at("not so. moron") == [1] and at("nothing") == []
    assert at('"moron" you moron') == [2, 4] and at("to kill time") == [5]


def test_clauses_outweigh_words():
    """Where labelled texts hold isolated insults only, a targeted one still weighs more; threats and reports are learned."""
    rng = random.Random(10)
    plain = [words(rng, 20) + " moron " + words(rng, 5) for _ in range(150)]
    model = toxicity.train(plain + [words(rng, 26) for _ in range(300)], [1] * 150 + [0] * 300)
    w, read = model.weights, model.reader()
    assert w[2] > w[1] >= w[3] >= 0 and w[1] >= w[4] >= 0 and w[6] > w[5] >= w[7] >= 0
    assert read("you moron") @ w > read("a moron") @ w > read("he said moron") @ w
    threats = [f"{words(rng, 8)} zorblat you {words(rng, 8)}" for _ in range(120)]
    reports = [f"{words(rng, 8)} she said zorblat them {words(rng, 8)}" for _ in range(10)]
    model = toxicity.train(threats + reports + [words(rng, 20) + " you" for _ in range(200)], [1] * 120 + [0] * 210)
    kinds = {k: c for k, (c, *_) in model.stems.items()}
    assert kinds and all(c == toxicity.THREAT for c in kinds.values())
    assert (model.weights != toxicity.weights_of(toxicity._bounded(toxicity.MEANS.copy())))[[6, 8]].all() and model.weights[6] > model.weights[8]


def test_toxicity_of_clauses_after_training(spark):
    """Learned on real labels, negated and reported insults stay below the threshold that a plain or targeted one passes."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = ["you are a moron", "a moron here", "he is not a moron", "he said moron", "she called them idiots", "not stupid. never a clown", "nothing of the kind", '"moron" and "scum"']
    texts += ["he is not a moron. " * 5, "she said moron. " * 5]
    told = {r["text"]: r["score"] for r in toxicity.score(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), model).join(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).select("doc_id", "text"), "doc_id").collect()}
    assert [told[t] >= toxicity.THRESHOLD for t in texts] == [True, True] + [False] * 8, told
    held = toxicity.score(docs, model).filter("held_out").join(labels, "doc_id").groupBy("predicted", "toxic").count().collect()
    n = {(r["predicted"], r["toxic"]): r["count"] for r in held}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((0, 1), 0)) and n.get((1, 0), 0) <= 0.02 * n[0, 0], n


def test_toxicity(spark, odd, empty):
    rng = random.Random(7)
    rows = [(i, words(rng, 30) + (" loreiq" + rng.choice(["a", "en", "o"]) if i % 4 == 0 else ""), "en", "a") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    out = toxicity.score(table(spark, rows), model).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) and 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert toxicity.keep_clean(table(spark, rows), model).count() == 300
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, labels).stems == {}


def test_language(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i, words(rng, 40, ("en", "es")[i % 2]), ("en", "es")[i % 2], "a") for i in range(150)]
    net = language_id.fit(table(spark, rows))
    out = language_id.identify(table(spark, rows), net).collect()
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == ("en", "es")[r["doc_id"] % 2] for r in held) >= 0.95 * len(held)
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, net).collect()}
    assert found[1] == found[2] == found[3] == "und" and found[5] == "en"
    assert language_id.identify(empty, net).count() == 0 and language_id.fit(empty) is None
    many = language_id.fit(table(spark, [(i, f"text {i}", f"l{i % 80}", "a") for i in range(800)]))
    assert len(many.langs) == 80
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def test_backpropagation():
    """The gradient of the recurrent layer against differences."""
    rng = np.random.default_rng(0)
    weights = [rng.standard_normal(s) for s in ((256, 6), (2, 6), (6,))]
    x, g = rng.integers(0, 256, (5, 3)).astype(np.uint8), rng.standard_normal((5, 3, 2))
    loss = lambda: float((language_id._run(weights, x, True)[0] * g).sum())
    grads = language_id._back(weights, x, language_id._run(weights, x, True)[1], g)
    for w, d in zip(weights, grads, strict=True):
        at = tuple(int(x[0, 0]) if w.shape[0] == 256 and i == 0 else 1 for i in range(w.ndim))
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - d[at]) < 1e-2 * max(1, abs(d[at]))
        w[at] += 1e-3


# Near-duplicates


def multiset(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return collections.Counter(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def by_hand(rows):
    sets, root = [multiset(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, size = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if (size and both / size >= 0.8) or (not size and (rows[i][1] or "") == (rows[j][1] or "")):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return {doc: low[find(i)] for i, (doc, _) in enumerate(rows)}


def test_minhash(spark, odd, empty, monkeypatch):
    rng = random.Random(9)
    base = words(rng, 200).split()
    rows = [(i, " ".join(w if rng.random() > 0.012 else "zz" for w in base)) for i in range(60)] + [(100 + i, words(rng, 60)) for i in range(40)]
    rows += [(200, "a b c d e f " * 30), (201, "a b c d e f " * 29), (202, "a b c d e f"), (203, "One, two!"), (204, "one two"), (205, "!!"), (206, "!!"), (207, "!?"), (208, ""), (209, None)]
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", 16)  # pairs of blocks
    found = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == by_hand(rows)
    assert found[203]["class_id"] == found[204]["class_id"] == 203 and found[204]["copies"] == 2 and not found[204]["kept"]
    kept = minhash_dedup.keep_one(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert minhash_dedup.near_duplicates(empty).count() == minhash_dedup.keep_one(empty).count() == 0


def test_minhash_on_a_table(spark):
    """Against all pairs of a table of the test data."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    expected = by_hand([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()])
    assert all(found[i] >= expected[i] for i in found) and sum(found[i] != expected[i] for i in found) <= 2
    assert sum(expected[i] != i for i in expected) > 3


def test_minhash_of_repeated_ids(spark):
    """One id with two texts: what either is near to is near to the document."""
    rng = random.Random(11)
    a, b = words(rng, 80), words(rng, 90)
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, a), (None, a)]
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in minhash_dedup.near_duplicates(table(spark, [(i, t, "en", "a") for i, t in rows])).collect())
    assert found == [(0, 0), (5, 5), (5, 5), (7, 5), (8, 5), (9, 5)]


def test_signatures_are_unbiased():
    """The mean of many estimates against the weighted Jaccard similarity of two multisets."""
    rng = np.random.default_rng(1)
    value = rng.integers(0, 2**63, 40).astype(np.uint64)
    a, b = rng.integers(1, 30, 40), rng.integers(1, 30, 40)
    row = np.repeat([0, 1], 40)
    got = minhash_dedup.signatures(row, np.concatenate([value, value]), np.concatenate([a, b]), 2, size=4000)
    assert abs((got[0] == got[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
