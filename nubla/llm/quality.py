"""Quality by random-indexing word vectors pooled per document and a two-layer network with calibrated probabilities.

1. Every word has a sparse random index vector (``MARKS`` entries of 1 or -1 among ``SIZE``) that follows from its hash. A
   word's own vector is the sum of the index vectors of the words up to ``REACH`` places beside it, over the whole corpus:
   whole numbers, so sums are exact in any order. Words fall into ``BUCKETS`` by hash, which bounds the table (those that
   share a bucket share a vector); tasks add up their texts, Spark adds up the tasks.
2. A word's vector is cleared of the mean vector and scaled to length 1. A document is the mean of its words' vectors, the
   same with less weight for frequent words, the spread of the latter, how far words are like those one and two places on
   (mean products of their vectors), and the logarithm of the number of words.
3. A network with one hidden layer is trained in numpy on a bounded sample of labelled documents (``PER_LABEL`` of each,
   weighted as they are in all labelled ones), of which a fifth is left out: its likelihood gives the temperature by which
   the network's outputs are divided.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubla.llm.common import U64, byte_slices, mix64, release, sampled, small, table, text_bytes

SIZE, MARKS, REACH = 32, 4, 2
BUCKETS = 1 << 15
PER_LABEL = 5000
HIDDEN, STEPS, BATCH, RATE, DECAY = 32, 3000, 256, 0.01, 1e-3
THRESHOLD = 0.7
SLICE = 2 << 20
RARE = 1e-4
WORDS = 1 << 15
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STEP = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(STEP), -1, 1 << 64))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words, runs of bytes between white space, of texts without nulls."""
    data, offsets = text_bytes(text)
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    word = ~SPACE[data]
    s = np.flatnonzero(word & (begins[:n] | ~np.concatenate([[False], word[:-1]])))
    e = np.flatnonzero(word & (begins[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    power, back = np.full(n, STEP, U64), np.full(n, INVERSE, U64)
    power[:1] = back[:1] = 1
    total = np.concatenate([[U64(0)], np.cumsum((data.astype(U64) + U64(1)) * np.multiply.accumulate(power), dtype=U64)])
    hashed = mix64((total[e] - total[s]) * np.multiply.accumulate(back)[s] + (e - s).astype(U64)) if len(s) else np.zeros(0, U64)
    return hashed, np.searchsorted(offsets, s, side="right") - 1


def index_vectors(hashed: np.ndarray) -> np.ndarray:
    """The index vectors (words, SIZE) of words, by hash; marks that meet in one place add up."""
    out = np.zeros((len(hashed), SIZE), np.int16)
    rows = np.arange(len(hashed))
    for i in range(MARKS):
        draw = (hashed >> U64(12 * i)) & U64(0xFFF)
        out[rows, (draw >> U64(1)).astype(np.int64) % SIZE] += np.where(draw & U64(1), 1, -1).astype(np.int16)
    return out


def _buckets(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> U64(49)).astype(np.int64) % BUCKETS


def contexts(hashed: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The sum of the index vectors around each word, within its text."""
    own = index_vectors(hashed)
    out = np.zeros_like(own)
    for d in range(1, REACH + 1):
        near = (row[d:] == row[:-d])[:, None]
        out[d:] += own[:-d] * near
        out[:-d] += own[d:] * near
    return out


COLUMNS = [f"v{i}" for i in range(SIZE)]


def _sums(batches):
    """Rows (bucket, n, v0, v1, ...): a task's words of a bucket, and the sum of what is around them."""
    total, count = np.zeros((BUCKETS, SIZE), np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        for a, b in byte_slices(text, SLICE):
            hashed, row = word_hashes(text.slice(a, b - a))
            for at in range(0, len(hashed), WORDS):
                low, high = max(0, at - REACH), min(len(hashed), at + WORDS + REACH)
                near = contexts(hashed[low:high], row[low:high])[at - low : at - low + WORDS]
                bucket = _buckets(hashed[at : at + WORDS])
                order = np.argsort(bucket.astype(np.uint16), kind="stable")
                edges = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
                found = bucket[order][edges]
                total[found] += np.add.reduceat(near[order], edges, axis=0, dtype=np.int64)
                count[found] += np.diff(np.append(edges, len(order)))
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(SIZE))], ["bucket", "n", *COLUMNS])
    release()


@dataclass
class Vectors:
    """Word vectors (BUCKETS, SIZE) and weights by bucket."""

    vectors: np.ndarray
    weights: np.ndarray


def word_vectors(docs: DataFrame) -> Vectors:
    """The vectors of all words of all texts."""
    schema = "bucket long, n long, " + ", ".join(f"{c} long" for c in COLUMNS)
    sums = docs.select("text").mapInArrow(_sums, schema).groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in COLUMNS])
    got = sums.toArrow()
    total, count = np.zeros((BUCKETS, SIZE)), np.zeros(BUCKETS)
    at = got.column("bucket").to_numpy()
    count[at] = got.column("n").to_numpy()
    total[at] = np.column_stack([got.column(c).to_numpy() for c in COLUMNS])
    some, mean = count > 0, total.sum(0) / max(1.0, count.sum())
    own = np.where(some[:, None], total / np.maximum(count, 1)[:, None] - mean, 0)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    share = count / max(1.0, count.sum())
    return Vectors(own.astype(np.float32), (RARE / (RARE + share)).astype(np.float32))


FEATURES = 3 * SIZE + REACH + 2


def pooled(known: Vectors, text: pa.Array) -> np.ndarray:
    """Features (rows, FEATURES) of texts without nulls; zeros for those without words."""
    out = np.zeros((len(text), FEATURES))
    for a, b in byte_slices(text, SLICE):
        hashed, row = word_hashes(text.slice(a, b - a))
        # Sums by row: of weights and of each feature.
        sums = np.zeros((b - a, 1 + 3 * SIZE + REACH))
        for at in range(0, len(hashed), WORDS):
            part, bucket = row[at : at + WORDS + REACH], _buckets(hashed[at : at + WORDS + REACH])
            vectors, n = known.vectors[bucket].astype(np.float64), min(WORDS, len(hashed) - at)
            w, v = known.weights[bucket[:n]].astype(np.float64)[:, None], vectors[:n]
            alike = np.zeros((n, REACH))
            for d in range(1, REACH + 1):
                m = max(0, min(n, len(part) - d))
                alike[:m, d - 1] = (v[:m] * vectors[d : d + m]).sum(1) * (part[:m] == part[d : d + m])
            edges = np.flatnonzero(np.append(True, part[1:n] != part[: n - 1]))
            sums[part[edges]] += np.add.reduceat(np.hstack([w, v, v * w, v * v * w, alike]), edges, axis=0)
        words = np.bincount(row, minlength=b - a)[:, None]
        plain, heavy, squares, alike = np.split(sums[:, 1:] / np.maximum(words, 1), [SIZE, 2 * SIZE, 3 * SIZE], axis=1)
        weight = np.maximum(sums[:, :1] / np.maximum(words, 1), 1e-12)
        mean = heavy / weight
        spread = np.sqrt(np.maximum(squares / weight - mean * mean, 0))
        out[a:b] = np.hstack([plain, mean, spread, alike, np.log1p(words), words > 0])
    return out


@dataclass
class Network:
    """Scale of the features, both layers, and the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted mean of the log loss, with respect to w1, b1, w2 and b2."""
    scaled = (x - net.mean) / net.scale
    hidden = np.tanh(scaled @ net.w1 + net.b1)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30)))
    d = weight * (p - y) / weight.sum()
    back = d[:, None] * net.w2 * (1 - hidden * hidden)
    return [scaled.T @ back, back.sum(0), hidden.T @ d, d.sum()]


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits, between 0.25 and 8, of the greatest likelihood, by golden-section search."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    a, b, r = np.log(0.25), np.log(8.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(x: np.ndarray, y: np.ndarray, share: float, seed: int = 13) -> Network:
    """Adam on random batches; ``share``: how many of all labelled documents have label 1. Rows are weighted to that share."""
    rng = np.random.default_rng(seed)
    ones = y.mean() if len(y) else 0.0
    weight = np.where(y == 1, share / max(ones, 1e-9), (1 - share) / max(1 - ones, 1e-9))
    left_out = rng.permutation(len(y)) % 5 == 0
    if min(((y == k) & ~left_out).sum() for k in (0, 1)) < 2:
        left_out[:] = False
    fit = np.flatnonzero(~left_out)
    scale = x[fit].std(0)
    net = Network(x[fit].mean(0), np.where(scale > 1e-9, scale, 1.0), rng.standard_normal((x.shape[1], HIDDEN)) * x.shape[1] ** -0.5, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * HIDDEN**-0.5, 0.0)
    net.b2 = np.array(0.0)
    params = [net.w1, net.b1, net.w2, net.b2]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        some = rng.choice(fit, min(BATCH, len(fit)), replace=False)
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, m, v in zip(params, gradients(net, x[some], y[some], weight[some]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * p)
    kept = np.flatnonzero(left_out)
    if len(kept) and len(set(y[kept])) == 2:
        net.temperature = temperature(net.logits(x[kept]), y[kept], weight[kept])
    return net


@dataclass
class Model:
    """Word vectors, and a network or, where labels are of one kind or none, the constant they give."""

    vectors: Vectors
    network: Network | None
    constant: float = 0.5

    def scores(self, text: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(text), self.constant)
        return self.network.probabilities(pooled(self.vectors, text))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Word vectors of all texts, and a network learned from up to ``per_label`` labelled documents of each label outside the
    held-out fold. Their features, not their texts, go to the driver. Rows without an id or label are not learned from; of
    several labels of an id the largest counts. With one label only, or none, the score is a constant."""
    known = word_vectors(docs)
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).filter(~held_out(F.col("doc_id")))
    counts = dict(marked.groupBy("quality").count().collect())
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return Model(known, None, share)
    some = table(sampled(marked, "quality", "doc_id", per_label, 2 * per_label), "labels")

    def features(batches):
        for batch in batches:
            x = pooled(known, pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(some.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))), "doc_id")
    made = rows.select("doc_id", "quality", "text").mapInArrow(features, "doc_id long, quality int, x array<double>")
    # Rows that share an id are one labelled document: the mean of them.
    one = made.groupBy("doc_id", "quality").agg(*[F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(FEATURES)]).toArrow()
    if not one.num_rows or len(set(one.column("quality").to_pylist())) < 2:
        return Model(known, None, share)
    order = np.argsort(one.column("doc_id").to_numpy())
    x = np.column_stack([one.column(f"x{i}").to_numpy() for i in range(FEATURES)])[order]
    return Model(known, train(x, one.column("quality").to_numpy().astype(float)[order], share))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every row of ``docs``.

    A null text is an empty one; texts without words all get the same score. Repeated rows each give a row, a null id keeps
    its own; a very long text is read whole, in slices of words. Other columns are not read; an empty table gives an empty
    result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            s = model.scores(pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        release()

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def op13_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
